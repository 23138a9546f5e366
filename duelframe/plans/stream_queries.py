"""Streams in event order (STM-01, STM-03, STM-04): windows with corrections, ratings, last rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.plans.registry import query
from duelframe.plans.source_queries import _quote_stream, _stream, place
from duelframe.sources import adapters as A
from duelframe.streaming import ordered as O


@query(
    "stm01_corrected_windows",
    """
SELECT match_id, quoted_at AS window_start, CAST(sum(home_ticks) AS BIGINT) AS home_ticks, CAST(sum(away_ticks) AS BIGINT) AS away_ticks, count(*) AS quotes FROM quotes
WHERE quoted_at + INTERVAL 30 MINUTE <= (SELECT max(quoted_at) FROM quotes) - INTERVAL 2 DAY GROUP BY 1, 2""",
)
def stm01_corrected(spark, sf):
    out = place(spark, "corrected-windows")
    O.drain_ordered(O.corrected_windows(_quote_stream(spark, sf), "quoted_at"), out, f"{out}-checkpoint")
    return O.latest_windows(spark.read.parquet(out))


@query(
    "stm03_rating_in_order",
    """
SELECT f.league, f.match_id, m.event_date, home_elo, away_elo, home_elo_prob, false AS late FROM fold f JOIN matches m ON m.match_id = f.match_id
WHERE f.n > 0 AND m.event_date <= (SELECT max(event_date) FROM matches) - INTERVAL 30 DAY""",
    "home_elo away_elo home_elo_prob",
)
def stm03_in_order(spark, sf):
    games = A.matches_from(_stream(spark, sf, "orders"), A.table(spark, sf, "customer"))
    out = place(spark, "ratings-in-order")
    O.drain_ordered(O.ratings_in_order(games, late="30 days"), out, f"{out}-checkpoint")
    return spark.read.parquet(out)


@query("stm04_keep_last", "SELECT match_id, max(quoted_at) AS quoted_at, arg_max(line_no, (quoted_at, line_no)) AS line_no FROM quotes GROUP BY 1")
def stm04_keep_last(spark, sf):
    keys, order = ["match_id"], ["quoted_at", "line_no"]
    out = place(spark, "last-quotes")
    rows = _quote_stream(spark, sf).select(*keys, *order)
    O.drain_updates(O.keep_last(rows, keys, order, at="quoted_at"), out, f"{out}-checkpoint")
    return O.last_rows(spark.read.parquet(out).drop("batch"), keys, order)
