"""Projections, imputation, sets and top-k (NRM, SET, SRT) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from duelframe.functions.numbers import fair_pair
from duelframe.functions.text import has_any, looked_up, numeric_groups
from duelframe.operators import decisions as D, entity as E, features as X, groups as G, imputation as I, link as L, metrics as M, windows as W
from duelframe.operators.sides import from_sides, to_sides
from duelframe.plans.common import log, member_games, stats_log
from duelframe.plans.link_queries import named_matches
from duelframe.plans.registry import query
from duelframe.plans.views_sql import define
from duelframe.plans.windows_queries import importances, pick_rounds, picks
from duelframe.schema import flat_columns, numeric
from duelframe.sources import adapters as A


@query(
    "nrm07_lenient_number",
    """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS number FROM events""",
    "number",
)
def nrm07(spark, sf):
    e = A.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return e.select("event_id", numeric(text).alias("number"))


define(
    "odds_filled",
    """
SELECT * REPLACE (coalesce(h2h_home_close, h2h_home_open) AS h2h_home_close, coalesce(h2h_away_close, h2h_away_open) AS h2h_away_close,
       coalesce(line_home_close, line_home_open) AS line_home_close, coalesce(total_line_close, total_line_open) AS total_line_close),
       (h2h_home_close IS NULL AND h2h_home_open IS NOT NULL) OR (line_home_close IS NULL AND line_home_open IS NOT NULL) AS close_estimated
FROM odds""",
)
_O = ["match_id", "close_estimated", "h2h_home_close", "h2h_away_close", "line_home_close", "total_line_close"]


@query("nrm08_close_backfill", f"SELECT {', '.join(_O)} FROM odds_filled", " ".join(_O[2:]))
def nrm08(spark, sf):
    return I.backfill_close(A.odds(spark, sf)).select(*_O)


@query(
    "nrm09_mirror_columns",
    """
SELECT match_id, h2h_home_open AS h2h_home, h2h_home_open AS h2h_home_min, coalesce(h2h_home_close, h2h_home_open) AS h2h_home_close FROM odds""",
    "h2h_home h2h_home_min h2h_home_close",
)
def nrm09(spark, sf):
    o = A.odds(spark, sf).select("match_id", F.col("h2h_home_open").alias("h2h_home"), "h2h_home_close")
    return I.mirror(o, "h2h_home", ["h2h_home_close", "h2h_home_min"])


@query(
    "nrm10_played_decided",
    "SELECT match_id, home_score, away_score FROM matches WHERE home_score IS NOT NULL AND away_score IS NOT NULL AND home_score <> away_score",
)
def nrm10(spark, sf):
    m = A.matches(spark, sf).select("match_id", "home_score", "away_score")
    return X.decided(m)


@query(
    "nrm11_substring_filter",
    "SELECT match_id FROM matches WHERE CAST(home_id AS VARCHAR) LIKE '2%' OR CAST(away_id AS VARCHAR) LIKE '2%'",
)
def nrm11(spark, sf):
    names = named_matches(spark, sf)
    wanted = F.lower("home_team").contains("nation_2") | F.lower("away_team").contains("nation_2")
    return names.filter(wanted).select("match_id")


_MATRIX = ["home_score", "attendance", "h2h_home_close", "line_home_close", "bookmakers_surveyed"]


@query(
    "nrm12_feature_matrix",
    """
SELECT m.match_id, m.year, CAST(home_score AS DOUBLE) AS home_score, CAST(attendance AS DOUBLE) AS attendance, h2h_home_close, line_home_close,
       CAST(bookmakers_surveyed AS DOUBLE) AS bookmakers_surveyed, CASE WHEN home_score > away_score THEN 1 WHEN home_score < away_score THEN 0 END AS home_win
FROM matches m LEFT JOIN odds USING (match_id)""",
    "h2h_home_close line_home_close",
)
def nrm12(spark, sf):
    df = A.matches(spark, sf).join(A.odds(spark, sf), "match_id", "left")
    wanted = [*_MATRIX, "attendance", "not_a_column"]
    return X.feature_matrix(df, ["match_id", "year"], wanted)


@query(
    "nrm13_time_zone",
    "SELECT event_id, ts + INTERVAL 10 HOUR AS local_ts, ts AS utc_ts FROM events",
)
def nrm13(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", "ts")
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "+10:00")
    return e.select("event_id", local.alias("local_ts"), F.to_utc_timestamp(local, "+10:00").alias("utc_ts"))


@query(
    "nrm14_target",
    "SELECT match_id, CASE WHEN home_score > away_score THEN 1 WHEN home_score < away_score THEN 0 END AS home_win FROM matches",
)
def nrm14(spark, sf):
    return A.matches(spark, sf).select("match_id", X.target().alias("home_win"))


define(
    "opener_base",
    """
SELECT m.match_id, m.round AS round_number, max(CASE WHEN r.side = 'home' THEN r.days_rest END) AS home_days_rest,
       max(CASE WHEN r.side = 'away' THEN r.days_rest END) AS away_days_rest,
       max(CASE WHEN r.side = 'home' THEN r.bye_last_round END) AS home_bye_last_round,
       max(CASE WHEN r.side = 'away' THEN r.bye_last_round END) AS away_bye_last_round
FROM matches m JOIN rest r USING (match_id) GROUP BY 1, 2""",
)


@query(
    "nrm15_clamp_openers",
    """
SELECT match_id, round_number, CASE WHEN home_days_rest IS NOT NULL THEN least(home_days_rest, 14) END AS home_days_rest,
       CASE WHEN away_days_rest IS NOT NULL THEN least(away_days_rest, 14) END AS away_days_rest,
       CASE WHEN round_number = 1 THEN 0 ELSE home_bye_last_round END AS home_bye_last_round,
       CASE WHEN round_number = 1 THEN 0 ELSE away_bye_last_round END AS away_bye_last_round,
       CASE WHEN home_days_rest IS NOT NULL THEN least(home_days_rest, 14) END - CASE WHEN away_days_rest IS NOT NULL THEN least(away_days_rest, 14) END AS rest_diff
FROM opener_base""",
)
def nrm15(spark, sf):
    from duelframe.plans.windows_queries import wn08

    rested = wn08(spark, sf).select("match_id", "home_days_rest", "away_days_rest", "home_bye_last_round", "away_bye_last_round", "rest_diff")
    rounds = A.matches(spark, sf).select("match_id", F.col("round").alias("round_number"))
    return I.clamp_openers(rounds.join(rested, "match_id"))


@query(
    "nrm16_coherent_prices",
    """
SELECT match_id, odds_prob AS odds_home_prob, 1 - odds_prob AS odds_away_prob,
       CASE WHEN match_id % 4 = 0 THEN odds_prob ELSE open_prob END AS odds_home_open_prob,
       CASE WHEN match_id % 4 = 0 THEN -26.0::DOUBLE * (odds_prob - 0.5) ELSE line_home_open END AS spread_home_open,
       CASE WHEN match_id % 4 = 0 THEN 0 ELSE coalesce(close_prob - open_prob, 0) END AS odds_movement,
       CASE WHEN match_id % 4 = 0 THEN 1 ELSE 7 END AS bookmakers_surveyed, 0.05::DOUBLE AS implied_draw_prob
FROM predictions WHERE odds_prob IS NOT NULL""",
    "odds_home_prob odds_away_prob odds_home_open_prob spread_home_open odds_movement",
)
def nrm16(spark, sf):
    known = F.col("match_id") % 4 != 0
    p = A.predictions(spark, sf).filter("odds_prob is not null").select(
        "match_id",
        F.col("odds_prob").alias("odds_home_prob"),
        (1 - F.col("odds_prob")).alias("odds_away_prob"),
        F.when(known, F.col("open_prob")).alias("odds_home_open_prob"),
        F.when(known, F.col("line_home_open")).alias("spread_home_open"),
        F.when(known, F.col("close_prob") - F.col("open_prob")).alias("odds_movement"),
        F.when(known, 7).alias("bookmakers_surveyed"),
        F.lit(None).cast("double").alias("implied_draw_prob"),
    )
    return I.coherent_prices(p)


_IMPUTED = ["attendance", "h2h_home_close", "line_home_close", "home_score"]


@query(
    "nrm17_median_imputation",
    f"""
SELECT match_id, year, {', '.join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM matches LEFT JOIN odds USING (match_id) WHERE year < 2000)) AS {c}" for c in _IMPUTED)},
       0.0::DOUBLE AS is_finals
FROM matches LEFT JOIN odds USING (match_id)""",
    " ".join(_IMPUTED),
)
def nrm17(spark, sf):
    df = A.matches(spark, sf).join(A.odds(spark, sf), "match_id", "left").select(
        "match_id", "year", *_IMPUTED, F.lit(None).cast("double").alias("is_finals")
    )
    medians = I.exact_medians(df.filter("year < 2000"), [*_IMPUTED, "is_finals"])
    return I.fill_with(df, medians)


@query(
    "nrm18_recency_weight",
    "SELECT match_id, power(0.92::DOUBLE, (SELECT max(year) FROM matches) - year) AS weight FROM matches",
    "weight",
)
def nrm18(spark, sf):
    return I.recency_weight(A.matches(spark, sf).select("match_id", "year")).select("match_id", "weight")


@query(
    "nrm19_overlay_fresh",
    "SELECT match_id, coalesce(close_prob, open_prob) AS prob FROM predictions WHERE open_prob IS NOT NULL",
    "prob",
)
def nrm19(spark, sf):
    p = A.predictions(spark, sf)
    base = p.filter("open_prob is not null").select("match_id", F.col("open_prob").alias("prob"))
    fresh = p.filter("close_prob is not null").select("match_id", F.col("close_prob").alias("fresh_prob"))
    return L.overlay(base, fresh, ["match_id"], {"prob": "fresh_prob"})


@query("nrm20_two_sided_unpivot", "SELECT match_id, event_date, side, entity_id, opponent_id, points_for, points_against, margin, result, halftime_lead FROM log")
def nrm20(spark, sf):
    return log(spark, sf).select(
        "match_id", "event_date", "side", "entity_id", "opponent_id", "points_for", "points_against", "margin", "result", "halftime_lead"
    )


@query(
    "nrm21_pivot_back",
    """
SELECT match_id, home_id AS home_entity_id, away_id AS away_entity_id, home_score AS home_points_for, away_score AS away_points_for,
       home_score - away_score AS points_for_diff FROM matches""",
)
def nrm21(spark, sf):
    return from_sides(log(spark, sf), ["entity_id", "points_for"], differences={"points_for_diff": "points_for"})


_SHARES = ["F", "O", "P"]


@query(
    "nrm22_long_to_wide",
    """
SELECT o_custkey AS member_id, CAST(year(o_orderdate) AS INTEGER) AS year, """
    + ", ".join(f"min(CASE WHEN o_orderstatus = '{s}' THEN o_orderkey END) AS {s}" for s in _SHARES)
    + " FROM orders GROUP BY 1, 2",
)
def nrm22(spark, sf):
    o = A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("member_id"), F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderkey"
    )
    return X.long_to_wide(o, ["member_id", "year"], "o_orderstatus", _SHARES, "o_orderkey")


@query(
    "nrm23_completed_with_link",
    "SELECT o_orderkey AS match_id, o_orderstatus AS state FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 9 <> 0",
)
def nrm23(spark, sf):
    o = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("match_id"),
        F.col("o_orderstatus").alias("state"),
        F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("/match/"), F.col("o_orderkey").cast("string"))).alias("link"),
    )
    return X.completed_fixtures(o, ["F", "P"]).select("match_id", "state")


@query(
    "nrm24_slot_lookup",
    """
SELECT match_id, side, slot, member_id,
       CASE slot WHEN 1 THEN 'FB' WHEN 2 THEN 'WG' WHEN 3 THEN 'CE' WHEN 4 THEN 'CE' WHEN 5 THEN 'WG' WHEN 6 THEN 'FE' WHEN 7 THEN 'HB' WHEN 8 THEN 'PR' WHEN 9 THEN 'HK'
                 WHEN 10 THEN 'PR' WHEN 11 THEN 'SR' WHEN 12 THEN 'SR' WHEN 13 THEN 'LK' WHEN 14 THEN 'INT' WHEN 15 THEN 'INT' WHEN 16 THEN 'INT' WHEN 17 THEN 'INT' END AS position,
       slot IN (1, 6, 7, 9) AS is_spine, slot BETWEEN 1 AND 13 AS is_starter FROM appearances""",
)
def nrm24(spark, sf):
    return A.appearances(spark, sf).select(
        "match_id",
        "side",
        "slot",
        "member_id",
        looked_up("slot", A.POSITION_BY_SLOT).alias("position"),
        F.col("slot").isin(*A.SPINE_SLOTS).alias("is_spine"),
        F.col("slot").between(1, 13).alias("is_starter"),
    )


@query(
    "nrm25_arrays_to_rows",
    "SELECT match_id, side, member_name, slot, slot <= 2 AS is_starter FROM appearances",
)
def nrm25(spark, sf):
    named = A.appearances(spark, sf)
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("slot", "member_name"))), lambda x: x["member_name"]
    )
    arrays = named.groupBy("match_id", "side").agg(ordered.alias("all")).select(
        "match_id", "side", F.slice("all", 1, 2).alias("lineup"), F.slice("all", F.lit(3), F.size("all")).alias("bench")
    )
    return G.appearance_rows(arrays, ["match_id", "side"], bench_from=3)


@query(
    "nrm26_column_groups",
    """
SELECT 'money' AS grp, 'l_discount' AS col, count(l_discount) AS known FROM lineitem UNION ALL
SELECT 'money', 'l_extendedprice', count(l_extendedprice) FROM lineitem UNION ALL
SELECT 'money', 'l_tax', count(l_tax) FROM lineitem UNION ALL
SELECT 'volume', 'l_quantity', count(l_quantity) FROM lineitem""",
)
def nrm26(spark, sf):
    lines = A.table(spark, sf, "lineitem")
    groups = numeric_groups(lines.schema, {"money": ["price", "discount", "tax"], "volume": ["quantity"]}, skip=["l_orderkey"])
    names = sorted(groups)
    counts = lines.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "col", "known")
    return counts.select(looked_up("col", groups).alias("grp"), "col", "known")


@query("nrm27_period_slice", "SELECT match_id, home_score, away_score FROM matches WHERE year = 1999 AND round = 7 AND home_score IS NOT NULL")
def nrm27(spark, sf):
    return X.period_slice(A.matches(spark, sf), 1999, 7).select("match_id", "home_score", "away_score")


@query(
    "nrm28_source_fallback",
    """
SELECT match_id, CASE WHEN home_score IS NOT NULL THEN home_score ELSE CAST(r AS INTEGER) END AS home_score,
       CASE WHEN home_score IS NOT NULL THEN 'results' ELSE 'feed' END AS source
FROM matches LEFT JOIN (SELECT l_orderkey AS match_id, count(*) AS r FROM lineitem GROUP BY 1) USING (match_id)
WHERE home_score IS NOT NULL OR r IS NOT NULL""",
)
def nrm28(spark, sf):
    results = A.matches(spark, sf).filter("home_score is not null").select("match_id", "home_score")
    feed = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(
        F.count(F.lit(1)).cast("int").alias("home_score")
    )
    known = A.matches(spark, sf).select("match_id")
    return X.first_source(results, feed.join(known, "match_id", "left_semi"), "match_id")


@query(
    "nrm29_latest_predictions",
    """
SELECT home_id || ' v ' || away_id AS matchup, match_id, CASE WHEN coalesce(odds_prob, 0.5) >= 0.5 THEN CAST(home_id AS VARCHAR) ELSE CAST(away_id AS VARCHAR) END AS decision,
       coalesce(odds_prob, 0.5) AS prob FROM predictions""",
    "prob",
)
def nrm29(spark, sf):
    p = A.predictions(spark, sf).withColumns(
        {
            "home_team": F.col("home_id").cast("string"),
            "away_team": F.col("away_id").cast("string"),
            "home_win_prob": F.col("odds_prob"),
        }
    )
    return D.latest_predictions(p, "match_id")


# ---- sets ------------------------------------------------------------------------------------


@query(
    "set01_union_by_name",
    """
SELECT match_id, event_date, NULL::DOUBLE AS price FROM matches WHERE year <= 1997 UNION ALL
SELECT match_id, event_date, h2h_home_open FROM matches LEFT JOIN odds USING (match_id) WHERE year > 1997""",
    "price",
)
def set01(spark, sf):
    m = A.matches(spark, sf).select("match_id", "event_date", "year")
    priced = m.filter("year > 1997").join(A.odds(spark, sf).select("match_id", F.col("h2h_home_open").alias("price")), "match_id", "left")
    return m.filter("year <= 1997").unionByName(priced, allowMissingColumns=True).drop("year")


@query(
    "set02_difference",
    "SELECT DISTINCT year, round FROM matches EXCEPT SELECT DISTINCT year, round FROM matches WHERE home_score IS NULL",
)
def set02(spark, sf):
    m = A.matches(spark, sf)
    return m.select("year", "round").distinct().exceptAll(m.filter("home_score is null").select("year", "round").distinct())


@query(
    "set03_row_intersection",
    """
SELECT match_id, CAST(len(list_intersect(h, a)) AS INTEGER) AS shared FROM
 (SELECT match_id, list(slot) FILTER (WHERE side = 'home') AS h, list(slot) FILTER (WHERE side = 'away') AS a FROM appearances GROUP BY 1)
WHERE h IS NOT NULL AND a IS NOT NULL""",
)
def set03(spark, sf):
    seats = A.appearances(spark, sf).groupBy("match_id").agg(
        F.collect_set(F.when(F.col("side") == "home", F.col("slot"))).alias("h"),
        F.collect_set(F.when(F.col("side") == "away", F.col("slot"))).alias("a"),
    )
    both = seats.filter((F.size("h") > 0) & (F.size("a") > 0))
    return both.select("match_id", F.size(F.array_intersect("h", "a")).alias("shared"))


@query("set04_union_of_names", "SELECT home_id AS entity_id FROM matches UNION SELECT away_id FROM matches")
def set04(spark, sf):
    m = A.matches(spark, sf)
    return m.select(F.explode(F.array("home_id", "away_id")).alias("entity_id")).distinct()


@query(
    "set05_common_keys",
    "SELECT DISTINCT year, member_id FROM appearances INTERSECT SELECT DISTINCT year - 1 AS year, member_id FROM appearances",
)
def set05(spark, sf):
    """Members seen in a season and in the next one, for every season."""
    seen = A.appearances(spark, sf).select("year", "member_id")
    return seen.intersect(seen.select((F.col("year") - 1).alias("year"), "member_id"))


@query(
    "set06_distinct_on_key",
    """
SELECT match_id, line_no, part_no, bookmaker FROM (SELECT *, row_number() OVER (PARTITION BY match_id, line_no ORDER BY quoted_at, part_no, bookmaker) AS k FROM quotes) WHERE k = 1""",
)
def set06(spark, sf):
    q = A.quotes(spark, sf).select("match_id", "line_no", "quoted_at", "part_no", "bookmaker")
    return E.keep_first(q, ["match_id", "line_no"], ["quoted_at", "part_no", "bookmaker"]).drop("quoted_at")


# ---- sorts and top-k -------------------------------------------------------------------------


@query(
    "srt01_chronological",
    "SELECT match_id, year, round_label, event_date FROM matches",
)
def srt01(spark, sf):
    from duelframe.functions.text import round_sort_key

    m = A.matches(spark, sf).select("match_id", "year", "round_label", "event_date")
    return m.orderBy("year", round_sort_key("round_label"), "event_date", "match_id")


@query(
    "srt02_top_features",
    "SELECT feature, avg(importance) AS importance FROM importances GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2",
    "importance",
)
def srt02(spark, sf):
    means = importances(spark, sf).groupBy("feature").agg(F.avg("importance").alias("importance"))
    return means.orderBy(F.desc("importance"), "feature").limit(2)


@query(
    "srt03_top_per_group",
    """
SELECT entity_id, year, member_id, starts, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id, year ORDER BY starts DESC, member_id) AS INTEGER) AS rank
FROM (SELECT entity_id, year, member_id, count(*) AS starts FROM appearances WHERE is_starter GROUP BY 1, 2, 3)) WHERE rank <= 17""",
)
def srt03(spark, sf):
    return G.top_members(A.appearances(spark, sf), 17)


@query(
    "srt04_head_and_tail",
    """
(SELECT 'head' AS part, o_orderkey AS match_id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
UNION ALL (SELECT 'tail', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)""",
    "price",
)
def srt04(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_totalprice").alias("price"))
    head = o.orderBy(F.desc("price"), "match_id").limit(10).withColumn("part", F.lit("head"))
    tail = o.orderBy("price", "match_id").limit(10).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


@query(
    "srt05_first_in_horizon",
    """
SELECT match_id, event_date FROM matches WHERE event_date >= DATE '2000-03-05'
  AND event_date <= (SELECT min(event_date) FROM matches WHERE event_date >= DATE '2000-03-05') + 10 ORDER BY event_date, match_id LIMIT 8""",
)
def srt05(spark, sf):
    ahead = A.matches(spark, sf).select("match_id", "event_date").filter("event_date >= date'2000-03-05'")
    return X.first_in_horizon(ahead, "event_date", 10, 8)


@query("srt06_nearest_first", "SELECT match_id, odds_id, link_gap FROM nearest WHERE odds_id IS NOT NULL")
def srt06(spark, sf):
    m = A.matches(spark, sf).select("match_id", "event_date", "home_id", "away_id")
    linked = L.nearest_link(m, A.odds_feed(spark, sf), [])
    return linked.filter("odds_id is not null").select("match_id", "odds_id", "link_gap")


define(
    "model_probs",
    """
SELECT match_id, year, home_win AS label, 'market' AS model, odds_prob AS prob FROM picks UNION ALL
SELECT match_id, year, home_win, 'model', model_prob FROM picks UNION ALL
SELECT match_id, year, home_win, 'blend', blend_prob FROM picks UNION ALL
SELECT match_id, year, home_win, 'constant', 0.55::DOUBLE FROM picks""",
)


def model_probs(spark, sf):
    """Long table (model, match, probability, label) of the pickers and a constant baseline."""
    p = picks(spark, sf).select(
        "match_id", "year", F.col("home_win").alias("label"), F.col("odds_prob").alias("market"),
        F.col("model_prob").alias("model"), F.col("blend_prob").alias("blend"), F.lit(0.55).alias("constant"),
    )
    return p.unpivot(["match_id", "year", "label"], ["market", "model", "blend", "constant"], "model", "prob")


_LL = "-(label * ln(greatest(1e-7, least(1 - 1e-7, prob))) + (1 - label) * ln(1 - greatest(1e-7, least(1 - 1e-7, prob))))"
define(
    "fold_metrics",
    f"""
SELECT model, year AS fold, count(*) AS games, avg(CAST((prob >= 0.5) = (label = 1) AS INTEGER)) AS accuracy, avg({_LL}) AS log_loss,
       avg((prob - label) ** 2) AS brier FROM model_probs GROUP BY 1, 2""",
)


@query(
    "srt07_ranked_comparison",
    """
SELECT model, accuracy, log_loss, brier, log_loss - (SELECT avg(log_loss) FROM fold_metrics WHERE model = 'market') AS delta,
       log_loss < (SELECT avg(log_loss) FROM fold_metrics WHERE model = 'market') - 1e-12 AS beats_baseline
FROM (SELECT model, avg(accuracy) AS accuracy, avg(log_loss) AS log_loss, avg(brier) AS brier FROM fold_metrics GROUP BY 1)""",
    "accuracy log_loss brier delta",
)
def srt07(spark, sf):
    folds = M.probability_metrics(model_probs(spark, sf), ["model", "year"])
    means = M.fold_means(folds, ["model"], ["accuracy", "log_loss", "brier"]).drop("folds")
    return M.versus_baseline(means, "market").orderBy("log_loss", "model")
