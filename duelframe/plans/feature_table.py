"""The whole point-in-time feature table as one lazy plan.

Each block is a table keyed by match; blocks end in a hash aggregate or a projection on ``match_id``,
so joining them reuses that partitioning. The participant log is built once and every bounded window
over it runs on the same exchange and sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelframe.operators import features as X, groups as G, imputation as I, link as L, ratings as R, tables as T, windows as W
from duelframe.operators.history import measure
from duelframe.operators.sides import from_sides
from duelframe.plans.common import log, per_entity, stats_log
from duelframe.sources import adapters as A

FORM = [f"{s}_{n}" for n in (3, 5, 8) for s in ("win_rate", "avg_pf", "avg_pa", "avg_margin")]
CONSISTENCY = [f"{s}_{n}" for n in (5, 8) for s in ("pf_std", "pa_std", "close_game_rate", "pf_trend", "pa_trend")]
SCHEDULE = ["days_rest", "is_back_to_back", "bye_last_round"]


def log_features(spark: SparkSession, sf: str) -> DataFrame:
    """Form, consistency, schedule and streak of both sides: all on one sort of the log."""
    return features_of(log(spark, sf))


def features_of(df: DataFrame) -> DataFrame:
    """``log_features`` of a given log; a cell is small, since a task holds its rows once per window."""
    df = df.select("match_id", "event_date", "side", "entity_id", "points_for", "points_against", "margin", "result", "halftime_lead", "penalty_diff")
    df, layout = per_entity(df, parts=8).opened(df, 8, "result")
    df = W.rolling_form(df, layout)
    df = W.scoring_consistency(df, layout)
    df = W.schedule(df, layout)
    df = layout.closed(W.streak(df, layout))
    values = [*FORM, "avg_halftime_lead_5", "avg_penalty_diff_5", "last_result", *CONSISTENCY, *SCHEDULE, "streak"]
    diffs = {f"win_rate_diff_{n}": f"win_rate_{n}" for n in (3, 5, 8)} | {"rest_diff": "days_rest"}
    return from_sides(df, values, differences=diffs)


def base_features(spark: SparkSession, sf: str) -> DataFrame:
    """Matches with form, standings, prices, venue records and ratings: what the composites need."""
    m = A.matches(spark, sf)
    df = log(spark, sf)
    venue = from_sides(W.venue_record(df, measure(df, ["entity_id", "venue_id"])), ["venue_win_rate"])
    ladder = T.ladder_features(m.select("match_id", "year", "round_label", "home_id", "away_id"), T.ladders(df))
    prices = X.price_features(I.backfill_close(A.odds(spark, sf)))
    return (
        X.context(m)
        .join(log_features(spark, sf), "match_id")
        .join(ladder, "match_id", "left")
        .join(venue, "match_id", "left")
        .join(prices, "match_id", "left")
    )


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature block, with the sequential ratings, for training and scoring."""
    m = A.matches(spark, sf)
    rated = R.rating_features(R.rate(m))
    df = log(spark, sf)
    shares = W.home_ground(
        df.select("match_id", "event_date", "year", "venue_id", "side", "entity_id", "margin"),
        measure(df, ["entity_id", "year"]),
        measure(df, ["entity_id", "year", "venue_id"]),
    )
    ground = W.ground_flags(from_sides(shares, ["home_share"])).select("match_id", "is_home_ground", "is_neutral_venue")
    base = X.momentum(base_features(spark, sf).join(ground, "match_id", "left").join(rated, "match_id", "left"))
    wide = X.early_season(X.game_context(X.season_interactions(X.interactions(X.market_features(base)))))
    return X.price_movement(X.kickoff(wide)).withColumn("home_win", X.target())
