"""Logs and tables several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duelframe.operators.history import measure
from duelframe.operators.sides import team_log
from duelframe.sources import adapters as A
from duelframe.sources.adapters import view


@view
def log(spark: SparkSession, sf: str) -> DataFrame:
    return log_of(A.matches(spark, sf))


def log_of(matches: DataFrame) -> DataFrame:
    return team_log(
        matches,
        ("match_id", "event_date", "year", "round", "venue_id", "league"),
        halftime_lead=("halftime_home - halftime_away", "halftime_away - halftime_home"),
        penalty_diff=("penalty_home - penalty_away", "penalty_away - penalty_home"),
    )


@view
def stats_log(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).join(A.side_stats(spark, sf), ["match_id", "side"], "left")


def per_entity(df: DataFrame, parts: int = 1):
    return measure(df, ["entity_id"], parts=parts)


def member_games(spark: SparkSession, sf: str) -> DataFrame:
    """Appearances with the member's own quantity in the match (``minutes`` stands for it)."""
    return A.member_lines(spark, sf)
