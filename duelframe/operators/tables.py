"""Derived tables other operators look things up in: ladders, season statistics, profiles, weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from duelframe.operators.entity import keep_first
from duelframe.operators.link import shifted, two_role_lookup
from duelframe.sources.adapters import table


def ladders(log: DataFrame) -> DataFrame:
    """Cumulative standings per season, round and participant.

    The log is combined to (season, round, participant) before any window runs, so the windows see
    a few dozen rows per participant and season however many games there are.
    """
    margin, pf, pa = F.col("margin"), F.col("points_for"), F.col("points_against")
    measures: dict[str, Column] = {
        "played": F.count(margin),
        "won": F.count_if(margin > 0),
        "drawn": F.count_if(margin == 0),
        "lost": F.count_if(margin < 0),
        "points_for": F.coalesce(F.sum(pf), F.lit(0)),
        "points_against": F.coalesce(F.sum(pa), F.lit(0)),
    }
    for side in ("home", "away"):
        here = F.col("side") == side
        measures |= {
            f"{side}_played": F.count(F.when(here, margin)),
            f"{side}_won": F.count_if(here & (margin > 0)),
            f"{side}_lost": F.count_if(here & (margin < 0)),
            f"{side}_for": F.coalesce(F.sum(F.when(here, pf)), F.lit(0)),
            f"{side}_against": F.coalesce(F.sum(F.when(here, pa)), F.lit(0)),
        }
    rounds = log.groupBy("year", "round", "entity_id").agg(*[c.alias(n) for n, c in measures.items()])
    so_far = Window.partitionBy("year", "entity_id").orderBy("round")
    standing = rounds.select(
        "year", "round", "entity_id", *[F.sum(n).over(so_far).alias(n) for n in measures]
    ).withColumns(
        {
            "competition_points": F.col("won") * 2 + F.col("drawn"),
            "points_diff": F.col("points_for") - F.col("points_against"),
        }
    )
    table_order = Window.partitionBy("year", "round").orderBy(
        F.desc("competition_points"), F.desc("points_diff"), F.desc("points_for"), "entity_id"
    )
    return standing.withColumn("position", F.row_number().over(table_order))


LADDER_VALUES = ["position", "won", "lost", "points_for", "points_against", "points_diff", "competition_points"]


def ladder_features(matches: DataFrame, ladder: DataFrame) -> DataFrame:
    """Standings after the previous round for both sides; named rounds and round 1 have none."""
    rates: dict[str, Column] = {}
    for side in ("home", "away"):
        won, lost, played = (F.col(f"{side}_{x}") for x in ("won", "lost", "played"))
        rates[f"{side}_win_pct"] = F.try_divide(won, won + lost)
        rates[f"{side}_ppg"] = F.try_divide(F.col(f"{side}_for"), played)
        rates[f"{side}_pag"] = F.try_divide(F.col(f"{side}_against"), played)
    values = [*LADDER_VALUES, *rates]
    prior = shifted(ladder.withColumns(rates), "round", 1).withColumnRenamed("round", "_round")
    keyed = matches.withColumn("_round", F.col("round_label").try_cast("int"))
    out = two_role_lookup(keyed, prior, values, ["year", "_round"])
    return out.withColumn("ladder_pos_diff", F.col("home_position") - F.col("away_position")).select(
        "match_id", *[f"{s}_{v}" for s in ("home", "away") for v in values], "ladder_pos_diff"
    )


def season_stats(log: DataFrame) -> DataFrame:
    """Season averages of the process statistics per participant."""
    return log.groupBy("year", "entity_id").agg(
        F.avg("runs").alias("avg_runs"), F.avg("errors").alias("avg_errors"), F.count("runs").alias("games")
    )


def points_allowed(members: DataFrame, matches: DataFrame) -> DataFrame:
    """What a participant's opponents' members made against it, by position group and season."""
    faced = members.join(matches.select("match_id", "home_id", "away_id"), "match_id").select(
        "year",
        F.when(F.col("side") == "home", F.col("away_id")).otherwise(F.col("home_id")).alias("entity_id"),
        "slot",
        "minutes",
    )
    slot, value = F.col("slot"), F.col("minutes")
    return faced.groupBy("year", "entity_id").agg(
        F.avg(F.when(slot == 1, value)).alias("spine"),
        F.avg(F.when(slot == 2, value)).alias("forward"),
        F.avg(F.when(slot >= 3, value)).alias("back"),
        F.avg(value).alias("total"),
    )


def opponent_profile(matches: DataFrame, profile: DataFrame) -> DataFrame:
    """Each side gets its *opponent's* profile."""
    groups = ["spine", "forward", "back", "total"]
    named = profile.select("year", "entity_id", *[F.col(g).alias(f"opp_{g}") for g in groups])
    out = two_role_lookup(matches, named, [f"opp_{g}" for g in groups], ["year"], home="away_id", away="home_id")
    return out.withColumn("opp_total_diff", F.col("home_opp_total") - F.col("away_opp_total"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions per match, read off the match's first line item."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    )
    first = keep_first(lines, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])
    part = F.col("l_partkey")
    return first.select(
        F.col("l_orderkey").alias("match_id"),
        F.when(part % 5 != 0, F.col("l_quantity") - 10).alias("temperature_c"),
        F.when(part % 5 != 0, F.round(F.col("l_discount") * 100) / 2).alias("precipitation_mm"),
        F.when(part % 7 != 0, F.round(F.col("l_tax") * 100) * 6).alias("wind_speed_kmh"),
        F.when(part % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("l_returnflag") == "A", "Good")
        .when(F.col("l_returnflag") == "N", "Heavy")
        .when(F.col("l_linestatus") == "F", "Fair")
        .otherwise("")
        .alias("ground_conditions"),
    )
