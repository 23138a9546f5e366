"""Joins between tables that agree on most keys, or nearly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """Reduce to one row per key with map-side combining, so that a join on the key cannot multiply."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_k"))
    return best.select(*keys, "_k.*")


def exact_link(matches: DataFrame, feed: DataFrame, values: Sequence[str]) -> DataFrame:
    """Left join on (date, home, away) with a marker of whether a row was found."""
    one = one_per_key(
        feed.withColumnRenamed("odds_date", "event_date"), ["event_date", "home_id", "away_id"], ["odds_id"],
        ["odds_id", *values],
    )
    return matches.join(one, ["event_date", "home_id", "away_id"], "left").withColumn(
        "is_linked", F.col("odds_id").isNotNull()
    )


def nearest_link(matches: DataFrame, feed: DataFrame, values: Sequence[str], days: int = 2) -> DataFrame:
    """The feed row of the same pair nearest in date, at most ``days`` away; ties to the earlier date.

    The feed is moved to each date it may serve and reduced to its best row per (pair, date) with
    map-side combining. The join is then one-to-one on equal keys: no range predicate, no
    comparison of all meetings of a pair, and a pair that owns much of the table is spread by date.
    Exact and inexact matches come out of one pass.
    """
    moved = feed.select(
        "home_id",
        "away_id",
        "odds_id",
        "odds_date",
        *values,
        F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_shift"),
    ).withColumn("event_date", F.date_add("odds_date", F.col("_shift")))
    best = one_per_key(
        moved, ["home_id", "away_id", "event_date"], [F.abs("_shift"), "odds_date", "odds_id"],
        ["odds_id", "odds_date", *values],
    )
    return matches.join(best, ["home_id", "away_id", "event_date"], "left").withColumn(
        "link_gap", F.datediff("odds_date", "event_date")
    )


def orientation_in_feed(matches: DataFrame, feed: DataFrame, offsets: Sequence[int] = (0, -2, -1, 1, 2)) -> DataFrame:
    """Whether the feed lists each match as given, swapped, or not at all.

    Offsets are tried in order, the given orientation before the swapped one. Feed rows are moved
    to the dates they may serve and reduced, per unordered pair and date, to the best rank of each
    orientation; one equal-key join then answers every match.
    """
    ranked = F.explode(F.array(*[F.struct(F.lit(o).alias("off"), F.lit(i).alias("rank")) for i, o in enumerate(offsets)]))
    moved = feed.select("home_id", "away_id", "odds_date", ranked.alias("_t")).select(
        F.least("home_id", "away_id").alias("_low"),
        F.greatest("home_id", "away_id").alias("_high"),
        F.date_sub("odds_date", F.col("_t.off")).alias("event_date"),
        F.when(F.col("home_id") < F.col("away_id"), F.col("_t.rank")).alias("_r_low"),
        F.when(F.col("home_id") > F.col("away_id"), F.col("_t.rank")).alias("_r_high"),
    )
    best = moved.groupBy("_low", "_high", "event_date").agg(
        F.min("_r_low").alias("_r_low"), F.min("_r_high").alias("_r_high")
    )
    joined = matches.withColumns(
        {"_low": F.least("home_id", "away_id"), "_high": F.greatest("home_id", "away_id")}
    ).join(best, ["_low", "_high", "event_date"], "left")
    low_home = F.col("home_id") < F.col("away_id")
    direct = F.when(low_home, F.col("_r_low")).otherwise(F.col("_r_high"))
    swapped = F.when(low_home, F.col("_r_high")).otherwise(F.col("_r_low"))
    return joined.withColumn(
        "orientation",
        F.when(direct.isNull() & swapped.isNull(), "unmatched")
        .when(swapped.isNull() | (direct <= swapped), "direct")
        .otherwise("swapped"),
    ).drop("_low", "_high", "_r_low", "_r_high")


def two_role_lookup(
    matches: DataFrame,
    table: DataFrame,
    values: Sequence[str],
    keys: Sequence[str],
    home: str = "home_id",
    away: str = "away_id",
    entity: str = "entity_id",
) -> DataFrame:
    """Look a per-participant table up twice, for the home and the away side.

    ``keys`` are the shared keys (season, round); the table's key must be unique. Passing the other
    side's column as ``home`` reads the opponent's row.
    """
    for side, column in (("home", home), ("away", away)):
        renamed = table.select(
            *keys, F.col(entity).alias("_entity"), *[F.col(v).alias(f"{side}_{v}") for v in values]
        ).withColumnRenamed("_entity", column)
        matches = matches.join(renamed, [*keys, column], "left")
    return matches


def shifted(table: DataFrame, column: str, by: int) -> DataFrame:
    """Move a key forward so that an equal-key join reads the earlier period."""
    return table.withColumn(column, (F.col(column) + by).cast(table.schema[column].dataType))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row (empty when a lookup is safe)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def mark(df: DataFrame, members: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Boolean column telling whether the row's key is in a key set."""
    present = members.select(*keys).distinct().withColumn("_there", F.lit(True))
    return df.join(present, list(keys), "left").withColumn(name, F.coalesce("_there", F.lit(False))).drop("_there")


def side_by_side(
    a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str], margin: float = 0.0005
) -> DataFrame:
    """Two result tables by keys with deltas and a better/worse/same verdict on the first measure."""
    left = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in measures])
    right = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in measures])
    out = left.join(right, list(keys)).withColumns({f"{m}_delta": F.col(f"{m}_b") - F.col(f"{m}_a") for m in measures})
    d = F.col(f"{measures[0]}_delta")
    return out.withColumn("verdict", F.when(d < -margin, "better").when(d > margin, "worse").otherwise("same"))


def overlay(base: DataFrame, fresh: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Update columns from a fresh feed where it has a value: ``columns`` maps base to fresh names."""
    joined = base.join(fresh, list(keys), "left")
    return joined.withColumns({b: F.coalesce(F.col(f), F.col(b)) for b, f in columns.items()}).select(*base.columns)
