"""Sequential ratings with state shared by all participants of a league.

A rating update depends on every earlier update of both sides, so a league is a chain. The fold
therefore streams. Rows are narrowed to ids, date and scores, hashed by (block of parameter sets,
league), sorted by time inside the partition, so that its leagues run side by side, and read batch by
batch. Within a batch games without a common participant are played at once (``waves``), under all
parameter sets of the block. A task holds one batch and one number per participant and parameter set,
never a league's rows. A run can start from saved ratings and read only the new period, which is how a
long history is kept up to date.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from duelframe.operators.waves import fold

# the fold travels with its code, so workers need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RATED = (
    "config int, league int, match_id long, year int, home_id int, away_id int, home_elo double, away_elo double, "
    "home_elo_prob double, home_after double, away_after double"
)


@dataclass(frozen=True)
class RatingParams:
    """Parameters of one rating system."""

    k: float = 20.0
    home_advantage: float = 50.0
    initial: float = 1500.0
    keep: float = 0.75
    margin: str = "none"
    margin_divisor: float = 10.0
    reset_before_read: bool = False


def expected_score(home: str | Column, away: str | Column, home_advantage: float = 0.0) -> Column:
    """Probability that the home side wins, from both ratings."""
    home = F.col(home) if isinstance(home, str) else home
    away = F.col(away) if isinstance(away, str) else away
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (away - home - home_advantage) / 400.0))


def margin_multiplier(margin: str | Column, kind: str = "log", divisor: float = 10.0) -> Column:
    """Weight of a result by its margin: none, linear or logarithmic."""
    m = F.abs(F.col(margin) if isinstance(margin, str) else margin)
    if kind == "log":
        return F.ln(F.greatest(m, F.lit(1)) + 1)
    if kind == "linear":
        return 1.0 + m / divisor
    return F.when(m.isNotNull(), F.lit(1.0))


class _Chain:
    """Ratings of one league under one parameter set, game by game: for streams, which play a day at a time."""

    def __init__(self, params: RatingParams):
        self.p = params
        self.rating: dict[int, float] = {}
        self.season: int | None = None

    def turn(self, season: int | None) -> None:
        if season is None:
            return
        if self.season is not None and season > self.season:
            base, keep = self.p.initial, self.p.keep
            self.rating = {e: base + keep * (r - base) for e, r in self.rating.items()}
        self.season = season

    def weight(self, margin: int) -> float:
        if self.p.margin == "log":
            return math.log(max(margin, 1) + 1)
        if self.p.margin == "linear":
            return 1.0 + margin / self.p.margin_divisor
        return 1.0

    def expect(self, home: float, away: float) -> float:
        return 1.0 / (1.0 + 10.0 ** ((away - home - self.p.home_advantage) / 400.0))

    def play(self, season, home, away, home_score, away_score):
        scored = home_score is not None and away_score is not None
        if scored and self.p.reset_before_read:
            self.turn(season)
        start = self.p.initial
        before = self.rating.get(home, start), self.rating.get(away, start)
        read = self.expect(*before)
        if not scored:
            return (*before, read, None, None)
        self.turn(season)  # all known participants regress on the first scored game of a season
        h, a = self.rating.get(home, start), self.rating.get(away, start)
        gap = home_score - away_score
        result = 1.0 if gap > 0 else 0.0 if gap < 0 else 0.5
        step = self.p.k * self.weight(abs(gap)) * (result - self.expect(h, a))
        self.rating[home], self.rating[away] = h + step, a - step
        return (*before, read, h + step, a - step)


_OUT = pa.schema(
    [
        ("config", pa.int32()), ("league", pa.int32()), ("match_id", pa.int64()), ("year", pa.int32()),
        ("home_id", pa.int32()), ("away_id", pa.int32()), ("home_elo", pa.float64()), ("away_elo", pa.float64()),
        ("home_elo_prob", pa.float64()), ("home_after", pa.float64()), ("away_after", pa.float64()),
    ]
)


def rate(
    matches: DataFrame,
    params: Sequence[RatingParams] = (RatingParams(),),
    saved: DataFrame | None = None,
    sets_per_task: int = 16,
) -> DataFrame:
    """Pre-match ratings, win probability and ratings after the match, per parameter set.

    ``saved`` (league, entity_id, rating, year) continues from an earlier run: its rows enter the
    stream ahead of the matches. ``sets_per_task`` parameter sets are folded over one copy of the rows.
    A null league is one league, a null participant one participant; games without both scores are
    rated and change nothing.
    """
    spark = matches.sparkSession
    narrow = matches.select(
        "league", "event_date", "match_id", "year", "home_id", "away_id", "home_score", "away_score",
        F.lit(None).cast("double").alias("saved"),
    )
    if saved is not None:
        start = saved.select(
            "league", F.lit(None).cast("date").alias("event_date"), F.lit(None).cast("long").alias("match_id"), "year",
            F.col("entity_id").alias("home_id"), F.lit(None).cast("int").alias("away_id"),
            F.lit(None).cast("int").alias("home_score"), F.lit(None).cast("int").alias("away_score"),
            F.col("rating").alias("saved"),
        )
        narrow = narrow.unionByName(start)
    blocks = F.explode(F.sequence(F.lit(0), F.lit((len(params) - 1) // sets_per_task))).alias("block")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chained = (
        narrow.select("*", blocks)
        .repartition(parts, "block", "league")
        .sortWithinPartitions(
            "block", F.col("saved").isNull(), F.asc_nulls_first("event_date"), F.asc_nulls_first("match_id")
        )
    )
    return chained.mapInArrow(fold(list(params), sets_per_task, _OUT), RATED)


def rating_features(rated: DataFrame) -> DataFrame:
    """Ratings entering each match and their difference."""
    return rated.select(
        "match_id", "home_elo", "away_elo", "home_elo_prob", (F.col("home_elo") - F.col("away_elo")).alias("elo_diff")
    )


def rating_history(rated: DataFrame) -> DataFrame:
    """Two rows per scored match: rating before and after, for each side."""

    def side(name: str, other: str):
        return F.struct(
            F.lit(name == "home").alias("is_home"),
            F.col(f"{name}_id").alias("entity_id"),
            F.col(f"{other}_id").alias("opponent_id"),
            F.col(f"{name}_elo").alias("rating_before"),
            F.col(f"{name}_after").alias("rating_after"),
        )

    return (
        rated.filter(F.col("home_after").isNotNull())
        .select("config", "league", "match_id", "year", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s"))
        .select("config", "league", "match_id", "year", "s.*")
    )


def saved_ratings(rated: DataFrame, matches: DataFrame, params: RatingParams = RatingParams()) -> DataFrame:
    """Rating of every participant at the end of a run, the state a later run continues from.

    A participant that sat out later seasons has been regressed at each of their starts, although
    its last match does not show it.
    """
    dated = rating_history(rated).join(matches.select("match_id", "event_date"), "match_id")
    last = dated.groupBy("league", "entity_id").agg(
        F.max_by(F.struct("rating_after", "year"), F.struct("event_date", "match_id")).alias("l")
    )
    seasons = dated.select("league", "year").distinct()  # a few rows per league
    turn = F.row_number().over(Window.partitionBy("league").orderBy("year"))
    turns = seasons.withColumn("turn", turn)
    latest = seasons.groupBy("league").agg(F.max("year").alias("season"), F.count(F.lit(1)).alias("turns"))
    idle = F.col("turns") - F.col("turn")
    return (
        last.select("league", "entity_id", F.col("l.rating_after").alias("rated"), F.col("l.year").alias("year"))
        .join(turns, ["league", "year"])
        .join(latest, "league")
        .select(
            "league",
            "entity_id",
            (params.initial + F.pow(F.lit(params.keep), idle) * (F.col("rated") - params.initial)).alias("rating"),
            F.col("season").alias("year"),
        )
    )


def expected_log(log: DataFrame, rated: DataFrame) -> DataFrame:
    """Participant log with the expected result of its side."""
    p = rated.select("match_id", "home_elo_prob")
    return log.join(p, "match_id").withColumn(
        "expected", F.when(F.col("side") == "home", F.col("home_elo_prob")).otherwise(1.0 - F.col("home_elo_prob"))
    ).drop("home_elo_prob")


def parameter_losses(matches: DataFrame, params: Sequence[RatingParams], first: int, last: int) -> DataFrame:
    """Log loss of every parameter set on a range of seasons; all sets are folded in one job."""
    from duelframe.operators.metrics import log_loss_of

    judged = matches.select(
        "match_id", F.when(F.col("home_score") > F.col("away_score"), 1).when(F.col("home_score") < F.col("away_score"), 0).alias("label")
    )
    rated = rate(matches, params).filter(F.col("year").between(first, last)).join(judged, "match_id")
    return rated.filter(F.col("label").isNotNull()).groupBy("config").agg(
        F.avg(log_loss_of(F.col("home_elo_prob"), F.col("label"))).alias("log_loss"), F.count(F.lit(1)).alias("games")
    )


def best_parameters(losses: DataFrame, params: Sequence[RatingParams]) -> DataFrame:
    """The parameter set with the smallest loss as a one-row table, ready to be saved."""
    spark = losses.sparkSession
    table = spark.createDataFrame([{"config": i, **asdict(p)} for i, p in enumerate(params)])
    best = losses.agg(F.min_by("config", F.struct("log_loss", "config")).alias("config"), F.min("log_loss").alias("log_loss"))
    return best.join(table.withColumn("config", F.col("config").cast("int")), "config")


def save_parameters(best: DataFrame, path: str) -> None:
    best.coalesce(1).write.mode("overwrite").json(path)


def load_parameters(spark: SparkSession, path: str) -> RatingParams:
    row = spark.read.json(path).first()
    return RatingParams(**{f: row[f] for f in RatingParams.__dataclass_fields__})
