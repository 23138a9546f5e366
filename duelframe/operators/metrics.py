"""Aggregates that judge probabilities, decisions and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CLIP = 1e-7


def log_loss_of(prob: Column, label: Column, clip: float = CLIP) -> Column:
    """Per-row log loss with the probability clipped away from 0 and 1."""
    p = F.greatest(F.lit(clip), F.least(F.lit(1.0 - clip), prob))
    return -(label * F.ln(p) + (1 - label) * F.ln(1 - p))


def probability_metrics(df: DataFrame, by: Sequence[str], prob: str = "prob", label: str = "label") -> DataFrame:
    """Accuracy, log loss and Brier score per group, in one combined aggregate."""
    p, y = F.col(prob), F.col(label)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("games"),
        F.avg(((p >= 0.5) == (y == 1)).cast("double")).alias("accuracy"),
        F.avg(log_loss_of(p, y)).alias("log_loss"),
        F.avg(F.pow(p - y, F.lit(2.0))).alias("brier"),
    )


def auc(df: DataFrame, by: Sequence[str], prob: str = "prob", label: str = "label", cells: int = 64) -> DataFrame:
    """Exact area under the ROC curve per group.

    Rows are first counted per distinct score (combined before the shuffle). The scores are cut at
    their own quantiles into ``cells`` ordered slices, so scores that crowd in one place spread like
    others: the negatives of lower slices come from a small per-cell table, those inside a slice from
    a window on (group, cell), so no task sees a whole group. Where the cuts lie changes no result.
    """
    y = F.col(label)
    counts = df.groupBy(*by, F.col(prob).alias("_p")).agg(
        F.sum((y == 1).cast("long")).alias("_pos"), F.sum((y == 0).cast("long")).alias("_neg")
    )
    cuts = counts.agg(F.percentile_approx("_p", [i / cells for i in range(1, cells)], 100 * cells).alias("c")).first()["c"] or []
    below = sum(((F.col("_p") >= cut).cast("int") for cut in sorted(set(cuts))), F.lit(0))  # fewer than ``cells`` cuts
    counts = counts.withColumn("_cell", below)
    per_cell = counts.groupBy(*by, "_cell").agg(F.sum("_neg").alias("_n"))
    lower = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select(*by, "_cell", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_cell").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("_in", F.coalesce(F.sum("_neg").over(inside), F.lit(0)))
    wins = F.col("_pos") * (F.col("_base") + F.col("_in") + F.col("_neg") * F.lit(0.5))
    return local.join(offsets, [*by, "_cell"]).groupBy(*by).agg(
        F.try_divide(F.sum(wins), F.sum("_pos") * F.sum("_neg").cast("double")).alias("auc")
    )


def fold_means(folds: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean over folds of per-fold metrics."""
    return folds.groupBy(*by).agg(*[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("folds"))


def missing_profile(df: DataFrame, columns: Sequence[str], above: float = 0.0) -> DataFrame:
    """Share of missing values per column, the worst first; one aggregate for all columns."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "missing_rate").filter(F.col("missing_rate") > above)


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of known values per column."""
    wide = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "coverage")


# fixed values: confidence tiers, half-open from below so that a boundary counts once
TIERS = (("lock", 0.30, None), ("lean", 0.10, 0.30), ("tossup", 0.0, 0.10))


def tier(confidence: str | Column) -> Column:
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c >= 0.30, "lock").when(c >= 0.10, "lean").when(c >= 0.0, "tossup")


def season_metrics(picks: DataFrame) -> DataFrame:
    """Season totals, accuracies, edges and tier records, one row per season."""
    right = {k: F.sum(f"{k}_correct") for k in ("tip", "odds", "model")}
    n = F.count(F.lit(1))
    out: dict[str, Column] = {"games": n, "rounds": F.count_distinct("round")}
    for k, total in right.items():
        out[f"{k}_correct"] = total
        out[f"{k}_accuracy"] = total / n
    out["tip_vs_odds"] = right["tip"] - right["odds"]
    out["tip_vs_model"] = right["tip"] - right["model"]
    for name, *_ in TIERS:
        here = tier("confidence") == name
        games = F.count_if(here)
        tips = F.coalesce(F.sum(F.when(here, F.col("tip_correct"))), F.lit(0))
        odds = F.coalesce(F.sum(F.when(here, F.col("odds_correct"))), F.lit(0))
        out[f"{name}_games"] = games
        out[f"{name}_correct"] = tips
        out[f"{name}_accuracy"] = F.try_divide(tips, games)
        out[f"{name}_edge"] = tips - odds
    return picks.groupBy("year").agg(*[c.alias(k) for k, c in out.items()])


def recent_form(picks: DataFrame, n: int = 3) -> DataFrame:
    """Accuracy over each season's last ``n`` rounds; rounds are combined before they are ranked."""
    rounds = picks.groupBy("year", "round").agg(
        F.count(F.lit(1)).alias("games"), F.sum("tip_correct").alias("tip"), F.sum("odds_correct").alias("odds")
    )
    rank = F.dense_rank().over(Window.partitionBy("year").orderBy(F.desc("round")))
    return (
        rounds.withColumn("_k", rank)
        .filter(F.col("_k") <= n)
        .groupBy("year")
        .agg(
            (F.sum("tip") / F.sum("games")).alias("recent_accuracy"),
            (F.sum("odds") / F.sum("games")).alias("recent_odds_accuracy"),
        )
    )


def dashboard(picks: DataFrame) -> DataFrame:
    """Right decisions by category with a total row, per season."""
    return picks.rollup("year", "category").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("games"),
        F.sum("tip_correct").alias("tip_correct"),
        F.sum("odds_correct").alias("odds_correct"),
        F.sum("model_correct").alias("model_correct"),
        F.count_if(F.col("odds_pick") != F.col("model_pick")).alias("disagreements"),
        F.coalesce(
            F.sum(F.when(F.col("odds_pick") != F.col("model_pick"), F.col("model_correct"))), F.lit(0)
        ).alias("model_won"),
    )


def projection(done: Column, games: Column, total: Column) -> Column:
    """Season-end figure at the present pace, halves to even."""
    return F.bround(done / games * total)


def importance_summary(ranked: DataFrame, top_n: int) -> DataFrame:
    """Mean importance, rank statistics and how often a feature made the top."""
    return ranked.groupBy("feature").agg(
        F.avg("importance").alias("mean_importance"),
        F.avg("rank").alias("mean_rank"),
        F.min("rank").alias("best_rank"),
        F.max("rank").alias("worst_rank"),
        F.count_if(F.col("rank") <= top_n).alias("times_in_top"),
        F.count_distinct("year").alias("seasons"),
    )


def leaderboard(scores: DataFrame, low: int, high: int) -> DataFrame:
    """Totals, mean, population spread and bad/great rounds per player of a per-round table."""
    best = Window.partitionBy("year", "round")
    marked = scores.withColumn("_best", F.max("points").over(best))
    return marked.groupBy("player").agg(
        F.sum("points").alias("total"),
        F.avg("points").alias("mean_points"),
        F.stddev_pop("points").alias("spread"),
        F.count_if(F.col("points") <= low).alias("bad_rounds"),
        F.count_if(F.col("points") >= high).alias("great_rounds"),
        F.count_if(F.col("points") == F.col("_best")).alias("rounds_led"),
        F.sum("_best").alias("ceiling"),
    )


def round_duels(scores: DataFrame, rivals: Sequence[tuple[str, str]]) -> DataFrame:
    """Rounds won, lost and tied between named rivals.

    The named players' points of a round become columns of one row, so no players are paired row by
    row however many take part.
    """
    named = list(dict.fromkeys(p for pair in rivals for p in pair))
    per_round = scores.filter(F.col("player").isin(*named)).groupBy("year", "round").agg(
        *[F.max(F.when(F.col("player") == p, F.col("points"))).alias(p) for p in named]
    )
    duels = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("player"), F.lit(b).alias("opponent"), F.col(a).alias("mine"), F.col(b).alias("theirs"))
                for a, b in rivals
            ]
        )
    )
    mine, theirs = F.col("d.mine"), F.col("d.theirs")
    return per_round.select(duels.alias("d")).groupBy("d.player", "d.opponent").agg(
        F.count_if(mine > theirs).alias("won"), F.count_if(mine < theirs).alias("lost"), F.count_if(mine == theirs).alias("tied")
    )


def next_unscored_round(matches: DataFrame, now: Column) -> DataFrame:
    """Per season, the lowest round whose games are all in the past and none of which has a score."""
    rounds = matches.groupBy("year", "round").agg(
        F.max("event_date").alias("last_game"), F.count("home_score").alias("scored")
    )
    due = rounds.filter((F.col("last_game") < now) & (F.col("scored") == 0))
    return due.groupBy("year").agg(F.min("round").alias("next_round"))


def versus_baseline(results: DataFrame, baseline: str, measure: str = "log_loss") -> DataFrame:
    """Result table with the difference to a named baseline row (a scalar subquery) and a marker."""
    reference = results.filter(F.col("model") == baseline).agg(F.min(measure).alias("b")).select("b").scalar()
    out = results.withColumn("delta", F.col(measure) - reference)
    return out.withColumn("beats_baseline", F.col("delta") < 0)
