"""Strategy and blend evaluation: fixed grids exploded per row and combined before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.operators.decisions import adjusted_probability, net_shift
from duelframe.operators.metrics import log_loss_of


def strategy_probabilities(locks: Sequence[float] = (0.60, 0.65, 0.70)) -> dict[str, Column]:
    """Every strategy as a probability expression over model, market, opening and closing prices."""
    m, o, opened, closed = (F.col(c) for c in ("model_prob", "odds_prob", "open_prob", "close_prob"))
    sure = F.abs(o - 0.5) * 2
    out: dict[str, Column] = {"favourite": o, "model": m}
    for w in (0.10, 0.20, 0.30, 0.40, 0.495, 0.60, 0.70):
        out[f"blend_{w}"] = F.lit(w) * m + F.lit(1.0 - w) * o
    for lock in locks:
        out[f"tiered_{lock}"] = F.when(sure >= (lock - 0.5) * 2, o).otherwise(0.70 * m + 0.30 * o)
    start = 0.495 * m + 0.505 * opened
    out["open_blend"] = F.when(closed.isNotNull(), start)
    for lock in (0.55, 0.60, 0.65):
        near = F.abs(start - 0.5) * 2 < (lock - 0.5) * 2
        out[f"late_{lock}"] = F.when(closed.isNotNull(), F.when(near, 0.495 * m + 0.505 * closed).otherwise(start))
    for base, close in ((0.30, 0.70), (0.20, 0.60), (0.10, 0.80)):
        w = F.lit(close) - F.lit(close - base) * sure
        out[f"adaptive_{base}_{close}"] = w * m + (1.0 - w) * o
    return out


def strategy_record(picks: DataFrame, strategies: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Right decisions per strategy (and group): one pass, one row per strategy and task shuffled."""
    options = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), p.alias("p")) for n, p in strategies.items()]))
    long = picks.select(*by, "home_win", options.alias("_s")).filter(F.col("_s.p").isNotNull())
    right = ((F.col("_s.p") >= 0.5) == (F.col("home_win") == 1)).cast("long")
    return long.groupBy(*by, F.col("_s.strategy").alias("strategy")).agg(
        F.sum(right).alias("correct"), F.count(F.lit(1)).alias("games")
    )


def tier_record(picks: DataFrame) -> DataFrame:
    """Record of the pickers by how sure the market is."""
    sure = F.greatest(F.col("odds_prob"), 1 - F.col("odds_prob"))
    tier = F.when(sure >= 0.65, "LOCK").when(sure >= 0.55, "LEAN").otherwise("TOSS-UP")
    return picks.groupBy(tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("games"),
        *[F.sum(f"{k}_correct").alias(f"{k}_correct") for k in ("odds", "model", "tip")],
    )


def disagreements(picks: DataFrame) -> DataFrame:
    """Who is right when model and market disagree, by the size of the disagreement."""
    gap = F.abs(F.col("model_prob") - F.col("odds_prob"))
    size = F.when(gap < 0.05, "slight").when(gap < 0.10, "moderate").otherwise("strong")
    return (
        picks.filter((F.col("model_prob") >= 0.5) != (F.col("odds_prob") >= 0.5))
        .groupBy(size.alias("size"))
        .agg(
            F.count(F.lit(1)).alias("games"),
            F.sum("odds_correct").alias("odds_right"),
            F.sum("model_correct").alias("model_right"),
        )
    )


def late_prices(picks: DataFrame, thresholds: Sequence[float] = (0.52, 0.53, 0.54, 0.55, 0.57, 0.60, 0.65)) -> DataFrame:
    """Opening against closing favourite, per season and selective threshold: right decisions, flips
    and right flips, drift-only decisions, and moves towards the winner."""
    o, c = F.col("open_prob"), F.col("close_prob")
    won = F.col("home_win") == 1
    t = F.col("_t")
    near = o.between(1 - t, t)
    open_home, close_home = o >= 0.5, c >= 0.5
    chosen = F.when(near, close_home).otherwise(open_home)
    drift = F.signum(o - 0.5) != F.signum(c - 0.5)
    drifted = F.when(drift, close_home).otherwise(open_home)
    move = c - o
    rows = picks.filter(o.isNotNull() & c.isNotNull()).withColumn("_t", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    return rows.groupBy("year", t.alias("threshold")).agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(open_home == won).alias("open_correct"),
        F.count_if(close_home == won).alias("close_correct"),
        F.count_if(chosen == won).alias("selective_correct"),
        F.count_if(chosen != open_home).alias("flips"),
        F.count_if((chosen != open_home) & (chosen == won)).alias("right_flips"),
        F.count_if(drifted == won).alias("drift_correct"),
        F.count_if(F.abs(move) > 0.02).alias("moved"),
        F.count_if((F.abs(move) > 0.02) & ((move > 0) == won)).alias("moved_to_winner"),
        F.count_if(near).alias("close_games"),
    )


def lineup_grid(games: DataFrame, caps: Sequence[float], guards: Sequence[float]) -> DataFrame:
    """Line-up adjustment over caps and swing guards: right decisions against the base, swings, and
    whether the shift pointed to the winner. ``games`` holds base_prob, home_raw, away_raw, home_win."""
    grid = F.explode(F.array(*[F.struct(F.lit(c).alias("cap"), F.lit(g).alias("guard")) for c in caps for g in guards]))
    df = games.withColumn("_g", grid)
    shift = net_shift("home_raw", "away_raw", F.col("_g.cap"))
    base_home = F.col("base_prob") >= 0.5
    new_home = adjusted_probability(F.col("base_prob"), shift) >= 0.5
    swings = new_home != base_home
    blocked = swings & (F.abs(F.col("base_prob") - 0.5) * 2 > F.col("_g.guard"))
    final = F.when(blocked, base_home).otherwise(new_home)
    won = F.col("home_win") == 1
    moved = F.abs(shift) > 0.001
    return df.groupBy(F.col("_g.cap").alias("cap"), F.col("_g.guard").alias("guard")).agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(base_home == won).alias("base_correct"),
        F.count_if(final == won).alias("adjusted_correct"),
        F.count_if(swings & ~blocked).alias("swings"),
        F.count_if(swings & ~blocked & (final == won)).alias("right_swings"),
        F.count_if(moved).alias("moved"),
        F.count_if(moved & ((shift > 0) == won)).alias("right_direction"),
    )


def blend_losses(oof: DataFrame, first: int = 5, last: int = 495, step: int = 5) -> DataFrame:
    """Log loss per model, fold and blend weight (in thousandths) of model and market."""
    weights = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step)))
    grid = oof.select("model", "fold", "label", "prob", "market", weights.alias("w"))
    p = F.col("w") / F.lit(1000.0) * F.col("prob") + (1 - F.col("w") / F.lit(1000.0)) * F.col("market")
    return grid.groupBy("model", "fold", "w").agg(F.avg(log_loss_of(p, F.col("label"))).alias("log_loss"))


def best_blend(losses: DataFrame) -> DataFrame:
    """Per model the weight with the smallest mean of the per-fold losses."""
    means = losses.groupBy("model", "w").agg(F.avg("log_loss").alias("log_loss"))
    return means.groupBy("model").agg(
        F.min_by("w", F.struct("log_loss", "w")).alias("weight"), F.min("log_loss").alias("log_loss")
    )


def walk_forward_weights(losses: DataFrame, default: int = 150, warm_up: int = 2) -> DataFrame:
    """Per model and fold the best weight on earlier folds only; the first folds use a default.

    The loss table has one row per (model, weight, fold), so its windows are small whatever the
    number of games.
    """
    order = Window.partitionBy("model", "w").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    earlier = losses.withColumn("_so_far", F.avg("log_loss").over(order))
    nth = F.dense_rank().over(Window.partitionBy("model").orderBy("fold"))
    best = (
        earlier.withColumn("_nth", nth)
        .groupBy("model", "fold")
        .agg(F.min("_nth").alias("_nth"), F.min_by("w", F.struct("_so_far", "w")).alias("_w"))
    )
    return best.select(
        "model", "fold", F.when(F.col("_nth") <= warm_up, F.lit(default)).otherwise(F.col("_w")).alias("weight")
    )


def walk_forward_blend(oof: DataFrame, weights: DataFrame) -> DataFrame:
    """Out-of-fold blended probability at each fold's own weight."""
    w = F.col("weight") / F.lit(1000.0)
    return oof.join(weights, ["model", "fold"]).select(
        "model", "fold", "match_id", "label", "weight", (w * F.col("prob") + (1 - w) * F.col("market")).alias("prob")
    )


def model_averages(oof: DataFrame, combos: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean probability of several models per match, as a new model of the long table."""
    belongs = F.explode(
        F.filter(
            F.array(*[F.when(F.col("model").isin(*members), F.lit(name)) for name, members in combos.items()]),
            lambda x: x.isNotNull(),
        )
    )
    return oof.select("match_id", "fold", "label", "market", "prob", belongs.alias("model")).groupBy(
        "model", "match_id", "fold"
    ).agg(F.avg("prob").alias("prob"), F.first("market").alias("market"), F.first("label").alias("label"))


def multi_blend(wide: DataFrame, models: Sequence[str], market: str = "market", coarse: int = 10, fine: int = 50) -> DataFrame:
    """Weights of several models and the market on a simplex grid, refined around the best coarse point.

    Two aggregates over fixed literal grids; only the winning coarse point comes to the driver.
    """

    def combos(k: int, total: int) -> list[tuple[int, ...]]:
        if k == 0:
            return [()]
        return [(i, *rest) for i in range(total + 1) for rest in combos(k - 1, total - i)]

    def losses(points: Sequence[tuple[int, ...]], unit: int) -> DataFrame:
        grid = F.explode(F.array(*[F.struct(*[F.lit(x).alias(m) for x, m in zip(point, models)]) for point in points]))
        df = wide.select("fold", "label", market, *models, grid.alias("_w"))
        used = sum((F.col(f"_w.{m}") for m in models), F.lit(0))
        p = (F.lit(unit) - used) / F.lit(float(unit)) * F.col(market)
        for m in models:
            p = p + F.col(f"_w.{m}") / F.lit(float(unit)) * F.col(m)
        folds = df.groupBy("_w", "fold").agg(F.avg(log_loss_of(p, F.col("label"))).alias("ll"))
        return folds.groupBy("_w").agg(F.avg("ll").alias("log_loss"))

    best = losses(combos(len(models), coarse), coarse).orderBy("log_loss", "_w").first()["_w"]
    scale = fine // coarse
    centre = [best[m] * scale for m in models]
    near = [
        point
        for point in combos(len(models), fine)
        if all(abs(x - c) <= scale for x, c in zip(point, centre))
    ]
    return losses(near, fine).orderBy("log_loss", "_w").limit(1).select(
        *[(F.col(f"_w.{m}") / F.lit(float(fine))).alias(f"weight_{m}") for m in models], "log_loss"
    )
