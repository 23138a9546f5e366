"""Blend weights of several models and the market on the simplex, by convex passes over the data.

A blend's probability of what happened is a weighted mean of its members' probabilities, so the mean
log loss is convex in the weights. Each pass is one map-side sum: every task reduces its rows to the
loss, its gradient and its curvature per season and target, and only those (seasons x targets x members
squared numbers, whatever the input) reach the driver, where a Newton step that keeps weights on the
simplex is taken. Ten or so passes settle; all walk-forward targets are fitted in the same passes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from duelframe.operators.metrics import CLIP
from duelframe.session import cut_lineage

# the sums travel with their code, so workers need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def newton_on_simplex(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """The weights that minimise the quadratic model at ``w``, none negative, summing to one.

    An active-set walk: solve on the free weights; a weight that would turn negative stops the walk at
    zero and is held, a held weight that would lower the value is freed.
    """
    k = len(w)
    curvature = curvature + np.eye(k) * 1e-12 * max(1.0, float(np.trace(curvature)))
    linear = gradient - curvature @ w
    x, free = w.copy(), w > 0
    for _ in range(8 * k):
        at = np.flatnonzero(free)
        system = np.zeros((len(at) + 1, len(at) + 1))
        system[:-1, :-1] = curvature[np.ix_(at, at)]
        system[-1, :-1] = system[:-1, -1] = 1.0
        solved = np.linalg.lstsq(system, np.append(-linear[at], 1.0), rcond=None)[0]
        goal, level = np.zeros(k), solved[-1]
        goal[at] = solved[:-1]
        if goal.min() < 0:
            falling = np.flatnonzero(goal < 0)
            share = x[falling] / (x[falling] - goal[falling])
            first = falling[share.argmin()]
            x = np.maximum(x + share.min() * (goal - x), 0)
            x[first], free[first] = 0.0, False
            continue
        x = goal
        pull = linear + curvature @ x + level
        pull[free] = 0
        if pull.min() >= -1e-13:
            break
        free[pull.argmin()] = True
    return x / x.sum()


def _sums(columns: list[str], weights: np.ndarray, used: np.ndarray):
    """Loss, gradient and curvature per (fold, target) of a task's rows, as one flat vector each."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, label = batch.column("_fold").to_numpy(), batch.column("label").to_numpy()
            prob = np.column_stack([batch.column(c).to_numpy() for c in columns])
            hit = np.clip(np.where(label[:, None] == 1, prob, 1 - prob), CLIP, 1 - CLIP)
            for f in np.unique(fold).tolist():
                rows = hit[fold == f]
                for t in np.flatnonzero(used[:, f]).tolist():
                    mixed = rows @ weights[t]
                    ratio = rows / mixed[:, None]
                    found = np.concatenate([[len(rows), -np.log(mixed).sum()], -ratio.sum(0), (ratio.T @ ratio).ravel()])
                    held[f, t] = held[f, t] + found if (f, t) in held else found
        if held:
            keys = list(held)
            yield pa.RecordBatch.from_pydict(
                {"fold": pa.array([f for f, _ in keys], pa.int32()), "target": pa.array([t for _, t in keys], pa.int32()), "sums": pa.array([held[k].tolist() for k in keys], pa.list_(pa.float64()))}
            )

    return over


def _pass(rows: DataFrame, columns: list[str], weights: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean over each target's folds of their mean loss, its gradient and its curvature."""
    k = len(columns)
    parts = rows.mapInArrow(_sums(columns, weights, used), "fold int, target int, sums array<double>")
    totals = parts.select("fold", "target", F.posexplode("sums").alias("at", "v")).groupBy("fold", "target", "at").agg(F.sum("v").alias("v")).collect()
    found = np.zeros((*used.shape, 2 + k + k * k))
    for r in totals:  # folds x targets x members squared
        found[r.target, r.fold, r.at] = r.v
    n = np.maximum(found[:, :, :1], 1)
    mean = np.where(used[:, :, None], found[:, :, 1:] / n, 0).sum(1) / np.maximum(used.sum(1), 1)[:, None]
    return mean[:, 0], mean[:, 1 : 1 + k], mean[:, 1 + k :].reshape(-1, k, k)


def simplex_weights(
    wide: DataFrame, models: Sequence[str], market: str = "market", walk_forward: bool = False, warm_up: int = 2, warm_weight: float = 0.15, passes: int = 60, settled: float = 1e-11
) -> DataFrame:
    """``fold, weight_<model> ..., weight_market, log_loss``: the best weights in-sample, or per fold.

    ``wide(fold, label, <market>, <models>)`` holds one row per match; rows with a null label, fold or
    probability are left out. In-sample there is one row, with a null fold, fitted on the mean of all
    folds' mean losses. With ``walk_forward`` each fold is fitted on the folds before it; the first
    ``warm_up`` folds share ``warm_weight`` equally among the models, and have no loss to report. A table
    without such rows gives no weights.
    """
    spark, columns = wide.sparkSession, [*models, market]
    k = len(columns)
    kept = wide.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ["fold", "label", *columns]))
    narrow = cut_lineage(kept.select("fold", F.col("label").cast("int").alias("label"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]))
    folds = [r.fold for r in narrow.select("fold").distinct().orderBy("fold").collect()]  # seasons
    place = F.lit(-1)
    for i, fold in enumerate(folds):
        place = F.when(F.col("fold") == fold, i).otherwise(place)
    rows = narrow.withColumn("_fold", place.cast("int"))
    names = [f"_{i}" for i in range(k)]
    warm = np.append(np.full(k - 1, warm_weight / max(1, k - 1)), 1 - warm_weight if k > 1 else 1.0)
    if walk_forward:
        targets = list(range(warm_up, len(folds)))
        used = np.array([[f < t for f in range(len(folds))] for t in targets], bool).reshape(len(targets), len(folds))
    else:
        targets = [None] if folds else []
        used = np.ones((len(targets), len(folds)), bool)
    w = np.full((len(targets), k), 1.0 / k)
    best, loss = w.copy(), np.full(len(targets), np.inf)
    open_ = np.ones(len(targets), bool)
    for _ in range(passes if targets else 0):
        value, gradient, curvature = _pass(rows, names, w, used & open_[:, None])
        for t in np.flatnonzero(open_):
            if value[t] > loss[t] + 1e-15:  # the model was too bold: halve the step
                w[t] = (best[t] + w[t]) / 2
                if np.abs(w[t] - best[t]).max() < settled:
                    open_[t] = False
                continue
            best[t], loss[t] = w[t], value[t]
            w[t] = newton_on_simplex(w[t], gradient[t], curvature[t])
            open_[t] = np.abs(w[t] - best[t]).max() >= settled
        if not open_.any():
            break
    found = [(folds[t] if t is not None else None, *best[i].tolist(), float(loss[i])) for i, t in enumerate(targets)]
    if walk_forward:
        found = [(f, *warm.tolist(), None) for f in folds[:warm_up]] + found
    fold_type = wide.schema["fold"].dataType.simpleString()
    return spark.createDataFrame(found, f"fold {fold_type}, " + ", ".join(f"weight_{m} double" for m in [*models, "market"]) + ", log_loss double")


def blended(wide: DataFrame, weights: DataFrame, models: Sequence[str], market: str = "market") -> DataFrame:
    """``wide`` with ``prob``, blended by the weights of its fold, or by the one row without a fold."""
    everywhere = weights.where("fold IS NULL").first()
    names = [f"weight_{m}" for m in [*models, "market"]]
    if everywhere is not None:
        prob = sum((F.lit(everywhere[n]) * F.col(c) for n, c in zip(names, [*models, market], strict=True)), F.lit(0.0))
        return wide.withColumn("prob", prob)
    own = [f"_w_{i}" for i in range(len(names))]
    told = weights.select(F.col("fold").alias("_for"), *[F.col(n).alias(o) for n, o in zip(names, own, strict=True)])
    joined = wide.join(F.broadcast(told), F.col("_for") == F.col("fold"))  # one row a season
    prob = sum((F.col(o) * F.col(c) for o, c in zip(own, [*models, market], strict=True)), F.lit(0.0))
    return joined.select(*[wide[c] for c in wide.columns], prob.alias("prob"))
