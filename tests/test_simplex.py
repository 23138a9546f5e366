"""Blend weights on the simplex beside plain EM and grids."""

import math
import random

import numpy as np
import pytest

from duelframe.operators.simplex import blended, newton_on_simplex, simplex_weights


def games(seed, folds=5, n=60, skill=(0.6, 0.3, 0.0)):
    rng = random.Random(seed)
    out = []
    for fold in range(2001, 2001 + folds):
        for _ in range(n + rng.randint(0, 30)):
            x = rng.gauss(0, 1.2)
            prob = lambda s, x=x: 1 / (1 + math.exp(-(s * x + (1 - s) * rng.gauss(0, 1))))
            out.append((fold, int(rng.random() < 1 / (1 + math.exp(-x))), prob(0.5), *[prob(s) for s in skill]))
    return out


def plain_em(rows, folds, steps=20_000):
    """Weights that EM reaches for the mean of the folds' mean losses."""
    kept = [r for r in rows if r[0] in folds]
    hit = np.array([[p if r[1] else 1 - p for p in (*r[3:], r[2])] for r in kept])
    share = np.array([1 / len(folds) / sum(x[0] == r[0] for x in kept) for r in kept])
    w = np.full(hit.shape[1], 1 / hit.shape[1])
    for _ in range(steps):
        r = hit * w
        w = (share[:, None] * r / r.sum(1, keepdims=True)).sum(0)
    return w, float(-(share * np.log(hit @ w)).sum())


SCHEMA = "fold int, label int, market double, a double, b double, c double"


def test_weights_are_those_of_em(spark):
    rows = games(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    odd = spark.createDataFrame([(None, 1, 0.5, 0.5, 0.5, 0.5), (2001, None, 0.5, 0.5, 0.5, 0.5), (2001, 1, None, 0.5, 0.5, 0.5)], SCHEMA)
    found = simplex_weights(df.union(odd), ["a", "b", "c"]).collect()
    assert len(found) == 1 and found[0].fold is None
    w, loss = plain_em(rows, {r[0] for r in rows})
    assert found[0].log_loss == pytest.approx(loss, abs=1e-9)
    assert [found[0][f"weight_{m}"] for m in ("a", "b", "c", "market")] == pytest.approx(w.tolist(), abs=1e-4)


def test_walk_forward_uses_earlier_folds_only(spark):
    rows = games(4)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.fold: r for r in simplex_weights(df, ["a", "b", "c"], walk_forward=True).collect()}
    assert sorted(found) == [2001, 2002, 2003, 2004, 2005]
    for fold, r in found.items():
        seen = [r[f"weight_{m}"] for m in ("a", "b", "c", "market")]
        assert sum(seen) == pytest.approx(1) and min(seen) >= 0
        if fold < 2003:
            assert seen == pytest.approx([0.05, 0.05, 0.05, 0.85]) and r.log_loss is None
        else:
            w, loss = plain_em(rows, set(range(2001, fold)))
            assert r.log_loss == pytest.approx(loss, abs=1e-9) and seen == pytest.approx(w.tolist(), abs=1e-4)
    changed = spark.createDataFrame([(f, 1 - y if f == 2005 else y, *p) for f, y, *p in rows], SCHEMA)
    again = {r.fold: r for r in simplex_weights(changed, ["a", "b", "c"], walk_forward=True).collect()}
    assert again == found
    out = blended(df, simplex_weights(df, ["a", "b", "c"], walk_forward=True), ["a", "b", "c"]).collect()
    assert len(out) == len(rows)
    assert all(r.prob == pytest.approx(sum(found[r.fold][f"weight_{m}"] * r[m] for m in ("a", "b", "c", "market"))) for r in out)


def test_nine_models_and_equal_columns(spark):
    rng = random.Random(5)
    names = [f"m{i}" for i in range(9)]
    rows = [(1 + i % 3, int(rng.random() < 0.5 + 0.3 * x), 0.5, *[0.5 + 0.3 * x * (j == 4) + 0.1 * rng.uniform(-1, 1) for j in range(8)]) for i, x in ((i, rng.uniform(-1, 1)) for i in range(600))]
    rows = [(*r, r[-1]) for r in rows]  # the last two models are equal: many weights are best
    df = spark.createDataFrame(rows, "fold int, label int, market double, " + ", ".join(f"{m} double" for m in names))
    r = simplex_weights(df, names).first()
    seen = [r[f"weight_{m}"] for m in [*names, "market"]]
    assert sum(seen) == pytest.approx(1) and min(seen) >= 0 and seen[4] > 0.5
    hit = np.array([[p if x[1] else 1 - p for p in (*x[3:], x[2])] for x in rows])
    share = np.array([1 / 3 / sum(y[0] == x[0] for y in rows) for x in rows])
    slope = -(share[:, None] * hit / (hit @ np.array(seen))[:, None]).sum(0)
    assert slope.min() >= -1 - 1e-6  # no direction on the simplex lowers the loss
    assert simplex_weights(df.limit(0), names).count() == 0 and simplex_weights(df.limit(0), names, walk_forward=True).count() == 0


def test_certain_and_wrong_probabilities_are_clipped(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 0, 1.0, 0.0), (1, 1, 0.5, 0.0)], "fold int, label int, market double, a double")
    r = simplex_weights(df, ["a"]).first()
    assert math.isfinite(r.log_loss) and 0 < r.weight_a < 1


def test_newton_step_stays_on_the_simplex():
    rng = np.random.default_rng(2)
    for _ in range(200):
        k = int(rng.integers(1, 8))
        w = rng.dirichlet(np.ones(k)) * (rng.random(k) < 0.8)
        w = w / w.sum() if w.sum() else np.eye(k)[0]
        a, g = rng.normal(size=(k + 2, k)), rng.normal(size=k)
        h = a.T @ a
        x = newton_on_simplex(w, g, h)
        assert x.sum() == pytest.approx(1) and x.min() >= 0
        slope = g + h @ (x - w)
        assert slope.min() >= (slope @ x) - 1e-8 * (1 + abs(slope).max())
