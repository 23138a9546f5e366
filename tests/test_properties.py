"""Properties every result must have, whatever the data."""

import pytest
from conftest import same
from pyspark.sql import functions as F

from duelframe.operators import ratings as R, sinks as K, strategies as S, windows as W
from duelframe.operators.history import measure
from duelframe.operators.sides import from_sides, team_log
from duelframe.plans.backtest import calibrated, stacked, Dataset, ScaledLogistic, boosted, fold_scores, invalidate_stale, load_artifacts, fingerprint, save_artifacts, score, train_final, walk_forward
from duelframe.plans.decision_queries import oof
from duelframe.sources import adapters as A


def form(m):
    df = team_log(m)
    layout = measure(df, ["entity_id"])
    return from_sides(W.streak(W.rolling_form(df, layout), layout), ["win_rate_5", "avg_margin_8", "streak"])


def test_no_look_ahead(spark, sf):
    """Changing every result from a date on leaves all features up to that date untouched."""
    m = A.matches(spark, sf)
    cut = F.col("event_date") >= F.lit("1999-01-01").cast("date")
    changed = m.withColumn("home_score", F.when(cut, F.col("home_score") + 7).otherwise(F.col("home_score")))
    before = m.filter("event_date < date'1999-01-01'").select("match_id")
    same(form(m).join(before, "match_id"), form(changed).join(before, "match_id"))
    rated = lambda x: R.rating_features(R.rate(x)).join(before, "match_id")
    same(rated(m), rated(changed))


def test_input_order_does_not_matter(spark, sf):
    m = A.matches(spark, sf)
    same(form(m), form(m.orderBy(F.xxhash64("match_id")).repartition(7)))


def test_swapping_sides_swaps_features(spark, sf):
    m = A.matches(spark, sf)

    def turn(df, pairs):
        new = {a: b for x, y in pairs for a, b in ((x, y), (y, x))}
        return df.select(*[F.col(new.get(c, c)).alias(c) for c in df.columns])

    turned = turn(m, [("home_id", "away_id"), ("home_score", "away_score")])
    values = ("win_rate_5", "avg_margin_8", "streak")
    same(turn(form(m), [(f"home_{v}", f"away_{v}") for v in values]), form(turned))


def test_rating_sum_is_conserved_within_a_season(spark, sf):
    history = R.rating_history(R.rate(A.matches(spark, sf), [R.RatingParams(keep=1.0)]))
    moved = history.groupBy("match_id").agg(F.sum(F.col("rating_after") - F.col("rating_before")).alias("d"))
    assert moved.agg(F.max(F.abs("d"))).first()[0] < 1e-9


def test_rating_continues_from_saved_state(spark, sf):
    m = A.matches(spark, sf)
    whole = R.rate(m)
    early, late = m.filter("year < 1999"), m.filter("year >= 1999")
    state = R.saved_ratings(R.rate(early), early)
    resumed = R.rate(late, saved=state)
    kept = late.select("match_id")
    same(whole.join(kept, "match_id").select("match_id", "home_elo", "away_elo"), resumed.select("match_id", "home_elo", "away_elo"))


def test_blend_at_weight_zero_is_the_market(spark, sf):
    long = oof(spark, sf)
    at_zero = S.blend_losses(long, 0, 0).select("fold", F.round("log_loss", 9).alias("l")).distinct()
    assert at_zero.count() == long.select("fold").distinct().count()


def test_upsert_twice_is_upsert_once(spark, sf, tmp_path):
    m = A.matches(spark, sf).select("match_id", "year", "round", "home_score")
    path = str(tmp_path / "t")
    K.write_table(m, path, ("year", "round"))
    batch = m.filter("year = 1998 and round = 2").withColumn("home_score", F.lit(99))
    K.replace_periods(batch, path)
    once = spark.createDataFrame(spark.read.parquet(path).select(m.columns).collect(), m.schema)
    K.replace_periods(batch, path)
    same(once, spark.read.parquet(path).select(m.columns))
    same(once, K.replaced(m, batch, ["year", "round"]))


def signal(spark, n=1200):
    """A table whose outcome follows one feature and the market, the other feature being noise."""
    h = lambda s: (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / F.lit(1000.0))
    df = spark.range(n).select(
        F.col("id").alias("match_id"), (2001 + F.col("id") % 4).cast("int").alias("year"), h(1).alias("strength"), h(2).alias("noise"), (0.3 + 0.4 * h(3)).alias("market_p"), h(4).alias("u")
    )
    return df.withColumn("home_win", (F.col("u") < 0.15 + 0.7 * F.col("strength")).cast("int"))


def test_models_beat_a_constant_and_survive_storage(spark, tmp_path):
    data = Dataset.build(signal(spark), ["strength", "noise"], "market_p")
    oof_ = walk_forward(data, {"logistic": ScaledLogistic(), "boosted": boosted(3, 8)}, (2003, 2004))
    got = {r["model"]: r["log_loss"] for r in fold_scores(oof_).collect()}
    assert got["logistic"] < 0.67 and got["boosted"] < 0.68 < got["market"] + 0.1
    trained = train_final(data, 1, boosted(2, 4))
    assert trained.features == ["strength"]
    digest = fingerprint(data.df, ["match_id", "label"])
    path = str(tmp_path / "artifacts")
    assert load_artifacts(spark, path) is None
    save_artifacts(trained, path, digest)
    stored = load_artifacts(spark, path, digest)
    same(score(trained, data.df), score(stored, data.df))
    changed = fingerprint(data.df.filter("match_id < 10"), ["match_id", "label"])
    assert load_artifacts(spark, path, changed) is None
    assert invalidate_stale(spark, [path], digest) == []
    assert invalidate_stale(spark, [path], changed) == [path]
    assert load_artifacts(spark, path) is None


def test_calibration_and_stacking_keep_the_signal(spark):
    data = Dataset.build(signal(spark), ["strength", "noise"], "market_p")
    oof_ = walk_forward(data, {"logistic": ScaledLogistic()}, (2002, 2003, 2004))
    fixed = calibrated(oof_)
    assert fixed.count() == oof_.count()
    low, high = fixed.filter("model <> 'market' and fold > 2002").selectExpr("min(prob)", "max(prob)").first()
    assert 0.01 <= low and high <= 0.99
    scores = {r["model"]: r["log_loss"] for r in fold_scores(stacked(oof_, ["logistic"]).filter("fold > 2002")).collect()}
    assert scores["stack"] < 0.67


def test_auc_of_crowded_scores(spark):
    """Scores between 0.5 and 0.501 spread over slices, and the area is that of all pairs."""
    import random

    from duelframe.operators.metrics import auc

    rng = random.Random(6)
    rows = [(g, 0.5 + rng.randint(0, 300) * 1e-3 / 300, rng.randint(0, 1)) for g in (1, 2) for _ in range(400)] + [(3, 0.7, 1), (3, None, 0), (1, 0.9, None)]
    df = spark.createDataFrame(rows, "g int, prob double, label int")
    found = {r.g: r.auc for r in auc(df.where("prob IS NOT NULL"), ["g"]).collect()}
    for g in (1, 2):
        pos, neg = ([p for h, p, y in rows if h == g and y == k] for k in (1, 0))
        assert found[g] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    assert found[3] is None
    text = auc(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text
