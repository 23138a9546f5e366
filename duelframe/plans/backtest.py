"""Walk-forward training, selection, calibration and stacking on MLlib.

Every fitted step (imputation, scaling, selection, model, calibration, stacking) sees only seasons
before the one it scores. Folds are filters on one assembled table that is cut from its lineage
once; a fold's rows are never brought to the driver. Fits do not depend on each other, so a few run
at a time, as many as have room: a fit keeps its training rows in memory, and what does not fit there
goes to disk.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelframe.operators.imputation import FLAG_COLUMNS, clamp_openers, coherent_prices, exact_medians, recency_weight, sliced_medians
from duelframe.operators.metrics import fold_means, log_loss_of, probability_metrics
from duelframe.operators.sinks import multiset_digest
from duelframe.session import cut_lineage_by

Factory = Callable[[str], Estimator]
#: Fits that run at the same time, and the training rows per core that they may have together.
FITS_AT_ONCE, ROWS_PER_CORE = 4, 2_500_000


class _Room:
    """Lets fits in while their rows together stay within ``most``; a larger fit runs alone."""

    def __init__(self, most: int):
        self.most, self.taken, self.changed = most, 0, threading.Condition()

    @contextmanager
    def beside_others(self, rows: int) -> Iterator[None]:
        with self.changed:
            self.changed.wait_for(lambda: not self.taken or self.taken + rows <= self.most)
            self.taken += rows
        try:
            yield
        finally:
            with self.changed:
                self.taken -= rows
                self.changed.notify_all()


def _concurrently(work: Callable, items: Iterable, spark: SparkSession, rows: Callable[..., int] = lambda item: 0) -> list:
    """Results of independent Spark jobs, in the order of ``items``; ``rows`` tells how many rows one is fitted on."""
    room = _Room(ROWS_PER_CORE * spark.sparkContext.defaultParallelism)

    def in_turn(item):
        with room.beside_others(max(1, rows(item))):
            return work(item)

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(in_turn), items))


def market_model(df: DataFrame, prob: str, default: float = 0.55) -> DataFrame:
    """The market as a model of the long table; a missing price is the usual home-win rate."""
    return df.withColumns({"model": F.lit("market"), "prob": F.coalesce(F.col(prob), F.lit(default))})


def boosted(depth: int = 4, rounds: int = 20, step: float = 0.1, share: str = "all", rate: float = 0.8) -> Factory:
    """Weighted gradient-boosted trees."""
    return lambda features: GBTClassifier(
        featuresCol=features, labelCol="label", weightCol="weight", maxDepth=depth, maxIter=rounds, stepSize=step,
        featureSubsetStrategy=share, subsamplingRate=rate, seed=7,
    )


def forest(trees: int = 40, depth: int = 6) -> Factory:
    return lambda features: RandomForestClassifier(
        featuresCol=features, labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth,
        featureSubsetStrategy="sqrt", minInstancesPerNode=25, seed=7,
    )


class ScaledLogistic:
    """Standardised logistic regression; the penalty is set per training slice from its total weight."""

    def __init__(self, c: float = 1.0):
        self.c = c

    def stages(self, features: str, total_weight: float) -> list[Estimator]:
        scaler = StandardScaler(inputCol=features, outputCol="scaled", withMean=True, withStd=True)
        model = LogisticRegression(
            featuresCol="scaled", labelCol="label", weightCol="weight", regParam=1.0 / (self.c * max(total_weight, 1.0)), standardization=False
        )
        return [scaler, model]


MODELS: dict[str, Factory | ScaledLogistic] = {
    "boosted_shallow": boosted(3, 20),
    "boosted_deep": boosted(5, 15),
    "boosted_sqrt": boosted(4, 20, share="sqrt"),
    "forest": forest(),
    "logistic": ScaledLogistic(),
}


@dataclass
class Dataset:
    """Assembled feature table: ids, season, label, market probability, weight and features."""

    df: DataFrame
    features: list[str]
    seasons: list[int] = field(default_factory=list)
    #: Rows per season, where they were counted.
    sizes: dict[int, int] = field(default_factory=dict, repr=False, compare=False)
    #: Medians found so far of the seasons before one, by season and feature.
    known: dict[int, dict[str, float | None]] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def build(
        cls, df: DataFrame, features: Sequence[str], market: str, decay: float = 0.92, drop_undecided: bool = True
    ) -> Dataset:
        """Draws and unplayed games leave the training data; prices are filled coherently first."""
        prepared = coherent_prices(clamp_openers(df))
        rows = prepared.select(
            "match_id",
            F.col("year").alias("season"),
            F.col("home_win").cast("double").alias("label"),
            F.coalesce(F.col(market), F.lit(0.55)).alias("market"),
            *[F.col(c).cast("double").alias(c) for c in features],
        )
        if drop_undecided:
            rows = rows.filter(F.col("label").isNotNull())
        rows = cut_lineage_by(recency_weight(rows, decay, "season"), "season")
        sizes = {r["season"]: r["count"] for r in rows.groupBy("season").count().orderBy("season").collect()}  # one per year
        return cls(rows, list(features), list(sizes), sizes)

    def only(self, features: Sequence[str]) -> Dataset:
        """The same rows with a column mask, for ablations and sweeps."""
        return Dataset(self.df, list(features), self.seasons, self.sizes, self.known)

    def rows_before(self, season: int) -> int:
        return sum(n for s, n in self.sizes.items() if s is not None and s < season)

    def medians_before(self, folds: Sequence[int]) -> dict[int, dict[str, float | None]]:
        """Exact medians of the seasons before each fold's, for all folds in the same passes and once for all masks."""
        missing = [c for c in self.features if any(c not in self.known.get(s, {}) for s in folds)]
        if missing:
            earlier = {s: [e for e in self.seasons if e is not None and e < s] for s in folds}
            for s, found in sliced_medians(self.df, missing, F.col("season"), earlier).items():
                self.known.setdefault(s, {}).update(found)
        return {s: {c: self.known[s][c] for c in self.features} for s in folds}


def median_fill(train: DataFrame, features: Sequence[str]) -> SQLTransformer:
    """Fills gaps of each feature with its exact median in the training slice, in a column named ``_feature``.

    Flags, and features without any value in the slice, are filled with 0. NaN and infinities are gaps.
    """
    return filler(exact_medians(train, features))


def filler(medians: Mapping[str, float | None]) -> SQLTransformer:
    """``median_fill`` with medians that are known."""
    fills = {c: 0.0 if c in FLAG_COLUMNS or m is None else m for c, m in medians.items()}
    filled = [f"coalesce(if(abs(`{c}`) < double('inf'), `{c}`, NULL), double('{v!r}')) AS `_{c}`" for c, v in fills.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def _fit(train: DataFrame, features: Sequence[str], model: Factory | ScaledLogistic, fill: SQLTransformer | None = None) -> PipelineModel:
    """Fill, one vector, model; ``fill`` may come from an earlier fit on the same slice."""
    stages = [
        fill or median_fill(train, features),
        VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="features", handleInvalid="keep"),
    ]
    if isinstance(model, ScaledLogistic):
        total = train.agg(F.sum("weight")).first()[0] or 1.0
        stages += model.stages("features", total)
    else:
        stages.append(model("features"))
    return Pipeline(stages=stages).fit(train)


def _scored(fitted: PipelineModel, test: DataFrame) -> DataFrame:
    return fitted.transform(test).select(
        "match_id", "season", "label", "market", vector_to_array("probability")[1].alias("prob")
    )


def importances(fitted: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Feature importances of the fitted trees as a table."""
    values = fitted.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


def top_features(
    train: DataFrame, features: Sequence[str], n: int, model: Factory | None = None, fill: SQLTransformer | None = None
) -> list[str]:
    """Names of the ``n`` most important features of a model fitted on the training slice only."""
    fitted = _fit(train, features, model or boosted(3, 5), fill)
    ranked = importances(fitted, features, train.sparkSession).orderBy(F.desc("importance"), "feature").limit(n)
    return [r["feature"] for r in ranked.collect()]  # at most n names


def walk_forward(
    data: Dataset,
    models: Mapping[str, Factory | ScaledLogistic],
    test_seasons: Sequence[int] | None = None,
    top_n: int | None = None,
) -> DataFrame:
    """Out-of-fold probabilities of every model, as one long table (model, fold, match, prob, label).

    Train on all seasons before the fold's, test on the fold's; every season after the first is a
    fold unless ``test_seasons`` names some. With ``top_n`` each fold selects its features from its
    own training rows. Without a fold the table is empty.
    """
    return walk_forward_widths(data, models, (top_n,), test_seasons)[top_n]


def walk_forward_widths(
    data: Dataset,
    models: Mapping[str, Factory | ScaledLogistic],
    widths: Sequence[int | None],
    test_seasons: Sequence[int] | None = None,
) -> dict[int | None, DataFrame]:
    """``walk_forward`` for several numbers of features; a fold is filled and ranked once for all."""
    chosen = data.seasons[1:] if test_seasons is None else test_seasons
    folds = [s for s in chosen if s in data.seasons[1:]]

    medians = data.medians_before(folds)

    def prepared(season: int):
        train = data.df.filter(F.col("season") < season)
        fill = filler(medians[season])
        most = max((n for n in widths if n), default=0)
        return season, train, fill, top_features(train, data.features, most, fill=fill) if most else []

    def fitted(job) -> DataFrame:
        (season, train, fill, ranked), n, (name, model) = job
        model = _fit(train, ranked[:n] if n else data.features, model, fill)
        return _scored(model, data.df.filter(F.col("season") == season)).withColumn("model", F.lit(name))

    spark = data.df.sparkSession
    jobs = [(fold, n, m) for fold in _concurrently(prepared, folds, spark, data.rows_before) for n in widths for m in models.items()]
    parts = _concurrently(fitted, jobs, spark, lambda job: data.rows_before(job[0][0]))
    base = data.df.filter(F.col("season").isin(folds)).withColumn("prob", F.col("market"))
    out = {}
    for n in widths:
        long = base.select("match_id", "season", "label", "market", "prob", F.lit("market").alias("model"))
        for job, part in zip(jobs, parts, strict=True):
            if job[1] == n:
                long = long.unionByName(part)
        out[n] = long.withColumnRenamed("season", "fold")
    return out


def fold_scores(oof: DataFrame) -> DataFrame:
    """Mean of the per-fold metrics per model."""
    return fold_means(probability_metrics(oof, ["model", "fold"]), ["model"], ["accuracy", "log_loss", "brier"])


def calibrated(oof: DataFrame) -> DataFrame:
    """Isotonic calibration of each model fitted on its earlier folds, within [0.01, 0.99]; the first
    fold passes through and the market stays as it is."""
    oof = cut_lineage_by(oof, "model", "fold")  # read once per model and fold below
    sizes = {(r["model"], r["fold"]): r["count"] for r in oof.groupBy("model", "fold").count().orderBy("fold").collect()}
    folds = list(dict.fromkeys(fold for _, fold in sizes))
    names = [r["model"] for r in oof.filter("model <> 'market'").select("model").distinct().collect()]
    out = oof.filter((F.col("model") == "market") | (F.col("fold") == folds[0]))

    def fitted(job) -> DataFrame:
        name, fold = job
        mine = oof.filter(F.col("model") == name)
        iso = IsotonicRegression(featuresCol="prob", labelCol="label", predictionCol="_iso").fit(
            mine.filter(F.col("fold") < fold).select("prob", "label")
        )
        scored = iso.transform(mine.filter(F.col("fold") == fold))
        return scored.withColumn("prob", F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("_iso")))).drop("_iso")

    earlier = lambda job: sum(n for (name, fold), n in sizes.items() if name == job[0] and fold in folds[: folds.index(job[1])])
    for part in _concurrently(fitted, [(name, fold) for name in names for fold in folds[1:]], oof.sparkSession, earlier):
        out = out.unionByName(part)
    return out


def stacked(oof: DataFrame, models: Sequence[str], network: bool = False) -> DataFrame:
    """A second-level model on the first-level probabilities of earlier folds; the first fold is the
    plain mean."""
    wide = cut_lineage_by(oof.groupBy("match_id", "fold", "label", "market").pivot("model", list(models)).agg(F.max("prob")), "fold")
    columns = [*models, "market"]
    sizes = {r["fold"]: r["count"] for r in wide.groupBy("fold").count().orderBy("fold").collect()}
    folds = list(sizes)
    assembler = VectorAssembler(inputCols=columns, outputCol="stack", handleInvalid="skip")
    rows = assembler.transform(wide)
    mean = sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
    keep = ["match_id", "fold", "label", "market"]
    out = rows.filter(F.col("fold") == folds[0]).select(*keep, mean.alias("prob"))

    def fitted(fold: int) -> DataFrame:
        learner = (
            MultilayerPerceptronClassifier(featuresCol="stack", labelCol="label", layers=[len(columns), 32, 16, 2], maxIter=60, seed=7)
            if network
            else LogisticRegression(featuresCol="stack", labelCol="label")
        )
        scored = learner.fit(rows.filter(F.col("fold") < fold)).transform(rows.filter(F.col("fold") == fold))
        return scored.select(*keep, vector_to_array("probability")[1].alias("prob"))

    earlier = lambda fold: sum(sizes[f] for f in folds[: folds.index(fold)])
    for part in _concurrently(fitted, folds[1:], wide.sparkSession, earlier):
        out = out.unionByName(part)
    return out.withColumn("model", F.lit("stack_network" if network else "stack"))


META = ["prob", "market", "prob_x_market", "gap", "abs_gap", "sure"]


def meta_features(df: DataFrame) -> DataFrame:
    """Inputs of the final learner: model and market probability and how they differ."""
    p, m = F.col("prob"), F.col("market")
    return df.withColumns(
        {"prob_x_market": p * m, "gap": p - m, "abs_gap": F.abs(p - m), "sure": F.greatest(m, 1 - m)}
    )


def _fold(folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("match_id", F.lit(seed)), F.lit(folds))


def _cross_medians(data: Dataset, folds: int = 5, seed: int = 7) -> dict[int | None, dict[str, float | None]]:
    """Exact medians of all rows (None) and without each fold's, in the same passes."""
    slices = {k: [g for g in range(folds) if g != k] for k in range(folds)} | {None: list(range(folds))}
    return sliced_medians(data.df, data.features, _fold(folds, seed), slices)


def cross_fitted(
    data: Dataset, model: Factory, folds: int = 5, seed: int = 7, medians: Mapping[int | None, Mapping[str, float | None]] | None = None
) -> DataFrame:
    """K-fold probabilities inside one slice; the fold is a hash of the match id, so it is stable.

    ``medians`` may come from an earlier step on the same slice and folds.
    """
    rows = data.df.withColumn("_k", _fold(folds, seed))
    medians = medians or _cross_medians(data, folds, seed)
    fitted = lambda k: _scored(_fit(rows.filter(F.col("_k") != k), data.features, model, filler(medians[k])), rows.filter(F.col("_k") == k))
    parts = _concurrently(fitted, range(folds), rows.sparkSession, lambda k: sum(data.sizes.values()) * (folds - 1) // folds)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass
class Trained:
    """Artifacts of a production fit."""

    model: PipelineModel
    meta: PipelineModel
    calibration: object
    features: list[str]


def _meta_pipeline() -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=META, outputCol="meta", handleInvalid="keep"),
            LogisticRegression(featuresCol="meta", labelCol="label"),
        ]
    )


def train_final(data: Dataset, top_n: int = 30, model: Factory | None = None) -> Trained:
    """Recency-weighted fit on the strongest features, with a second-level learner fitted on k-fold
    probabilities and an isotonic calibration of them."""
    model = model or boosted()
    medians = _cross_medians(data)
    fill = filler(medians[None])
    features = top_features(data.df, data.features, top_n, fill=fill)
    chosen = data.only(features)
    subset = {k: {c: found[c] for c in features} for k, found in medians.items()}
    inner = cut_lineage_by(cross_fitted(chosen, model, medians=subset))
    meta = _meta_pipeline().fit(meta_features(inner))
    calibration = IsotonicRegression(featuresCol="prob", labelCol="label", predictionCol="_iso").fit(inner.select("prob", "label"))
    return Trained(_fit(data.df, features, model, filler(subset[None])), meta, calibration, features)


def score(artifacts: Trained, rows: DataFrame, sparse_above: float = 0.4, model_weight: float = 0.25) -> DataFrame:
    """Probabilities for upcoming games: the learned blend, or the plain weighted one where more than
    ``sparse_above`` of the features are missing; then calibrated within [0.01, 0.99]."""
    gaps = sum((F.col(c).isNull().cast("int") for c in artifacts.features), F.lit(0)) / F.lit(float(len(artifacts.features)))
    base = rows.withColumn("_gaps", gaps)
    first = artifacts.model.transform(base).withColumn("prob", vector_to_array("probability")[1])
    first = artifacts.calibration.transform(first.drop("rawPrediction", "probability", "prediction")).withColumn(
        "prob", F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("_iso")))
    )
    second = artifacts.meta.transform(meta_features(first))
    learned = vector_to_array("probability")[1]
    plain = model_weight * F.col("prob") + (1 - model_weight) * F.col("market")
    final = F.when(F.col("_gaps") > sparse_above, plain).otherwise(learned)
    return second.select(
        "match_id", F.col("prob").alias("model_prob"), "market", final.alias("home_win_prob"), (final >= 0.5).alias("tip_home")
    )


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free digest and row count of a table, in one combined aggregate."""
    return df.agg(F.coalesce(multiset_digest(columns), F.lit(0).cast("long")).alias("digest"), F.count(F.lit(1)).alias("rows"))


def _write_notes(spark: SparkSession, path: str, digest: DataFrame, features: Sequence[str], valid: bool) -> None:
    notes = digest.select("digest", "rows", F.lit(json.dumps(list(features))).alias("features"), F.lit(valid).alias("valid"))
    notes.coalesce(1).write.mode("overwrite").json(f"{path}/notes")


def _notes(spark: SparkSession, path: str):
    try:
        return spark.read.schema("digest long, rows long, features string, valid boolean").json(f"{path}/notes").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def save_artifacts(artifacts: Trained, path: str, digest: DataFrame) -> None:
    """Model, second level, calibration, feature names and the digest of the data they were fitted on."""
    artifacts.model.write().overwrite().save(f"{path}/model")
    artifacts.meta.write().overwrite().save(f"{path}/meta")
    artifacts.calibration.write().overwrite().save(f"{path}/calibration")
    _write_notes(digest.sparkSession, path, digest, artifacts.features, True)


def load_artifacts(spark: SparkSession, path: str, digest: DataFrame | None = None) -> Trained | None:
    """Stored artifacts, or None when there are none, they were invalidated, or the data has changed."""
    notes = _notes(spark, path)
    if notes is None or not notes["valid"]:
        return None
    if digest is not None:
        now = digest.first()
        if (now["digest"], now["rows"]) != (notes["digest"], notes["rows"]):
            return None
    return Trained(
        PipelineModel.load(f"{path}/model"),
        PipelineModel.load(f"{path}/meta"),
        IsotonicRegressionModel.load(f"{path}/calibration"),
        json.loads(notes["features"]),
    )


def invalidate_stale(spark: SparkSession, folders: Sequence[str], digest: DataFrame) -> list[str]:
    """Mark stored artifacts whose digest differs from the data's as invalid; returns their folders."""
    now = digest.first()
    stale = []
    for folder in folders:
        notes = _notes(spark, folder)
        if notes is not None and (notes["digest"], notes["rows"]) != (now["digest"], now["rows"]):
            _write_notes(spark, folder, digest, [], False)
            stale.append(folder)
    return stale


def tuned(data: Dataset, grid: Mapping[str, Factory | ScaledLogistic], test_seasons: Sequence[int] | None = None) -> DataFrame:
    """Walk-forward score of every configuration, best first (folds are ordered in time)."""
    return fold_scores(walk_forward(data, grid, test_seasons)).filter("model <> 'market'").orderBy("log_loss", "model")


def _labelled(parts: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for label, part in parts.items():
        one = part.withColumn("variant", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


def feature_count_sweep(data: Dataset, model: Factory, counts: Sequence[int], test_seasons: Sequence[int] | None = None) -> DataFrame:
    """Scores with the strongest N features, for several N, selected inside each fold."""
    widths = walk_forward_widths(data, {"model": model}, counts, test_seasons)
    return _labelled({f"top_{n}": fold_scores(widths[n]) for n in counts})


def ablation(
    data: Dataset, model: Factory | ScaledLogistic, groups: Mapping[str, Sequence[str]], test_seasons: Sequence[int] | None = None
) -> DataFrame:
    """Scores with all features and with each group left out."""
    variants = {"all": data} | {
        f"without_{g}": data.only([c for c in data.features if c not in set(cols)]) for g, cols in groups.items()
    }
    return _labelled({n: fold_scores(walk_forward(d, {"model": model}, test_seasons)) for n, d in variants.items()})


def side_test(
    a: Dataset, b: Dataset, model: Factory | ScaledLogistic, weights: Sequence[float], test_seasons: Sequence[int] | None = None
) -> DataFrame:
    """Two feature sets under the same folds: right decisions per season and blend weight."""
    both = _labelled({n: walk_forward(d, {"model": model}, test_seasons).filter("model = 'model'") for n, d in (("a", a), ("b", b))})
    w = F.explode(F.array(*[F.lit(float(x)) for x in weights]))
    p = F.col("weight") * F.col("prob") + (1 - F.col("weight")) * F.col("market")
    return both.withColumn("weight", w).groupBy("variant", "fold", "weight").agg(
        F.count_if((p >= 0.5) == (F.col("label") == 1)).alias("correct"),
        F.count(F.lit(1)).alias("games"),
        F.avg(log_loss_of(p, F.col("label"))).alias("log_loss"),
    )
