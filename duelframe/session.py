"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to delete the shuffle files of a query as soon as the query has ended.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "duelframe", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested under.

    What the operators rely on (UTC, AQE) is always set. Master, memory and partition counts are set
    only for a plain local run: under ``spark-submit`` those of the command hold, and with a
    ``spark.master`` among ``conf`` or a session that runs already, those that are given there.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if not submitted and "spark.master" not in conf and SparkSession.getActiveSession() is None:
        cpus = cpus or os.cpu_count() or 8
        settings |= {
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": os.environ.get("DUELFRAME_DRIVER_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        }
    builder = SparkSession.builder.appName(app).config(map=settings | conf)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. It is chosen here only when the setting is
    absent and the master is local, as in tests; on a cluster a missing setting is an error because
    a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="duelframe-")
    context.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; a lost executor recomputes nothing before it."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What ends in here deletes its shuffle files, which otherwise stay until the driver collects garbage."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def _laid_out(df: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/laid-out-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns), path


def cut_lineage_by(df: DataFrame, *by: str) -> DataFrame:
    """As ``cut_lineage``, written as Parquet laid out by ``by``, for tables of which filters on these
    columns read a part at a time: a filter skips the other parts, and a reader takes the columns it needs."""
    return _laid_out(df, by)[0]


@contextmanager
def in_steps(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A way to write a table that later steps read, so that the shuffle files of one step are gone before the next begins.

    The tables are deleted at the end: what is made of them has to be written by then.
    """
    paths: list[str] = []

    def step(df: DataFrame) -> DataFrame:
        out, path = _laid_out(df, ())
        paths.append(path)
        return out

    try:
        yield step
    finally:
        for path in paths:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
