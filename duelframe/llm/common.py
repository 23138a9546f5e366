"""Helpers of the operators: tables in the shared folder, Arrow passes, and linked components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from duelframe.session import shared_folder

#: Space and the five control characters that separate words; ``bytes.split()`` cuts at exactly these.
SPACE = " \t\n\x0b\x0c\r"
#: Words as Java and RE2 patterns write them.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's default bytes of an Arrow batch, and what replaces it: both ends of the pipe hold a batch.
WIDE_BATCH, BATCH = "67108864b", "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that all executors share and read it again.

    Lost executors then cost no recomputation, and a table that is read twice is computed once.
    """
    return written(df, name)[0]


def own_names(*names: str) -> list[str]:
    """Column names that no table has, for columns beside those of a caller's table."""
    mark = uuid.uuid4().hex
    return [f"_{name}_{mark}" for name in names]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialise``, with the path, for tables that are to be discarded."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``written`` made and nothing will read again."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def arrow_pass(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, step: int = 256) -> DataFrame:
    """``mapInArrow`` where the function yields dicts of columns (lists, NumPy or Arrow arrays).

    Batches are bounded in bytes, and the function gets them in slices of ``step`` rows, so that few
    texts are held outside Spark's own memory at a time.
    """
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in (WIDE_BATCH, WIDE_BATCH.removesuffix("b")):
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        slices = (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step))
        for columns in rows(slices):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in ((columns[f.name], f) for f in out)], schema=out)

    return df.mapInArrow(run, schema)


def chunk_pairs(df: DataFrame, key: str, order: str, limit: int, weight: str | None = None) -> DataFrame:
    """Deal the rows of each key to tasks of about twice ``limit`` so that all pairs still meet.

    A key with up to ``limit`` rows (or as much ``weight``) stays one group. A larger one is cut into
    chunks by a hash of ``order``, and each row goes to every pair of chunks that holds its own. Adds
    ``lo`` and ``hi`` (the pair) and ``chunk`` (the row's own); a group is one (key, lo, hi). Rows are
    told of their key's size where they are, so those of a large key do not come together for it.
    """
    amount = F.sum(weight) if weight else F.count("*")
    large = df.groupBy(key).agg(amount.alias("_n")).where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_c"))
    return (
        join_ids(df, materialise(large, "large-groups"), "left")
        .withColumn("_c", F.coalesce("_c", F.lit(1)))
        .withColumn("chunk", F.pmod(F.xxhash64(order), F.col("_c")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
        .withColumns({"lo": F.least("chunk", "_o"), "hi": F.greatest("chunk", "_o")})
        .drop("_c", "_o")
    )


#: Ids that may be broadcast: 32 MB as longs.
BROADCAST_IDS = 4_000_000


def join_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Join of many rows with a materialised table of distinct ids, on its first column.

    The ids are counted: up to ``BROADCAST_IDS`` are broadcast, more are joined by a shuffle.
    """
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, ids.columns[0], how)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that links reach, for each of ``n`` positions and links ``a[k]-b[k]``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by ``keys`` into one table per group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns, strict=True))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, mark
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``edges(a, b)``: the smallest id that links reach.

    Alternates two star rounds until nothing changes: each node hangs its larger neighbours below the
    smallest node it knows, then its smaller ones. Minima are combined on the map side and written
    before they are joined to the links, so a node with a third of all links is a skewed side of a
    join that AQE splits, and no single task. Tables of a round are deleted when the next one is
    written; only a count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    ends = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    state, path = written(ends.distinct(), "links")
    before = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_000_007)).first()
        if tuple(mark) == before or not mark[0]:
            break
        before = tuple(mark)
        both = state.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(state.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least, p1 = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large, p2 = written(both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        low, p3 = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        small = large.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo")))
        old = path
        state, path = written(small.distinct(), "links")
        discard(spark, old, p1, p2, p3)
    tops = state.select(F.col("lo").alias("id")).distinct()
    return state.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(tops.select("id", F.col("id").alias("component")))
