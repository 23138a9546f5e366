"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector is rotated at random and reduced to the signs of its coordinates. The stored factor is
the inner product of the vector with its sign code; dividing by it makes the inner product of a code
with another rotated vector an unbiased estimate of the cosine. The part of the code that is orthogonal
to its vector bounds the error: for a pair at or above the threshold the estimate cannot be lower than
``t - bound * sqrt((1 - f^2) / f^2) * sqrt(1 - t^2)``. With ``bound`` 1 that is certain, with the usual
``e / sqrt(d - 1)`` it holds with high confidence. Pairs that the bound cannot rule out are recomputed
exactly in double precision.

Pairs are sought among vectors of one label whose code, under further rotations, agrees in one of
several tables of bits. Bits grow with the logarithm of the number of vectors, tables follow from the
wanted recall of a pair at the threshold, so work grows a little faster than the input, not with its
square. Equal vectors are one class. A bucket with many members is cut into chunks that meet in pairs.

Vectors that are null, zero, or hold null or non-finite components, and those with a null label, link
with nothing; so do vectors of unequal length. A null id links with nothing and has a null component.
Rows that repeat an id and vector are one vector. Other columns are ignored; an empty table works.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import arrow_pass, chunk_pairs, connected_components, materialise, sorted_groups, spanning

SEED = 20_240_601
CHUNK = 1024


def rotation(d: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d, number]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def table_plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """``(bits, tables)``: buckets about as many as vectors, tables for the recall at the threshold."""
    bits = max(8, math.ceil(math.log2(max(2, n))) + 1)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def bucket_bits(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """``(n, tables)`` codes of ``bits`` signs each; as many rotations as that takes."""
    n, d = units.shape
    signs = np.concatenate([units @ rotation(d, k + 1).T >= 0 for k in range(math.ceil(bits * tables / d))], axis=1)
    powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    return (signs[:, : bits * tables].reshape(n, tables, bits) * powers).sum(2, dtype=np.uint64)


def usable(vector) -> np.ndarray | None:
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    out = np.array(vector, float) + 0.0
    return out if np.isfinite(out).all() and out.any() and np.isfinite(out @ out) and out @ out > 0 else None


def coded(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """``vec_id, digest, vector, keys``; digest and the rest are null for vectors that link with nothing."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            labels, given = batch.column("label").to_pylist(), batch.column("embedding").to_pylist()
            found = [usable(v) if lab is not None else None for v, lab in zip(given, labels, strict=True)]
            digest, raw, keys = [None] * len(found), [None] * len(found), [None] * len(found)
            for d in {len(v) for v in found if v is not None}:
                at = [i for i, v in enumerate(found) if v is not None and len(v) == d]
                stack = np.stack([found[i] for i in at])
                codes = bucket_bits(stack / np.linalg.norm(stack, axis=1, keepdims=True), bits, tables)
                for i, code in zip(at, codes, strict=True):
                    raw[i] = found[i].tobytes()
                    digest[i] = hashlib.md5(f"{labels[i]}:{d}:".encode() + raw[i]).digest()
                    place = hashlib.md5(f"{labels[i]}:{d}".encode()).digest()[:8]
                    mixed = (code + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.frombuffer(place, np.uint64)
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    keys[i] = (mixed ^ (mixed >> np.uint64(29))).view(np.int64).tolist()
            yield {"vec_id": batch.column("vec_id"), "digest": digest, "vector": raw, "keys": keys}

    return arrow_pass(vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding")), rows, "vec_id long, digest binary, vector binary, keys array<long>")


def possible(units: np.ndarray, others: np.ndarray, threshold: float, bound: float) -> np.ndarray:
    """Which pairs (row of ``units``, row of ``others``) the codes of ``units`` cannot rule out."""
    d = units.shape[1]
    turn = rotation(d, 0)
    turned = units @ turn.T
    codes = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(d)
    factor = np.minimum(1.0, (turned * codes).sum(1))
    estimate = codes @ (others @ turn.T).T / factor[:, None]
    slack = bound * np.sqrt(np.maximum(0, 1 - factor**2)) / factor * math.sqrt(1 - threshold**2)
    return estimate >= (threshold - slack - 1e-9)[:, None]


def linked(units: np.ndarray, raw: np.ndarray, chunk: np.ndarray, cross: bool, threshold: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``a < b`` of the pairs at or above the threshold, exactly."""
    first, second = [], []
    norms = np.sqrt((raw * raw).sum(1))
    for start in range(0, len(raw), 512):
        a, b = np.nonzero(possible(units[start : start + 512], units, threshold, bound))
        a = a + start
        keep = (a < b) & ((chunk[a] != chunk[b]) if cross else True)
        a, b = a[keep], b[keep]
        for k in range(0, len(a), 100_000):
            x, y = a[k : k + 100_000], b[k : k + 100_000]
            near = np.einsum("ij,ij->i", raw[x], raw[y]) / (norms[x] * norms[y]) >= threshold
            first.append(x[near])
            second.append(y[near])
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, int), np.zeros(0, int))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9999, bound: float = 1.0) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    bits, tables = table_plan(vectors.count(), threshold, recall)
    code = materialise(coded(vectors, bits, tables), "coded")
    valid = code.where("digest IS NOT NULL AND vec_id IS NOT NULL")
    classes = materialise(valid.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n")), "classes")
    reps = valid.join(classes, "digest").where("vec_id = rep").select("digest", "rep", "n", "vector", "keys").dropDuplicates(["digest"])
    reps = materialise(reps, "reps")
    buckets = reps.select("digest", F.posexplode("keys").alias("table", "key"))
    several = materialise(buckets.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared-keys")
    shared = buckets.join(several, "key", "left_semi")
    dealt = chunk_pairs(materialise(shared, "buckets"), "key", "digest", CHUNK).join(reps.select("digest", "rep", "n", "vector"), "digest")

    def rows(batches: Iterator[pa.RecordBatch]):
        for group in sorted_groups(batches, ["key", "lo", "hi"]):
            raw = [np.frombuffer(v, float) for v in group["vector"].to_pylist()]
            if len(raw) < 2 or len({len(v) for v in raw}) > 1:
                continue
            raw = np.stack(raw)
            units = raw / np.linalg.norm(raw, axis=1, keepdims=True)
            rep, n, table = group["rep"].to_numpy(), group["n"].to_numpy(), group["table"][0].as_py()
            a, b = linked(units, raw, group["chunk"].to_numpy(), group["lo"][0].as_py() < group["hi"][0].as_py(), threshold, bound)
            if table and len(a):  # counted in the first table that holds the pair
                codes = bucket_bits(units, bits, tables)[:, :table]
                new = np.concatenate([~(codes[a[k : k + 50_000]] == codes[b[k : k + 50_000]]).any(1) for k in range(0, len(a), 50_000)])
                a, b = a[new], b[new]
            if not len(a):
                continue
            count = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
            at = np.flatnonzero(count)
            yield {"a": rep[at], "b": rep[spanning(len(rep), a, b)[at]], "links": count[at].astype(np.int64)}

    order = ["key", "lo", "hi"]
    found = materialise(arrow_pass(dealt.repartition(*order).sortWithinPartitions(*order), rows, "a long, b long, links long", step=8192), "links")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(found.select("a", "b")).withColumnRenamed("id", "rep")
    told = classes.join(counts, "rep", "left").join(component, "rep", "left")
    told = told.select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = code.select("vec_id", "digest").join(told, "digest", "left")
    has_id = F.col("vec_id").isNotNull()
    component_id = F.when(has_id, F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(has_id, F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))
