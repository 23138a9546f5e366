"""Repeated passages by hashing units: the earliest occurrence stays, the rest go, offsets are kept.

A text is cut at line ends and, within a line, at sentence ends. A unit is normalised (ASCII case,
white space), hashed to 128 bits and grouped over the corpus; its earliest occurrence is that of the
smallest doc_id, then the first place in the text. What is removed are runs of neighbouring repeated
units with at least ``min_words`` words in all, so common short lines alone are left where they are,
and a passage is found however it is cut into lines.

Units of fewer than three words say nothing: they belong to a run when they stand inside it. Null
texts have no units. Rows with a null id can't be ranked and are left whole. Rows with equal ids are
one text of that rank: equal rows are the same text, and different texts are its parts, in the order of
their hashes. Other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import arrow_pass, materialise, own_names

UNIT = re.compile(r"[^\n.!?]*(?:[.!?]+(?![\s.!?])[^\n.!?]*)*[.!?]*")
UNIT_WORDS = 3


def units_of(text: str | None) -> Iterator[tuple[int, int, int, bytes]]:
    """``(start, end, words, digest)`` of the units that say something, in order."""
    for m in UNIT.finditer(text or ""):
        words = m.group().lower().encode().split() if m.end() > m.start() else ()
        if len(words) >= UNIT_WORDS:
            yield m.start(), m.end(), len(words), xxhash.xxh3_128_digest(b" ".join(words))


def units(docs: DataFrame) -> DataFrame:
    """``doc_id, version, seq, starts, ends, words, digest, again``: version is a hash of the text, again if it had the unit before."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in ("doc_id", "version", "seq", "starts", "ends", "words", "digest", "again")}
            for doc_id, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text")), strict=True):
                seen: set[bytes] = set()
                for seq, (start, end, words, digest) in enumerate(units_of(text)):
                    for c, v in zip(columns, (doc_id, version, seq, start, end, words, digest, digest in seen), strict=True):
                        columns[c].append(v)
                    seen.add(digest)
                if len(columns["seq"]) > 50_000:
                    yield columns
                    columns = {c: [] for c in columns}
            yield columns

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text").where("doc_id IS NOT NULL"), rows, "doc_id long, version long, seq int, starts int, ends int, words int, digest binary, again boolean")


def _passages(docs: DataFrame, min_words: int) -> DataFrame:
    found = materialise(units(docs), "units")
    first = F.min(F.struct("doc_id", "version"))
    shared = found.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = found.join(materialise(shared, "shared"), "digest").where("again OR doc_id > first.doc_id OR (doc_id = first.doc_id AND version > first.version)")
    late = late.select("doc_id", "version", "seq", "starts", "ends", "words", F.col("first.doc_id").alias("first_doc_id")).distinct()  # repeated rows
    run = F.col("seq") - F.row_number().over(Window.partitionBy("doc_id", "version").orderBy("seq"))
    runs = late.withColumn("run", run).groupBy("doc_id", "version", "run")
    return (
        runs.agg(F.min("starts").alias("starts"), F.max("ends").alias("ends"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"), F.min("first_doc_id").alias("first_doc_id"))
        .where(F.col("n_words") >= min_words)
        .select("doc_id", "version", F.col("starts").cast("long").alias("starts"), F.col("ends").cast("long").alias("ends"), "n_units", "n_words", "first_doc_id")
    )


def repeated(docs: DataFrame, min_words: int = 30) -> DataFrame:
    """One row per removed passage: ``doc_id, starts, ends`` (code points), units, words, ``first_doc_id``."""
    return _passages(docs, min_words).drop("version")


def without_repeats(docs: DataFrame, min_words: int = 30) -> DataFrame:
    """``docs`` with the passages cut from ``text``, and ``removed``: their spans in the original text.

    A column ``removed`` that is there already is replaced.
    """
    doc_id, version, spans = own_names("id", "version", "spans")
    listed = _passages(docs, min_words).groupBy(F.col("doc_id").alias(doc_id), F.col("version").alias(version)).agg(F.array_sort(F.collect_list(F.struct("starts", "ends"))).alias(spans))
    joined = docs.join(listed, (F.col("doc_id") == F.col(doc_id)) & (F.xxhash64("text") == F.col(version)), "left")
    piece = lambda state, s: F.struct(F.concat(state["t"], F.substr("text", state["at"] + 1, s["starts"] - state["at"])).alias("t"), s["ends"].alias("at"))
    start = F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate(spans, start, piece, lambda state: F.concat(state["t"], F.substr("text", state["at"] + 1)))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(cut).alias("text")
    return joined.select(*[text if c == "text" else F.col(c) for c in docs.columns if c != "removed"], F.col(spans).alias("removed"))
