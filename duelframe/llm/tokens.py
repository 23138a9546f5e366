"""Token counts of whole texts without token ids: pieces per distinct pre-token times frequency.

A block of texts is reduced to its distinct pre-tokens, each with the texts that hold it and how often.
Pre-tokens are dealt by hash into buckets, and what a block has for a bucket is one packed row; rows of
a bucket meet in one task, where each distinct pre-token's pieces are counted once, joined to the
frequencies by the pre-token, and summed per text. Sums go back to the block and are added up there.

A pre-token that many texts of a block hold is no small fraction of the frequencies of all blocks: it
is counted in the block itself, once, and not sent, so no bucket grows with a hot pre-token.

Special strings inside texts count one token each, as is the default of the tokenizer. Null texts are
empty: 0 bytes, 0 tokens. Each input row is a text of its own, so repeated rows and null ids are kept.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duelframe.llm.common import arrow_pass

#: A block ends with the first text that brings it to so many characters, or at so many texts.
BLOCK_CHARS, BLOCK_TEXTS = 8_000_000, 60_000
#: A pre-token that this share of a block's texts hold is counted there; so few others are.
HOT_SHARE, HOT_TEXTS = 0.25, 64
#: Buckets for each shuffle partition, so that partitions get about as much each.
BUCKETS = 16


def splitter(tokenizer: Tokenizer):
    """``split(text) -> (pre-tokens, number of special strings)`` as the tokenizer does it.

    The pattern runs in ``regex``. Characters that this Python's Unicode tables don't know may be
    classed differently by the library's engine; a text with any is split by the library itself.
    """
    pattern = regex.compile(public_tokenizers.PATTERN).findall
    special = [a.content for a in tokenizer.get_added_tokens_decoder().values()]
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    library = tokenizer.pre_tokenizer.pre_tokenize_str

    def split(text: str, by_library: bool = False) -> tuple[list[str], int]:
        parts = cut.split(text) if cut and any(s in text for s in special) else [text]
        find = (lambda part: [part[a:b] for _, (a, b) in library(part)]) if by_library else pattern
        return (find(text) if len(parts) == 1 else [w for p in parts for w in find(p)]), len(parts) - 1

    return split


def unknown_characters() -> re.Pattern:
    runs, start = [], None
    for c in range(0x80, sys.maxunicode + 2):
        unknown = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if unknown and start is None:
            start = c
        if not unknown and start is not None:
            runs.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(runs)}]")


class Block:
    """Distinct pre-tokens of some texts, and for each (pre-token, text) its frequency."""

    def __init__(self):
        self.ids: dict[str, int] = defaultdict(count().__next__)
        self.codes, self.texts, self.times = [], [], []
        self.doc_ids, self.n_bytes, self.specials = [], [], []
        self.chars = 0
        self.checked, self.odd = 0, set()

    def add(self, doc_id, text: str, split, unknown: re.Pattern) -> None:
        words, special = split(text)
        codes = list(map(self.ids.__getitem__, words))
        if len(self.ids) > self.checked:
            fresh = [w for w in dict.fromkeys(words) if self.ids[w] >= self.checked and not w.isascii()]
            self.odd.update(self.ids[w] for w in fresh if unknown.search(w))
            self.checked = len(self.ids)
        if self.odd and not self.odd.isdisjoint(codes):
            codes = list(map(self.ids.__getitem__, split(text, by_library=True)[0]))
        found, times = np.unique(np.array(codes, np.int32), return_counts=True)
        self.codes.append(found)
        self.times.append(times.astype(np.uint32))
        self.texts.append(np.full(len(found), len(self.doc_ids), np.uint16))
        self.doc_ids.append(doc_id)
        self.n_bytes.append(len(text.encode()))
        self.specials.append(special)
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.doc_ids) >= BLOCK_TEXTS

    def rows(self, block: int, buckets: int, pieces: Callable[[list[str]], np.ndarray]) -> Iterator[dict]:
        """The packed frequencies for each bucket, and one row that names the texts."""
        codes, texts, times = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (self.codes, self.texts, self.times))
        words, base = list(self.ids), np.array(self.specials, np.int64)
        held = np.bincount(codes, minlength=len(words))
        hot = held >= max(HOT_TEXTS, HOT_SHARE * len(base))
        if hot.any():
            each = np.zeros(len(words), np.int64)
            each[hot] = pieces([words[i] for i in np.flatnonzero(hot)])
            base += np.bincount(texts, each[codes] * times, len(base)).astype(np.int64)
            rest = ~hot[codes]
            codes, texts, times, held = codes[rest], texts[rest], times[rest], np.where(hot, 0, held)
        raw = [w.encode() for w in words]
        bucket = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % buckets
        order = np.lexsort((codes, bucket[codes]))
        texts, times = texts[order].astype(np.uint16), times[order].astype(np.uint32)
        sent = np.flatnonzero(held)
        sent = sent[np.lexsort((sent, bucket[sent]))]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[sent][1:] != bucket[sent][:-1])), len(sent)) if len(sent) else [0]
        ends = np.append(0, np.cumsum(held[sent]))
        for k in range(0, len(cuts) - 1, 256):
            out: dict[str, list] = {c: [] for c in PACKED}
            for a, b in zip(cuts[k : k + 256], cuts[k + 1 : k + 257], strict=False):
                some = sent[a:b]
                here = [raw[i] for i in some]
                at = slice(ends[a], ends[b])
                values = (int(bucket[some[0]]), block, b"".join(here), np.array([len(w) for w in here], np.uint32).tobytes(), held[some].astype(np.uint32).tobytes(), texts[at].tobytes(), times[at].tobytes(), None, None, None)
                for c, v in zip(PACKED, values, strict=True):
                    out[c].append(v)
            yield out
        none = [None]
        yield dict.fromkeys(PACKED, none) | {"bucket": [block % buckets], "block": [block], "doc_ids": [self.doc_ids], "n_bytes": [self.n_bytes], "base": [base.tolist()]}


PACKED = ("bucket", "block", "words", "lengths", "holders", "texts", "times", "doc_ids", "n_bytes", "base")


def piece_counter(tokenizer: Tokenizer) -> Callable[[list[str]], np.ndarray]:
    """Counts pieces in this thread: Spark has dealt the work out, and the library's threads keep memory for good."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return lambda words: np.array([len(e.ids) for k in range(0, len(words), 5000) for e in tokenizer.encode_batch_fast(words[k : k + 5000], add_special_tokens=False)], np.int64)


def frequencies(docs: DataFrame, tokenizer_path: str, buckets: int) -> DataFrame:
    """Packed rows ``(bucket, block, ...)``, and per block one row that names its texts."""

    def rows(batches: Iterator[pa.RecordBatch]):
        tokenizer = Tokenizer.from_file(tokenizer_path)
        split, unknown, pieces = splitter(tokenizer), unknown_characters(), piece_counter(tokenizer)
        task, done, block = TaskContext.get().partitionId(), 0, Block()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                block.add(doc_id, text or "", split, unknown)
                if block.full():
                    yield from block.rows((task << 24) + done, buckets, pieces)
                    block = None  # its memory goes before the next block's comes
                    done, block = done + 1, Block()
        if block.doc_ids:
            yield from block.rows((task << 24) + done, buckets, pieces)

    return arrow_pass(
        docs.select(F.col("doc_id").cast("long"), "text"), rows,
        "bucket int, block long, words binary, lengths binary, holders binary, texts binary, times binary, doc_ids array<long>, n_bytes array<long>, base array<long>",
    )


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sums(batches: Iterator[pa.RecordBatch]):
        count, known = piece_counter(Tokenizer.from_file(tokenizer_path)), {}
        held: dict[int, np.ndarray] = {}

        def passed_on():
            none = [None]
            for block, total in held.items():
                texts = np.flatnonzero(total)
                yield {"block": [block], "texts": [texts.astype(np.uint16).tobytes()], "sums": [total[texts].astype(np.uint32).tobytes()], "doc_ids": none, "n_bytes": none, "base": none}
            held.clear()

        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["doc_ids"] is not None:
                    yield {"block": [r["block"]], "texts": [None], "sums": [None]} | {c: [r[c]] for c in ("doc_ids", "n_bytes", "base")}
                    continue
                ends = np.cumsum(np.frombuffer(r["lengths"], np.uint32)).tolist()
                words, start = [], 0
                for end in ends:
                    words.append(r["words"][start:end])
                    start = end
                new = [w for w in words if w not in known]
                known.update(zip(new, count([w.decode() for w in new]).tolist(), strict=True))
                pieces = np.array([known[w] for w in words], np.int64)
                tokens = np.repeat(pieces, np.frombuffer(r["holders"], np.uint32)) * np.frombuffer(r["times"], np.uint32)
                add = np.bincount(np.frombuffer(r["texts"], np.uint16), tokens).astype(np.int64)
                old = held.get(r["block"], add[:0])
                wide, slim = (add, old) if len(add) >= len(old) else (old, add)
                wide[: len(slim)] += slim
                held[r["block"]] = wide
            if len(held) > 1000:
                yield from passed_on()
            if len(known) > 1_000_000:
                known.clear()
        yield from passed_on()

    def total(block: pa.Table) -> pa.Table:
        names = block.filter(pa.compute.is_valid(block["doc_ids"]))
        ids, n_bytes, base = (names[c].combine_chunks().flatten() for c in ("doc_ids", "n_bytes", "base"))
        out = base.to_numpy(zero_copy_only=False).astype(np.int64)
        for texts, add in zip(block["texts"].to_pylist(), block["sums"].to_pylist(), strict=True):
            if texts is not None:
                out[np.frombuffer(texts, np.uint16)] += np.frombuffer(add, np.uint32)
        return pa.table({"doc_id": ids, "n_bytes": n_bytes, "n_tokens": out, "over_limit": out > limit})

    dealt = frequencies(docs, tokenizer_path, buckets).repartition("bucket").sortWithinPartitions("bucket")
    summed = arrow_pass(dealt, sums, "block long, texts binary, sums binary, doc_ids array<long>, n_bytes array<long>, base array<long>")
    return summed.groupBy("block").applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
