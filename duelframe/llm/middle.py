"""Fill-in-the-middle: texts are cut in three and put in another order, cuts found by memoised chunks.

A rolling hash over the bytes cuts each text into content-defined chunks, so that texts that share
passages share chunks. What a chunk means for the cuts is its boundary summary: how many units begin
in it, whether it begins and ends inside one, which of the marks it holds, and the bytes at its ends,
where a mark may lie across. Summaries are kept by content (equal hashes are compared byte by byte),
and combining them gives a text's units; only the two chunks that hold a cut are looked into.

Null and empty texts are plain, with no units. Texts that hold a mark stay plain. Repeated rows are
cut alike, each on its own; a null id counts as an empty one. An empty table gives an empty result.
Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import arrow_pass

#: Bytes of the rolling window, of the shortest and the longest chunk, and one cut in so many places.
WINDOW, SHORTEST, LONGEST, ONE_IN = 32, 256, 8192, 1024
#: Bytes hashed at a time, and bytes of chunks that a task remembers.
SLICE, MEMO_BYTES = 1 << 20, 32 << 20
_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MARKS = ("<P>", "<S>", "<M>")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def cut_points(raw: bytes) -> list[int]:
    """Ends of the content-defined chunks: a hash of the last ``WINDOW`` bytes decides."""
    n = len(raw)
    if n <= SHORTEST:
        return [n] if n else []
    data = np.frombuffer(raw, np.uint8)
    marks = []
    for start in range(0, n, SLICE):
        low = max(0, start - WINDOW + 1)
        rolled = _GEAR[data[low : start + SLICE]]
        width = 1
        while width < WINDOW:  # the sum of 2 * width bytes from two sums of width
            wider = rolled.copy()
            wider[width:] += rolled[:-width] << np.uint64(width)
            rolled, width = wider, width * 2
        at = np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(ONE_IN) == 0) + low + 1
        marks.append(at[at > start])
    out, last = [], 0
    for at in np.concatenate(marks).tolist():
        while at - last > LONGEST:
            last += LONGEST
            out.append(last)
        if at - last >= SHORTEST:
            out.append(at)
            last = at
    while n - last > LONGEST:
        last += LONGEST
        out.append(last)
    return out if last == n else [*out, n]


class Summary(NamedTuple):
    """What combining needs to know of a stretch of bytes."""

    units: int  # that begin in it, if it does not continue one
    inside: bool  # begins inside a unit if what is before ends in one
    open: bool  # ends inside a unit that may go on
    marked: bool
    head: bytes
    tail: bytes


class Cutter:
    """Counts units of texts and finds where the k-th begins."""

    def __init__(self, unit: str = "chars", marks: tuple[str, ...] = MARKS):
        if unit not in ("chars", "words"):
            raise ValueError(f"unknown unit {unit}")
        self.unit, self.marks = unit, [m.encode() for m in marks]
        self.edge = max(map(len, self.marks)) - 1
        self.memo: dict[bytes, Summary] = {}
        self.held = 0

    def begins(self, chunk: bytes, open_: bool = False) -> np.ndarray:
        """Places where units begin, if a unit is open before the chunk or not."""
        data = np.frombuffer(chunk, np.uint8)
        if self.unit == "chars":  # continuation bytes begin nothing
            return np.flatnonzero((data & 0xC0) != 0x80)
        said = ~_BLANK[data]
        return np.flatnonzero(said & ~np.append(open_, said[:-1]))

    def summary(self, chunk: bytes) -> Summary:
        found = self.memo.get(chunk)  # equal by content
        if found is None:
            if self.unit == "chars":
                inside = open_ = False
            else:
                inside, open_ = (not _BLANK[chunk[0]], not _BLANK[chunk[-1]])
            found = Summary(len(self.begins(chunk)), inside, open_, any(m in chunk for m in self.marks), chunk[: self.edge], chunk[-self.edge :])
            if self.held > MEMO_BYTES:
                self.memo.clear()
                self.held = 0
            self.memo[chunk] = found
            self.held += len(chunk)
        return found

    def __call__(self, raw: bytes) -> Cuts:
        ends = cut_points(raw)
        parts = [self.summary(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        before, open_, marked, tail = [0], [False], False, b""
        for part in parts:
            before.append(before[-1] + part.units - (open_[-1] and part.inside))
            open_.append(part.open)
            marked = marked or part.marked or any(m in tail + part.head for m in self.marks)
            tail = (tail + part.tail)[-self.edge :]
        return Cuts(self, raw, [0, *ends], before, open_, marked)


class Cuts(NamedTuple):
    cutter: Cutter
    raw: bytes
    ends: list[int]
    before: list[int]
    open: list[bool]
    marked: bool

    @property
    def units(self) -> int:
        return self.before[-1]

    def at(self, k: int) -> int:
        """The byte at which unit ``k`` begins; all before it are ``k`` units."""
        if k <= 0 or k >= self.units:
            return 0 if k <= 0 else len(self.raw)
        chunk = int(np.searchsorted(self.before, k, "right")) - 1
        a, b = self.ends[chunk], self.ends[chunk + 1]
        return a + int(self.cutter.begins(self.raw[a:b], self.open[chunk])[k - self.before[chunk]])


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "chars", plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``doc_id, n, form, prefix_units, middle_units, output`` of every row.

    Prefix, suffix and middle marks stand before their parts. ``psm`` is prefix, suffix, middle;
    ``spm`` suffix, prefix, middle; ``plain`` the text as it is. Two of four numbers drawn from seed and
    id cut the text, one decides whether it stays plain, one the order.
    """
    before, behind, between = (m.encode() for m in marks)

    def rows(batches: Iterator[pa.RecordBatch]):
        cutter = Cutter(unit, marks)
        for batch in batches:
            n, forms, prefixes, middles, outputs = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                cuts = cutter(raw)
                h = draws(seed, doc_id)
                n.append(cuts.units)
                if not raw or cuts.marked or h[2] % 100 >= 100 - plain_percent:
                    form, prefix, middle, out = "plain", None, None, raw
                else:
                    low, high = sorted((h[0] % (cuts.units + 1), h[1] % (cuts.units + 1)))
                    a, b = cuts.at(low), cuts.at(high)
                    prefix, middle = low, high - low
                    if h[3] % 100 < spm_percent:
                        form, out = "spm", b"".join((behind, raw[b:], before, raw[:a], between, raw[a:b]))
                    else:
                        form, out = "psm", b"".join((before, raw[:a], behind, raw[b:], between, raw[a:b]))
                forms.append(form)
                prefixes.append(prefix)
                middles.append(middle)
                outputs.append(out.decode())
            yield {"doc_id": batch.column("doc_id"), "n": n, "form": forms, "prefix_units": prefixes, "middle_units": middles, "output": outputs}

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    before, behind, between = marks
    last = F.instr(output, between)
    middle = F.substring(output, last + len(between), F.length(output))
    at = F.instr(output, behind)
    psm = F.concat(F.substring(output, F.lit(len(before) + 1), at - 1 - len(before)), middle, F.substring(output, at + len(behind), last - at - len(behind)))
    turn = F.instr(output, before)
    spm = F.concat(F.substring(output, turn + len(before), last - turn - len(before)), middle, F.substring(output, F.lit(len(behind) + 1), turn - 1 - len(behind)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
