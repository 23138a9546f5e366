"""Secret scan: known shapes, and strings that zstandard cannot explain from what stands around them.

Base kinds are fixed patterns. The method adds kind ``novel``: a candidate (a long run of key-like
characters with letters and digits, near a sensitive word; in NAME=value the value, with the name as
context) is compressed with a dictionary primed with common identifiers and the surrounding text,
without copies of the candidate. Its marginal bytes per character tell how much of it neither holds; a
candidate is reported above ``min_ratio``, which is meant for 64 characters and shrinks with the bits of
a smaller alphabet. The line after a secret has its context, and parts that follow a secret behind dots
belong to it. Paths, slugs and camel-case names, whose parts are all plain words or short numbers, are
left alone, and so is what the dictionary knows.

Null texts are empty. Every row is scanned alone and whole, so repeated rows, ties, long texts and
other columns change nothing; spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import arrow_pass

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this equals runs of any length with the short ones dropped
LEAST, LONG_LINE = 16, 40
ALPHABETS = [(n, re.compile(f"[{c}]*")) for n, c in ((10, "0-9"), (16, "0-9a-f"), (16, "0-9A-F"), (36, "0-9a-z"), (36, "0-9A-Z"), (62, "0-9A-Za-z"))]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PIECE = re.compile(r"[^=]+(?:=+$)?")
#: What stands between the end of a line and the first run of the next one; the last, short line of a PEM block.
NEXT_LINE = re.compile(r"[\x20\t]*\r?\n[\x20\t]*")
LAST_LINE = re.compile(r"[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/]{1,15}={0,2})(?=[\x20\t]*\r?\n[\x20\t]*-----END )")
#: Words that make what follows sensitive: alone, behind a sign, or as a capitalised part of a name.
SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])(?i:passwords?|passwd|pwd|secrets?|tokens?|(?:api|access|private|public|secret|session|encryption)?keys?|auth(?:orization|entication)?|bearer|credentials?|private|signature|session|cookie)"
    r"|(?<=[a-z0-9])(?:Password|Secret|Token|Key|Auth|Authorization|Credentials?|Signature|Session|Cookie))(?![a-z])"
)
#: The further parts of a secret in parts, such as a signed token.
DOTTED = re.compile(r"(?:\.[A-Za-z0-9+/_=-]{8,})*")
#: Parts of a path, slug or versioned name, and names in camel case.
PLAIN_PART = re.compile(r"[A-Z]?[a-z]+[0-9]{0,4}[a-z]?|[A-Z]+[0-9]{0,4}|[0-9]{1,4}|(?:[A-Z]?[a-z]{2,}[0-9]{0,2})(?:[A-Z][a-z]{2,}[0-9]{0,2})+|")
CAMEL = re.compile(r"(?:[A-Z]?[a-z]{2,}[0-9]{0,2})(?:[A-Z][a-z]{2,}[0-9]{0,2})+")
#: What code and configuration commonly hold near keys; the prefix of every dictionary.
IDENTIFIERS = (
    "access_key access_token account_id api_key api_secret application authorization aws_access_key_id aws_secret_access_key "
    "base64 bearer certificate client_id client_secret config connection_string container cookie credential credentials "
    "database default encoding encryption_key endpoint environment expires_in export filename function github_token hostname "
    "https://www. identifier import integer localhost login namespace None null oauth_token object package parameter password "
    "permission private_key public_key refresh_token region request response return secret_key self session_id session_token "
    "settings signature ssh-rsa string subscription table_name tenant_id timestamp true false username value version webhook "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def marginal_bytes(candidate: str, around: str, identifiers: str = IDENTIFIERS) -> int:
    """Bytes that ``candidate`` adds once the dictionary (identifiers, then surroundings) is known."""
    primed = zstandard.ZstdCompressionDict(f"{identifiers}\n{around}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(squeeze.compress(candidate.encode())) - len(squeeze.compress(b""))


def alphabet(word: str) -> int:
    """Characters of the smallest usual alphabet that holds the word: digits, hex, one case, both cases, key-like."""
    word = word.rstrip("=")
    for size, held in ALPHABETS:
        if held.fullmatch(word):
            return size
    return 64


def surroundings(text: str, start: int, end: int, around: int) -> str:
    """What stands around a candidate, without copies of it: they do not explain it."""
    word = text[start:end]
    wide = around + len(word) - 1  # no copy is cut by the bounds
    before, after = text[max(0, start - wide) : start].replace(word, ""), text[end : end + wide].replace(word, "")
    return before[max(0, len(before) - around) :] + "\n" + after[:around]


def plain(word: str) -> bool:
    """Whether all parts of a run are words or short numbers, as in paths, slugs and names."""
    parts = re.split(r"[/_.+=-]+", word)
    return all(map(PLAIN_PART.fullmatch, parts)) if len(parts) > 2 else bool(CAMEL.fullmatch(word))


def pieces_of(word: str) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of the parts of a run between '=' signs; padding belongs to the part before it."""
    return (m.span() for m in PIECE.finditer(word))


def novel_spans(text: str, taken: list[tuple[int, int, int]], min_ratio: float, context: int, around: int, identifiers: str) -> list[tuple[int, int, int]]:
    """A run is cut at '=' into names and values; from its first novel value on it is reported, else it is judged whole."""
    out, taken = [], sorted(taken)
    starts, reach = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
    passed = {m.end() for _, k, e in taken if k == 0 and (m := NEXT_LINE.match(text, e))}  # where lines start that follow a secret

    told = 0

    def report(start: int, end: int) -> None:
        nonlocal told
        end = told = DOTTED.match(text, end).end()
        out.append((start, 3, end))
        if m := LAST_LINE.match(text, end):
            out.append((m.start(1), 3, m.end(1)))
        elif m := NEXT_LINE.match(text, end):
            passed.add(m.end())

    def novel(start: int, end: int, first: int) -> bool:
        word, digits = text[start:end], any(c.isdigit() for c in text[start:end])
        follows = start == first and first in passed
        long = follows and len(word) >= LONG_LINE and not word.islower() and not word.isupper()  # chance may leave out digits
        if len(word) < LEAST or not (digits or long) or not any(c.isalpha() for c in word) or plain(word):
            return False
        if not follows and not SENSITIVE.search(text, max(0, first - context), start):
            return False
        least = min_ratio * len(word) * log2(alphabet(word)) / 6
        return marginal_bytes(word, surroundings(text, start, end, around), identifiers) >= least

    for m in CANDIDATE.finditer(text):
        first, last = m.span()
        if first < told:
            continue
        for a, b in pieces_of(m.group()):
            before = bisect_right(starts, first + a)
            if not (before and reach[before - 1] >= first + b) and novel(first + a, first + b, first):
                report(first + a, last)
                break
        else:
            before = bisect_left(starts, last)
            if "=" in m.group() and not (before and reach[before - 1] > first) and novel(first, last, first):
                report(first, last)
    return out


def spans_of(text: str | None, min_ratio: float = 0.75, context: int = 40, around: int = 400, identifiers: str = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """All spans by start, then kind in the order of ``KINDS``."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, min_ratio, context, around, identifiers))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, min_ratio: float = 0.75) -> DataFrame:
    """Spans and counts of every row."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [spans_of(t, min_ratio) for t in batch.column("text").to_pylist()]
            count = lambda k: [sum(x[1] == k for x in s) for s in found]
            yield {
                "doc_id": batch.column("doc_id"), "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "n_novel": count(3),
                "base_sha256": [hashlib.sha256(written([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found],
                "spans": [written(s) for s in found],
            }

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redacted(text: str | None, min_ratio: float = 0.75, mark: str = "[REDACTED]") -> str | None:
    """The text with every span, overlapping ones joined, replaced by a mark."""
    out, at = [], 0
    for start, _, end in spans_of(text, min_ratio):
        if end > at:
            if start >= at:
                out += [text[at:start], mark]
            at = end
    return text if not out else "".join(out) + text[at:]


def redact(docs: DataFrame, min_ratio: float = 0.75, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` counted anew; all rows stay."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = pa.array([redacted(t, min_ratio, mark) for t in batch.column("text").to_pylist()], batch.schema.field("text").type)
            yield batch.set_column(at, batch.schema.field("text"), texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
