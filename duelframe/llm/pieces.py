"""SentencePiece BPE, encoded by vectorised merge rounds over the distinct words of many texts.

The symbols of all words lie in one flat array. A round looks up the pairs that changed, takes the best
rank in each word, merges that pair wherever it stands (leftmost first where two overlap), and compacts
the array; words without a pair leave. Ranks that several pieces share merge one place a round, as the
library's queue would. Characters without a piece become their UTF-8 bytes.

No piece holds the space mark behind another character, so words never merge with each other; a model
that breaks this is encoded with each text as one word. Null texts are empty: no ids, decoded to an
empty text. Every row is encoded alone, so repeated rows and null ids are kept, and other columns do
not matter.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import arrow_pass

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Characters whose words are gathered before they are encoded together, and words that are remembered.
SLICE_CHARS, REMEMBERED = 8_000_000, 500_000


class Model:
    """Merge tables of a SentencePiece BPE model: ranks of pairs, products, and texts of pieces."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        odd = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        ids = {p: i for i, p in enumerate(names) if i not in odd}
        byte_of = {i: b for b, i in byte_ids.items()}
        self.names, self.byte_ids, self.unknown = names, byte_ids, sp.unk_id()
        self.spelt = [bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.separate = all(MARK not in p[1:] or set(p) == {MARK} for p in ids)
        self.symbol = np.arange(-1, -sys.maxunicode - 2, -1, dtype=np.int32)  # a character without a piece: -1 - code
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        scores = {p: sp.get_score(i) for p, i in ids.items() if len(p) > 1}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        held = np.bincount([ranks[s] for s in scores.values()], minlength=1)
        self.shared = np.flatnonzero(held > 1).astype(np.int32)
        known = lambda part: ids.get(part, -1 - ord(part) if len(part) == 1 else None)
        pairs = [(left, right, ids[p], ranks[s]) for p, s in scores.items() for k in range(1, len(p)) if (left := known(p[:k])) is not None and (right := known(p[k:])) is not None]
        table = np.array(pairs, np.int64).reshape(-1, 4)
        keys = self.keys(table[:, 0], table[:, 1])
        order = np.argsort(keys)
        self.pairs = np.append(keys[order], np.iinfo(np.int64).max)
        self.product, self.rank = (np.append(table[order, k], NONE).astype(np.int32) for k in (2, 3))

    @staticmethod
    def keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) + right.astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys(left, right)
        at = np.searchsorted(self.pairs, keys)
        hit = self.pairs[at] == keys
        return np.where(hit, self.rank[at], NONE), self.product[at]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(symbols, ends)`` of all words; symbols below 0 are characters without a piece."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        done_symbols, done_words = [], []
        rank, product = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int32)
        fresh = np.ones(len(symbols), bool)  # pairs to look up
        while len(symbols):
            at = np.flatnonzero(fresh[:-1] & (word[:-1] == word[1:]))
            rank[fresh] = NONE
            rank[at], product[at] = self.look_up(symbols[at], symbols[at + 1])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            open_ = best != NONE
            merge = open_ & (rank == best)
            run = np.arange(len(merge))
            run -= np.maximum.accumulate(np.where(merge & ~np.append(False, merge[:-1]), run, 0))
            merge &= run % 2 == 0
            if len(self.shared) and (tied := merge & np.isin(best, self.shared)).any():
                places = np.flatnonzero(tied)
                merge[places[np.append(False, word[places[1:]] == word[places[:-1]])]] = False
            symbols[merge] = product[merge]
            fresh = merge | np.append(merge[1:], False)  # the merged symbol and the one before it
            gone = np.append(False, merge[:-1])
            done = ~open_
            if done.any():
                done_symbols.append(symbols[done])
                done_words.append(word[done])
            keep = open_ & ~gone
            # the symbol before a merge whose own right half is gone stays marked through its successor
            fresh |= np.append(gone[1:], False)
            symbols, word, rank, product, fresh = symbols[keep], word[keep], rank[keep], product[keep], fresh[keep]
            fresh |= np.append(fresh[1:], False)
        if not done_words:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        all_words = np.concatenate(done_words)
        order = np.argsort(all_words, kind="stable")
        return np.concatenate(done_symbols)[order], np.cumsum(np.bincount(all_words, minlength=len(words)))

    def written(self, words: list[str], written: list[str]) -> Iterator[tuple[str, str]]:
        """Per word its ids, joined by commas, and the text that these ids decode to, with space marks as spaces."""
        symbols, ends = self.encode(words)
        starts = np.append(0, ends)[:-1].astype(np.int64)
        rare = np.minimum.reduceat(symbols, starts) < 0 if len(words) else np.zeros(0, bool)
        flat = symbols.tolist()
        for a, b, has_bytes in zip(starts.tolist(), ends.tolist(), rare.tolist(), strict=True):
            ids = self.with_bytes(flat[a:b]) if has_bytes else flat[a:b]
            yield ",".join([written[i] for i in ids]), self.text_of(ids)

    def with_bytes(self, symbols: list[int]) -> list[int]:
        """Piece ids; a character without a piece gives its bytes, or the unknown id where the model has none."""
        return [i for s in symbols for i in ([s] if s >= 0 else [self.byte_ids.get(b, self.unknown) for b in chr(-1 - s).encode()])]

    def text_of(self, ids: list[int]) -> str:
        """The text of the ids of one word, its space marks as spaces."""
        return b"".join([self.spelt[i] for i in ids]).decode("utf-8", "replace")

    def words(self, text: str) -> list[str]:
        """Words without the mark that starts them; a word that starts with several marks keeps them all."""
        if not text:
            return []
        if self.separate and text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        marked = MARK + text.replace(" ", MARK)
        if not self.separate:
            return [MARK + marked]  # the doubled mark is taken off again by ``marked``
        return [w[1:] if w[1:2] != MARK else w for w in re.findall(f"{MARK}+[^{MARK}]*", marked)]

    def marked(self, word: str) -> str:
        return (word[1:] if not self.separate else word) if word.startswith(MARK) else MARK + word


def encoded(model: Model, texts: Iterator[str | None]) -> Iterator[tuple[str, str]]:
    """Per text its ids, joined by commas, and the text they decode to.

    Texts that wait for their slice hold each distinct word of it once.
    """
    seen: dict[str, tuple[str, str]] = {}
    written = [str(i) for i in range(len(model.names))]

    def finish(held: list[list[str]], distinct: dict[str, str]):
        new = [w for w in distinct if w not in seen]
        seen.update(zip(new, model.written([model.marked(w) for w in new], written), strict=True))
        for words in held:
            found = [seen[w] for w in words]
            yield ",".join([ids for ids, _ in found]), "".join([text for _, text in found])[1:]
        if len(seen) > REMEMBERED:
            seen.clear()

    held, distinct, chars = [], {}, 0
    for text in texts:
        one = distinct.setdefault
        held.append([one(w, w) for w in model.words(text or "")])
        chars += len(text or "")
        if chars >= SLICE_CHARS:
            yield from finish(held, distinct)
            held, distinct, chars = [], {}, 0
    yield from finish(held, distinct)


def texts_of(batches: Iterator[pa.RecordBatch], doc_ids: list) -> Iterator[str | None]:
    for batch in batches:
        doc_ids += batch.column("doc_id").to_pylist()
        yield from batch.column("text").to_pylist()


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row."""

    def rows(batches: Iterator[pa.RecordBatch]):
        doc_ids: list = []
        for line, text in encoded(Model(model_path), texts_of(batches, doc_ids)):
            yield {"doc_id": [doc_ids.pop(0)], "ids": [[int(i) for i in line.split(",")] if line else []], "decoded": [text]}

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, without passing ids to Spark."""

    def rows(batches: Iterator[pa.RecordBatch]):
        doc_ids: list = []
        out = encoded(Model(model_path), texts_of(batches, doc_ids))
        while part := [(line.count(",") + 1 if line else 0, *(hashlib.sha256(x.encode()).hexdigest() for x in (line, text))) for line, text in islice(out, 2000)]:
            count, ids_sha, text_sha = zip(*part, strict=True)
            yield {"doc_id": doc_ids[: len(part)], "n_tokens": list(count), "ids_sha256": list(ids_sha), "decoded_sha256": list(text_sha)}
            del doc_ids[: len(part)]

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
