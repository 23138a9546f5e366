"""Quality classifier by attention over passages: multiple-instance learning from document labels.

Every passage of a text (``PASSAGE`` words) becomes a vector of what its words look like and which they
are: shares of capitals, digits, marks and blanks, repeats, and hashed histograms of words and of their
shapes. A small network encodes each passage; gated attention, learnt from labels of whole documents
alone, weighs the passages of a text, and the weighted sum of their codes is scored.

The network is fitted on at most ``max_docs`` labelled texts with at most ``max_passages`` passages,
chosen by a hash of their ids, so the fit does not grow with the corpus; every text is scored whole.
Labels, languages, sources and ids are never inputs. Null and wordless texts are one empty passage and
get a score like any other. Rows with a null id are scored and count as not held out. Ids with labels
that disagree teach nothing. Repeated rows teach once. Without labels of both kinds every score is the share of good labels
(0.5 if there are none). Repeated rows are scored alike. An empty table gives an empty result. Other
columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import WORD, arrow_pass

#: Words of a passage, and the least of a last one; sizes of the hashed histograms.
PASSAGE, LEAST, WORDS, SHAPES = 96, 24, 128, 64
_STATS = ("empty", "n", "chars", "upper", "lower", "digits", "marks", "wide", "bare", "shouts", "tailed", "one", "long", "distinct", "pairs", "capital")
WIDTH = len(_STATS) + WORDS + SHAPES
_CLASS = np.full(256, 3, np.uint8)  # marks
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_SHAPE = bytes(b"Aa0"[c] if c < 3 else ord("x") if c == 4 else b for b, c in enumerate(_CLASS.tolist()))


class Encoder:
    """Passages of a text as vectors; what is known of a word is kept."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1024, 13))

    def _learn(self, words: list[bytes]) -> None:
        first, n = len(self.known), len(words)
        while first + n > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        size = np.array([len(w) for w in words])
        start = np.append(0, np.cumsum(size)[:-1])
        kind = _CLASS[np.frombuffer(b"".join(words), np.uint8)]
        kinds = np.stack([np.add.reduceat((kind == k).astype(np.int64), start) for k in range(5)], 1)
        shapes = b" ".join(words).translate(_SHAPE)
        final = np.frombuffer(shapes, np.uint8)[start + size + np.arange(n) - 1]
        runs = _RUNS.sub(rb"\1", shapes).split(b" ")
        about = self.table[first : first + n]
        about[:, 0], about[:, 1:6] = size, kinds
        about[:, 6] = kinds[:, 0] + kinds[:, 1] + kinds[:, 2] + kinds[:, 4] == 0
        about[:, 7] = final == ord("!")
        about[:, 8] = (kinds[:, 3] > 0) & ~np.isin(final, np.frombuffer(b"Aax0.,;:", np.uint8))
        about[:, 9], about[:, 10] = size == 1, size > 20
        about[:, 11] = [xxhash.xxh3_64_intdigest(w.lower()) % WORDS for w in words]
        about[:, 12] = [xxhash.xxh3_64_intdigest(r[:12]) % SHAPES for r in runs]
        self.known.update(zip(words, range(first, first + n), strict=True))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        if not words:
            out = np.zeros((1, WIDTH), np.float32)
            out[0, 0] = 1
            return out
        if len(self.known) > 500_000:
            self._clear()
        known = self.known
        try:
            code = np.array([known[w] for w in words])
        except KeyError:
            self._learn([w for w in dict.fromkeys(words) if w not in known])
            code = np.array([known[w] for w in words])
        about = self.table[code]
        n = len(words)
        passages = max(1, -(-(n - LEAST) // PASSAGE)) if n > PASSAGE else 1
        at = np.minimum(np.arange(n) // PASSAGE, passages - 1)
        start = np.arange(passages) * PASSAGE
        count = np.diff(np.append(start, n)).astype(float)
        total = np.add.reduceat(about[:, :11], start)
        distinct = lambda x: np.bincount(np.unique(at * (int(x.max()) + 2) + x + 1) // (int(x.max()) + 2), minlength=passages)
        pairs = np.append(np.unique(code[:-1] * np.int64(len(known)) + code[1:], return_inverse=True)[1], -1)
        out = np.zeros((passages, WIDTH), np.float32)
        out[:, 1] = np.log1p(count) / 5
        out[:, 2] = total[:, 0] / count / 10
        out[:, 3:8] = total[:, 1:6] / total[:, :1]
        out[:, 8:13] = total[:, 6:11] / count[:, None]
        out[:, 13], out[:, 14] = distinct(code) / count, distinct(pairs) / count
        out[:, 15] = np.add.reduceat((about[:, 1] == about[:, 0]).astype(float), start) / count
        base = len(_STATS)
        for column, width in ((11, WORDS), (12, SHAPES)):
            found = np.bincount(at * width + about[:, column].astype(np.int64), minlength=passages * width)
            out[:, base : base + width] = np.sqrt(found.reshape(passages, width) / count[:, None])
            base += width
        return out


@dataclass
class Network:
    """Encoder, gate and score; ``scale`` normalises the inputs."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """``x`` holds the passages of texts that begin at ``start``."""
        w = self.weights
        code = np.tanh(x @ w["encode"] + w["encode_0"])
        look, gate = np.tanh(code @ w["look"]), 1 / (1 + np.exp(-(code @ w["gate"])))
        weight = (look * gate) @ w["attend"]
        text = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
        weight = np.exp(weight - np.maximum.reduceat(weight, start)[text])
        weight /= np.add.reduceat(weight, start)[text]
        mean = np.add.reduceat(weight[:, None] * code, start)
        logit = mean @ w["score"] + w["score_0"]
        return {"code": code, "look": look, "gate": gate, "weight": weight, "text": text, "mean": mean, "logit": logit}

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6)

    def scores(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.normal(x), start)["logit"], -500, 500)))

    def attention(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The weight of each passage in its text; the weights of a text sum to one."""
        return self.forward(self.normal(x), start)["weight"]

    def gradients(self, x: np.ndarray, start: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of texts and its derivatives."""
        w, f = self.weights, self.forward(x, start)
        score = 1 / (1 + np.exp(-f["logit"]))
        miss = (score - label) / len(label)
        d_mean = np.outer(miss, w["score"])
        d_weight = (f["code"] * d_mean[f["text"]]).sum(1)
        d_weight = f["weight"] * (d_weight - np.add.reduceat(f["weight"] * d_weight, start)[f["text"]])
        d_both = np.outer(d_weight, w["attend"])
        d_look = d_both * f["gate"] * (1 - f["look"] ** 2)
        d_gate = d_both * f["look"] * f["gate"] * (1 - f["gate"])
        d_code = f["weight"][:, None] * d_mean[f["text"]] + d_look @ w["look"].T + d_gate @ w["gate"].T
        d_code *= 1 - f["code"] ** 2
        loss = float(np.mean(np.logaddexp(0, np.where(label > 0, -f["logit"], f["logit"]))))
        return loss, {
            "encode": x.T @ d_code, "encode_0": d_code.sum(0), "look": f["code"].T @ d_look, "gate": f["code"].T @ d_gate,
            "attend": (f["look"] * f["gate"]).T @ d_weight, "score": f["mean"].T @ miss, "score_0": np.array(miss.sum()),
        }


def fit(bags: list[np.ndarray], labels: list[int], hidden: int = 24, epochs: int = 30, batch: int = 64, rate: float = 0.004, decay: float = 0.0005, seed: int = 11) -> Network:
    """Adam over batches of texts; the same bags in the same order give the same network."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, float)
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((1, WIDTH))
    net = Network(x.mean(0), x.std(0) + 0.05, {})
    shape = {"encode": (WIDTH, hidden), "look": (hidden, hidden), "gate": (hidden, hidden)}
    net.weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    net.weights |= {"encode_0": np.zeros(hidden), "attend": np.zeros(hidden), "score": np.zeros(hidden), "score_0": np.array(np.log(share / (1 - share)))}
    if len(set(labels)) < 2:
        return net
    net.weights["attend"], net.weights["score"] = rng.normal(0, 0.2, hidden), rng.normal(0, 0.2, hidden)
    x = net.normal(x)
    begin = np.append(0, np.cumsum([len(b) for b in bags]))
    first, second, step = {k: np.zeros_like(v) for k, v in net.weights.items()}, {k: np.zeros_like(v) for k, v in net.weights.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        pace = rate * (1 - epoch / epochs)
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in chosen])
            start = np.append(0, np.cumsum([begin[i + 1] - begin[i] for i in chosen])[:-1])
            _, found = net.gradients(x[rows], start, y[chosen])
            step += 1
            for name, g in found.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                net.weights[name] = net.weights[name] - pace * (move + (decay / rate * net.weights[name] if net.weights[name].ndim > 1 else 0))
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: ``crc32`` of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_passages(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = 4000, max_passages: int = 40_000) -> tuple[list[np.ndarray], list[int]]:
    """Bags and labels of a bounded sample of the labelled rows that are not held out."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    told = told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")).where("label = other")
    few = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select("doc_id", "label")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) / PASSAGE + 1
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(few), "doc_id")  # at most max_docs ids
    sized = texts.withColumn("size", size).where(F.col("size") <= max_passages).withColumn("order", F.xxhash64("doc_id", "text"))
    listed = sized.select("order", "doc_id", "size").distinct().orderBy("order", "doc_id").limit(max_docs).collect()
    fits = np.cumsum([r.size for r in listed]) <= max_passages
    bound = listed[int(fits.sum()) - 1].order if fits.any() else None
    if bound is None:
        return [], []

    def rows(batches: Iterator[pa.RecordBatch]):
        encode = Encoder()
        for batch in batches:
            found = [encode(t) for t in batch.column("text").to_pylist()]
            yield {"order": batch.column("order"), "doc_id": batch.column("doc_id"), "label": batch.column("label"), "bag": [b.astype(np.float32).tobytes() for b in found]}

    taken = arrow_pass(sized.where(F.col("order") <= bound).select("order", "doc_id", "label", "text").dropDuplicates(["order", "doc_id"]), rows, "order long, doc_id long, label int, bag binary").collect()
    taken.sort(key=lambda r: (r.order, r.doc_id))
    return [np.frombuffer(r.bag, np.float32).reshape(-1, WIDTH) for r in taken], [r.label for r in taken]


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, held_out, n_passages, score`` of every row."""

    def rows(batches: Iterator[pa.RecordBatch]):
        encode = Encoder()
        for batch in batches:
            if not batch.num_rows:
                continue
            bags = [encode(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(b) for b in bags])
            scores = net.scores(np.concatenate(bags).astype(np.float64), np.append(0, np.cumsum(sizes)[:-1]))
            yield {"doc_id": batch.column("doc_id"), "n_passages": sizes, "score": scores}

    found = arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n_passages long, score double", step=64)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_passages", "score")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds: int) -> DataFrame:
    """Fits on the labelled rows that are not held out and scores all: also ``predicted``."""
    net = fit(*labelled_passages(docs, labels, **bounds))
    return score(docs, net).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
