"""Quality rules that vote or abstain, with accuracies found by expectation-maximisation.

Each rule looks at one property of a text and votes good or junk, or abstains. Two latent classes
explain the votes: for each class and rule a distribution over (junk, abstain, good). All texts are
reduced to counts of vote patterns (at most ``3 ** len(RULES)``, whatever the input), EM runs on those
counts, and the posterior of a pattern replaces the demand that all rules pass.

Null texts have no words. Texts that the base test fails (too short or repetitive) are never kept. An
empty table gives an empty result. Repeated rows are judged alike, each on its own; other columns,
whatever their names, do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import SPACE, arrow_pass, materialise

JUNK, ABSTAIN, GOOD = 0, 1, 2
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_bare")
_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_NAMED = _LETTER + b"0123456789"
_SYMBOL = b"#*$%&|<>"


def _between(value: float, junk: float, good: float) -> int:
    """Junk beyond one bound, good up to the other, silent in between."""
    return JUNK if value > junk else GOOD if value <= good else ABSTAIN


#: name -> vote from the features of a text with at least one word
RULES = {
    "length": lambda f: JUNK if f["n_words"] < 20 else GOOD if f["n_words"] >= 50 else ABSTAIN,
    "symbols": lambda f: _between(f["n_symbols"] / f["n_words"], 0.1, 0.02),
    "lines": lambda f: _between(f["n_dup_lines"] / f["n_lines"], 0.3, 0.1) if f["n_lines"] >= 3 else ABSTAIN,
    "repeats": lambda f: _between(f["n_repeat_words"] / f["n_words"], 0.2, 0.1),
    "word_length": lambda f: _between(abs(f["word_chars"] / f["n_words"] - 6.5), 4.5, 3.5),
    "capitals": lambda f: _between(f["n_upper"] / max(1, f["n_letters"]), 0.5, 0.2),
    "letters": lambda f: _between(1 - f["n_letters"] / max(1, f["n_bytes"]), 0.4, 0.25),
    "bare_marks": lambda f: _between(f["n_bare"] / f["n_words"], 0.15, 0.05),
    "shouting": lambda f: _between(f["n_shouts"] / f["n_words"], 0.2, 0.05),
}


def measure(text: str | None) -> dict[str, int]:
    raw = (text or "").encode()
    text = text or ""
    words = raw.split()
    n = len(words)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            covered = 0
            for i, window in enumerate(windows):
                if often[window] > 1:
                    repeat += i + 5 - max(i, covered)
                    covered = i + 5
    bare = {w for w in set(words) if len(w.translate(None, _NAMED)) == len(w)}  # no letter, no digit
    return {
        "n_words": n,
        "word_chars": len(text) - sum(text.count(c) for c in SPACE),
        "n_symbols": len(raw) - len(raw.translate(None, _SYMBOL)),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "n_lines": lines,
        "n_upper": len(raw) - len(raw.translate(None, _UPPER)),
        "n_letters": len(raw) - len(raw.translate(None, _LETTER)),
        "n_bytes": sum(map(len, words)),
        "n_shouts": raw.count(b"!"),
        "n_bare": sum(map(bare.__contains__, words)) if bare else 0,
    }


def pattern(features: dict[str, int]) -> int:
    """The votes of all rules as one number in base three; no words: every rule abstains."""
    code = 0
    for rule in RULES.values():
        code = code * 3 + (rule(features) if features["n_words"] else ABSTAIN)
    return code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in RULES:
        code, vote = divmod(code, 3)
        out.append(vote)
    return out[::-1]


def base_fails(f: dict[str, int], min_words: int = 10, repeat_percent: int = 20) -> bool:
    return f["n_words"] < min_words or 100 * f["n_repeat_words"] > repeat_percent * f["n_words"]


def features(docs: DataFrame) -> DataFrame:
    """One pass over whole texts: ``doc_id``, the measures, the vote pattern and the base test."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [measure(t) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id")} | {c: [f[c] for f in found] for c in FEATURES} | {"pattern": [pattern(f) for f in found], "base_failed": [base_fails(f) for f in found]}

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, " + ", ".join(f"{c} long" for c in FEATURES) + ", pattern int, base_failed boolean")


@dataclass
class RuleModel:
    """What EM found: ``accuracy[rule]`` is the chance of a right vote among votes, ``posterior`` by pattern."""

    prior: float
    accuracy: dict[str, float]
    tables: np.ndarray
    threshold: float

    def posterior(self, code: int) -> float:
        logs = np.log([1 - self.prior, self.prior])
        for j, vote in enumerate(votes_of(code)):
            logs = logs + np.log(self.tables[:, j, vote])
        return float(1 / (1 + np.exp(min(700.0, logs[0] - logs[1]))))


def fit(counts: list[tuple[int, int]], threshold: float = 0.5, rounds: int = 500, tolerance: float = 1e-10) -> RuleModel:
    """EM over vote patterns and how many texts show each.

    Starts from the belief that each junk vote makes junk likelier, and keeps small Dirichlet counts
    that say so, which fixes the meaning of the two classes and keeps every probability positive.
    """
    counts = sorted(counts)
    n = np.array([c for _, c in counts], float)
    votes = np.array([votes_of(p) for p, _ in counts], int).reshape(len(counts), len(RULES))
    belief = np.where((votes == JUNK).any(1), 0.05, 0.99)
    prior_counts = np.array([[2.0, 2.0, 2.0], [0.1, 2.0, 6.0]])
    one_hot = np.eye(3)[votes]
    prior, tables = 0.9, np.repeat((prior_counts / prior_counts.sum(1, keepdims=True))[:, None, :], len(RULES), 1)
    for _ in range(rounds if len(counts) else 0):
        weight = np.stack([n * (1 - belief), n * belief])
        tables = np.einsum("cp,pjv->cjv", weight, one_hot) + prior_counts[:, None, :]
        tables /= tables.sum(2, keepdims=True)
        prior = float((weight[1].sum() + 9) / (weight.sum() + 10))
        logs = np.einsum("cjv,pjv->cp", np.log(tables), one_hot) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        moved, belief = float(np.abs(new - belief).max()), new
        if moved < tolerance:
            break
    right = (1 - prior) * tables[0, :, JUNK] + prior * tables[1, :, GOOD]
    spoken = right + (1 - prior) * tables[0, :, GOOD] + prior * tables[1, :, JUNK]
    return RuleModel(prior, dict(zip(RULES, (right / spoken).tolist(), strict=True)), tables, threshold)


def pattern_counts(found: DataFrame) -> list[tuple[int, int]]:
    """Counts over all texts; the rows that reach the driver are at most ``3 ** len(RULES)``."""
    return [(r[0], r[1]) for r in found.groupBy("pattern").count().collect()]


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Measures, posterior ``p_good`` and ``kept`` of every row."""
    found = materialise(features(docs), "quality")
    counts = pattern_counts(found)
    model = fit(counts, threshold)
    known = [(p, model.posterior(p)) for p, _ in counts]
    posterior = docs.sparkSession.createDataFrame(known, "pattern int, p_good double")
    return found.join(F.broadcast(posterior), "pattern", "left").withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged; a second pass instead of a join on ids."""
    counts = pattern_counts(features(docs.select("doc_id", "text")))
    model = fit(counts, threshold)
    good = {p for p, _ in counts if model.posterior(p) >= threshold}

    def run(batches):
        for batch in batches:
            found = [measure(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([not base_fails(f) and pattern(f) in good for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
