"""The passage classifier: derivatives, planted labels, held-out accuracy, odd input."""

import random
import zlib

import numpy as np
import pytest

from duelframe.llm import attention
from duelframe.llm.queries import QUERIES


def test_derivatives_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    x, start, label = rng.normal(size=(9, attention.WIDTH)), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])
    net = attention.fit([x[:1].astype(np.float32), x[1:].astype(np.float32)], [1, 0], hidden=5, epochs=1)
    loss, found = net.gradients(x, start, label)
    for name, g in found.items():
        flat, at = net.weights[name].reshape(-1), int(rng.integers(g.size))
        net.weights[name] = flat.copy().reshape(net.weights[name].shape)
        net.weights[name].reshape(-1)[at] += 1e-6
        more, _ = net.gradients(x, start, label)
        net.weights[name].reshape(-1)[at] -= 2e-6
        less, _ = net.gradients(x, start, label)
        net.weights[name].reshape(-1)[at] += 1e-6
        assert (more - less) / 2e-6 == pytest.approx(g.reshape(-1)[at], abs=1e-6), name
    assert np.add.reduceat(net.attention(x, start), start) == pytest.approx(1)
    assert loss > 0


def test_one_bad_passage_decides_and_gets_the_attention():
    """Texts of clean passages are good; one shouted passage anywhere makes a text bad."""
    rng = random.Random(4)
    words = ["word" + c for c in "abcdefghijkl"]

    def text(bad, passages):
        parts = [[rng.choice(words) for _ in range(attention.PASSAGE)] for _ in range(passages)]
        if bad:
            at = rng.randrange(passages)
            parts[at] = [w.upper() + "!!" for w in parts[at]]
        return " ".join(w for p in parts for w in p), at if bad else None

    encode = attention.Encoder()
    made = [(text(i % 2, rng.randint(1, 8)), 1 - i % 2) for i in range(500)]
    bags = [encode(t) for (t, _), _ in made]
    net = attention.fit(bags[:300], [y for _, y in made[:300]])
    right = seen = 0
    for bag, ((_, at), y) in zip(bags[300:], made[300:], strict=True):
        assert (net.scores(bag, np.array([0]))[0] >= 0.5) == (y == 1)
        if at is not None and len(bag) > 1:
            seen += 1
            right += int(net.attention(bag, np.array([0])).argmax()) == at
    assert right >= 0.9 * seen > 0


def test_held_out_accuracy_and_whole_table(spark, sf):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op13_quality_classifier"](spark, folder).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert found.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    labels = [(found[r.doc_id], r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in found]
    held = [(r, q) for r, q in labels if r.held_out]
    good, bad = [r.score for r, q in held if q == 1], [r.score for r, q in held if q == 0]
    above = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert above >= 0.95 and np.mean([r.predicted == q for r, q in held]) >= 0.93
    again = {r.doc_id: r.score for r in QUERIES["op13_quality_classifier"](spark, folder).collect()}
    assert again == {i: r.score for i, r in found.items()}


def test_scores_do_not_depend_on_id_source_or_neighbours(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    net = attention.fit(*attention.labelled_passages(docs, labels))
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + [None, "", " \n", "x" * 70_000, "a " * 50_000, "🙂", "one"]
    given = [(i, t, "s", 1.0) for i, t in enumerate(texts)] + [(None, "one", "z", 2.0), (0, texts[0], "y", 3.0)]
    seen = attention.score(spark.createDataFrame(given, "doc_id long, text string, source string, score double").repartition(3), net).collect()
    encode = attention.Encoder()
    alone = {t: float(net.scores(encode(t).astype(float), np.array([0]))[0]) for t in texts}
    assert len(seen) == len(given)
    for r in seen:
        assert r.score == pytest.approx(alone[texts[r.doc_id] if r.doc_id is not None else "one"], abs=1e-9)
    assert attention.score(docs.limit(0), net).count() == 0


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in attention.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")  # labels that disagree
    assert {r.score for r in attention.classify(docs, one).collect()} == {0.5}
    assert attention.classify(docs.limit(0), none).count() == 0


def test_held_out_labels_are_never_read(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.withColumn("quality", attention.F.when(attention.held_out(attention.F.col("doc_id")), 1 - attention.F.col("quality")).otherwise(attention.F.col("quality")).cast("int"))
    a, b = ({r.doc_id: r.score for r in attention.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_the_sample_is_bounded(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    bags, y = attention.labelled_passages(docs, labels, max_docs=50, max_passages=60)
    assert 0 < len(bags) <= 50 and sum(map(len, bags)) <= 60 and len(bags) == len(y)
