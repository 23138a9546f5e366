"""Fill-in-the-middle beside plain string work."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from duelframe.llm import middle
from duelframe.llm.queries import QUERIES


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, a, b - a, sha(out), sha(text))


def texts(seed=5):
    rng = random.Random(seed)
    shared = "".join(rng.choice("abc déß漢🙂\n<>PSM") for _ in range(9000))
    out = [None, "", "a", "🙂", "<", "<P", "<S>", "x<M>y", " \t", "é" * 5000, shared, shared + shared, "q" * 30_000, "<P" * 3000]
    out += [shared[rng.randrange(8000) :][: rng.choice([3, 50, 700, 6000])] + rng.choice(["", "tail", "<P", "<P>"]) for _ in range(60)]
    return out


def test_forms_cuts_and_round_trip(spark):
    given = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts())] + [(3, "one", "x", 1), (3, "one", "x", 1)]
    docs = spark.createDataFrame(given, "doc_id long, text string, output string, n int")
    made = middle.fill_in_middle(docs)
    seen = [(r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.o, r.r) for r in made.select("*", F.sha2("output", 256).alias("o"), F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("r")).collect()]
    assert sorted(seen, key=repr) == sorted((brute(i, t) for i, t, *_ in given), key=repr)
    assert {"plain", "psm", "spm"} == {s[2] for s in seen}
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_query_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    seen = [tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in QUERIES["op12_fill_in_middle"](spark, sf).collect()]
    assert sorted(seen) == sorted(brute(r.doc_id, r.text) for r in docs)


@pytest.mark.parametrize("unit", ["chars", "words"])
def test_summaries_combine_to_whole_texts(monkeypatch, unit):
    monkeypatch.setattr(middle, "SHORTEST", 5)
    monkeypatch.setattr(middle, "LONGEST", 40)
    monkeypatch.setattr(middle, "ONE_IN", 8)
    monkeypatch.setattr(middle, "SLICE", 64)
    cutter = middle.Cutter(unit)
    for text in texts(6):
        text = text or ""
        raw = text.encode()
        cuts = cutter(raw)
        assert cuts.ends[-1] == len(raw) and all(a < b for a, b in zip(cuts.ends, cuts.ends[1:], strict=False))
        assert cuts.marked == any(m in text for m in middle.MARKS)
        want = list(text) if unit == "chars" else raw.split()
        assert cuts.units == len(want)
        for k in {0, 1, len(want) // 3, len(want) - 1, len(want)} & set(range(len(want) + 1)):
            head, tail = raw[: cuts.at(k)], raw[cuts.at(k) :]
            both = (list(head.decode()), list(tail.decode())) if unit == "chars" else (head.split(), tail.split())
            assert both == (want[:k], want[k:])


def test_chunks_follow_content_and_are_counted_once(monkeypatch):
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefgh ") for _ in range(200_000)).encode()
    cutter = middle.Cutter()
    counted = []
    begins = cutter.begins
    monkeypatch.setattr(cutter, "begins", lambda chunk, open_=False: counted.append(len(chunk)) or begins(chunk, open_))
    cutter(body)
    first = sum(counted)
    assert first == len(body)
    cutter(b"another beginning " + body)
    assert sum(counted) - first < 0.1 * len(body)  # the cuts find their places again
