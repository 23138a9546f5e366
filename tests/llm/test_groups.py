"""Near duplicates, repeated passages, mixing, dialogues and URLs beside brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from duelframe.llm import chat, common, jaccard, mixing, passages, urls, vectors
from duelframe.llm.queries import RULES


def components(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_connected_components(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(3, 3)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    real = [p for p in pairs if p[0] != p[1]]
    want = components({x for p in real for x in p}, real)
    assert dict(map(tuple, common.connected_components(edges).collect())) == want
    assert common.connected_components(edges.limit(0)).count() == 0


def texts_with_copies(seed, families=12, size=9):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(1, 4)))
    shared = [word() for _ in range(55)]
    out = []
    for _ in range(families):
        base = [word() for _ in range(draw.choice([3, 6, 7, 20, 60, 200]))] + draw.choice([[], shared])
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(copy) // 40))):
                copy[draw.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return [*out, *out[:10], None, "", " \n", "one", "ONE", "one two", "a b c d"]


def brute_jaccard(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    at, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            shared.update((o, i) for o in at[g])
            at[g].append(i)
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


def check_jaccard(spark, size, percent):
    rows = list(enumerate(texts_with_copies(size)))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(4, rows[4][1], "x", 1), (None, "no id at all here", "x", 1)], "doc_id long, text string, digest string, n int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.links(docs, size, percent).collect()}
    assert got.pop(None)[1] is None
    assert got == brute_jaccard(rows, size, percent)
    kept = jaccard.one_of_each(docs, size, percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c} | {None}


def test_jaccard_join(spark):
    check_jaccard(spark, 4, 85)
    assert jaccard.links(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_join_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 3)
    monkeypatch.setattr(jaccard, "CLUSTER_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "BITS", 64)
    monkeypatch.setattr(jaccard, "TASK_TEXTS", 2)
    monkeypatch.setattr(jaccard, "COMMON_TEXTS", 3)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    check_jaccard(spark, 2, 80)


def test_routing_keys_lose_no_pair():
    draw, levels = np.random.default_rng(1), jaccard.Levels(80)
    for _ in range(1500):
        n = int(draw.integers(1, 120))
        a = draw.integers(0, 2**63, n, dtype=np.uint64)
        b = a.copy()
        b[: int(draw.integers(0, max(1, n // 8) + 1))] = draw.integers(0, 2**63, dtype=np.uint64)
        b = np.append(b, draw.integers(0, 2**63, int(draw.integers(0, n // 8 + 1)), dtype=np.uint64))
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert set(levels.keys(a)) & set(levels.keys(b))
            for share in (2, 3, 20):  # under any marks that are the same for all texts
                assert set(levels.keys(a, a % np.uint64(share) == 0)) & set(levels.keys(b, b % np.uint64(share) == 0))
                assert set(levels.keys(a, a % np.uint64(share) != 0)) & set(levels.keys(b, b % np.uint64(share) != 0))


def test_vectors(spark, monkeypatch):
    draw = np.random.default_rng(2)
    base = draw.standard_normal((150, 24))
    near = np.concatenate([base[:3].repeat(40, 0), base[3:60]]) + 0.03 * draw.standard_normal((177, 24))
    rows = [(i, v.tolist(), int(i % 2), "x") for i, v in enumerate(np.concatenate([base, near, base[:20], base[:20] * 3]))]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [1.0, 2.0], base[0].tolist()]
    rows += [(1000 + i, v, 0 if i < 6 else None, "x") for i, v in enumerate(odd)] + [rows[0], (None, base[0].tolist(), 0, "x")]
    monkeypatch.setattr(vectors, "CHUNK", 16)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key string").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()}
    assert got.pop(None) == (0, None)
    plain = {i: (np.array(v), lab) for i, v, lab, _ in rows[:-2] if i < 1000}
    links = [(a, b) for a in plain for b in plain if a < b and plain[a][1] == plain[b][1] and plain[a][0] @ plain[b][0] / np.linalg.norm(plain[a][0]) / np.linalg.norm(plain[b][0]) >= 0.98]
    degree = Counter(x for p in links for x in p)
    found = sum(n for n, _ in got.values())
    assert all(n <= degree[i] for i, (n, _) in got.items()) and found >= 0.999 * 2 * len(links) > 2000
    if found == 2 * len(links):
        assert got == {i: (degree[i], c) for i, c in components(got, links).items()}
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_codes_estimate_without_bias():
    draw = np.random.default_rng(4)
    units = draw.standard_normal((400, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    close = units + 0.02 * draw.standard_normal(units.shape)
    close /= np.linalg.norm(close, axis=1, keepdims=True)
    cosine = (units * close).sum(1)
    may = np.diag(vectors.possible(units, close, 0.98, 1.0))
    assert may[cosine >= 0.98].all()
    assert vectors.possible(units, units[::-1], 0.98, 1.0).mean() < 0.02  # unrelated pairs are ruled out


def test_passages(spark):
    draw = random.Random(9)
    sentence = lambda n: " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(n)).capitalize() + "."
    passage = "\n".join(sentence(17) for _ in range(4))
    inline = " ".join(sentence(12) for _ in range(5))
    license_ = sentence(8)
    own = lambda: "\n".join(sentence(14) for _ in range(3))
    made = [own() + "\n" + passage + "\n" + own(), own() + " " + inline + " " + own(), license_ + "\n" + own(), passage.upper() + "\nOh. " + inline, own() + " " + inline + " " + own() + "\n" + license_, own(), None, ""]
    rows = [(10 + i, t, 1) for i, t in enumerate(made)] + [(13, made[3], 1), (None, passage, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int").repartition(3)
    got = {(r.doc_id, r.starts, r.ends) for r in passages.repeated(docs.dropDuplicates()).collect()}
    assert {(d, made[d - 10][s:e].strip()) for d, s, e in got} == {(13, made[3]), (14, inline)}
    cut = {r.doc_id: r.text for r in passages.without_repeats(docs.dropDuplicates()).collect()}
    assert cut[13] == "" and inline not in cut[14] and license_ in cut[14] and cut[10] == made[0] and cut[16] is None
    assert passages.repeated(docs.limit(0)).count() == 0


def test_mix_reaches_targets_and_repeats(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(["w"] * draw.randint(0, 40)), draw.choice(["a"] * 30 + ["b", "c", "d", None]), i, "x") for i in range(3000)]
    rows += [(5000, None, "a", 1, "x"), (5001, "", "void", 1, "x"), (None, "no id", "b", 1, "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string").repartition(4)
    got = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    words = Counter()
    for _, t, s, *_ in rows:
        words[s] += len((t or "").split())
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight, rest, full, target = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(words.values()), set(), {}
    while True:
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * words[s]]
        if not over:
            break
        full.update(over)
        rest -= sum(3 * words[s] for s in over)
    target = {s: 3.0 * words[s] if s in full else share[s] for s in order}
    source = {i: s for i, _, s, *_ in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == words[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 120 for s in order)
    assert sum(taken.values()) <= sum(words.values())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sum(len((r.text or "").split()) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_perspectives(spark, monkeypatch):
    rows = [(1, t, s, f"{s} says {t}", "x") for t, s in enumerate(["ann", "system", "bob", "ann", "cy", None, "bob", "ann"])]
    rows += [(2, 0, "ann", None, "x"), (2, 0, "ann", None, "x"), (3, 0, "system", "alone", "x"), (None, 1, "u", "lost", "x"), (None, 1, "v", "lost", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")
    whole = sorted(map(repr, chat.rotate(turns).collect()))
    monkeypatch.setattr(chat, "RANGE", 2)  # places carry over ranges of turns
    segments = chat.rotate(turns)
    assert sorted(map(repr, segments.collect())) == whole
    told = {(r.conv_id, r.perspective): (r.text, r["mask"]) for r in chat.dialogues(segments).collect()}
    assert set(told) == {(1, "ann"), (1, "bob"), (1, "cy"), (1, "unknown"), (2, "ann")}
    text, mask = told[1, "ann"]
    assert text.startswith("<|assistant|>\nann says 0<|end|>\n<|system|>\nsystem says 1<|end|>\n<|user:bob|>\nbob says 2<|end|>\n")
    assert [text[m.starts : m.ends] for m in mask] == [f"ann says {k}<|end|>\n" for k in (0, 3, 7)]
    assert told[2, "ann"][0] == "<|assistant|>\n<|end|>\n"
    assert segments.where("conv_id IS NULL").count() == 2
    assert chat.rotate(turns.limit(0)).count() == 0


def test_url_filter(spark):
    given = [
        "http://Foo.NET/", "http://foo.net", "https://a.example.net/en/x", "https://example.net/de/", "http://x.example.com/de/1?a=1",
        "http://notexample.com/de/", "http://w.org/fr/", "http://spam.test/p?b=2&a=1&utm_source=z#top", "http://www.spam.test:80/p/?a=1&b=2",
        "http://spam.test/p?a=1", None, "", "no scheme", "http://", "http://spam.test/p?b=2&a=1&utm_source=z#top",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(given)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://spam.test/p?a=1&b=2&ref=q",), (None,), ("nothing",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed, RULES).collect()}
    assert got[0] == ("foo.net", "/", "net/", "block") and got[1] == ("foo.net", "", None, "allow")
    assert got[2] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[3][2:] == ("net/", "block")
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == (None, "allow") and got[6][2:] == ("org/fr/", "allow")
    assert [got[i][3] for i in (7, 8, 9, 14)] == ["block", "block", "allow", "block"]
    assert [got[i] for i in (10, 11, 12, 13)] == [("", "", None, "allow")] * 4
    many = spark.range(3000).selectExpr("concat('http://h/', id) AS k")
    blocks = urls.bloom_blocks(many, "k")
    assert urls.possible_hits(many, "k", blocks).count() == 3000
    assert urls.possible_hits(spark.range(5000).selectExpr("concat('http://g/', id) AS k"), "k", blocks).count() < 150
    assert urls.judge(pages.limit(0), listed.limit(0), []).count() == 0


def test_rows_without_id_and_ids_of_several_texts_keep_their_links(spark):
    draw = random.Random(11)
    text = lambda: [f"w{draw.randrange(10**6)}" for _ in range(60)]
    joined = lambda words, k: " ".join([*words[:-k], *(["other"] * k)]) if k else " ".join(words)
    a, b, c = text(), text(), text()
    rows = [(None, joined(a, 0)), (1, joined(a, 0)), (2, joined(a, 2))]  # the row without id comes first in the task
    rows += [(10, joined(b, 0)), (20, joined(b, 0)), (20, joined(c, 0)), (30, joined(c, 2))]  # 20 copies 10, and is near 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in jaccard.links(docs, 4, 80).collect()}
    assert got == {(None, None), (1, 1), (2, 1), (10, 10), (20, 10), (30, 10)}


def test_passages_with_repeated_rows_and_ids_of_several_texts(spark):
    draw = random.Random(12)
    sentence = lambda n: " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(12) for _ in range(5))
    own = [sentence(14) for _ in range(6)]
    rows = [(1, f"{own[0]} {passage}")] * 2 + [(2, f"{own[1]}\n{passage} {own[2]}")] * 3 + [(3, own[3]), (3, f"{passage} {own[4]}"), (4, own[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = {2: rows[2][1], 3: rows[6][1]}
    got = [(r.doc_id, texts[r.doc_id][r.starts : r.ends].strip(), r.n_units, r.n_words, r.first_doc_id) for r in passages.repeated(docs).collect()]
    assert sorted(got) == [(2, passage, 5, 60, 1), (3, passage, 5, 60, 1)]
    cut = sorted((r.doc_id, r.text.split()) for r in passages.without_repeats(docs).collect())
    assert cut == sorted((i, t.replace(passage, "").split() if i > 1 else t.split()) for i, t in rows)


def test_one_row_of_each_document_stays(spark):
    draw = random.Random(13)
    text = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a)] * 4 + [(2, near)] * 3 + [(3, b), (3, b.upper()), (3, c), (None, d), (None, d), (None, text()), (None, ""), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(5)
    kept = jaccard.one_of_each(docs, 5, 80)
    assert kept.schema == docs.schema
    got = Counter((r.doc_id, (r.text or "").lower()) for r in kept.collect())
    assert got == Counter([(1, a), (3, b), (3, c), (None, d), (None, rows[12][1]), (None, ""), (None, ""), (4, "")])


def test_passages_are_those_of_two_loops(spark, sf):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(400).collect()]
    top = max(i for i, _ in given)
    half = lambda t: t[len(t) // 3 :]
    given += [(top + 1 + k, f"New words stand here. {half(t)}\n{half(t)}") for k, (_, t) in enumerate(given[:20]) if t]
    units = {}
    for i, t in given:
        units[i], at = [], 0
        for m in [*re.finditer(r"[.!?]+(?=\s|\Z)|\n", t or ""), None]:
            end = len(t or "") if m is None else m.start() if m.group() == "\n" else m.end()
            words = (t or "")[at:end].encode().lower().split()
            if len(words) >= 3:
                units[i].append((at, end, words))
            at = end if m is None else m.end()
    first, want = {}, []
    for i in sorted(units):
        run = []
        for unit in [*units[i], None]:
            key = unit and b" ".join(unit[2])
            if unit and key in first:
                run.append((*unit, first[key]))
                continue
            if sum(len(w) for _, _, w, _ in run) >= 30:
                want.append((i, run[0][0], run[-1][1], len(run), sum(len(w) for _, _, w, _ in run), min(f for *_, f in run)))
            run = []
            if unit:
                first[key] = i
    docs = spark.createDataFrame(given + given[:50] + given[-8:] * 2, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, passages.repeated(docs).collect())) == sorted(want) and len(want) > 10


def test_columns_of_any_name_and_type(spark):
    names = ["_digest", "_row", "_cut", "_copy", "_source", "_size", "removed", "_id", "_version", "rep", "c", "g", "key"]
    text = "one two three four five six seven eight nine ten. " * 2
    given = [(i % 5, text if i % 5 < 3 else f"{text} {i} other words", "s", i, *[f"v{i}"] * len(names), {"a": i}) for i in range(8)] + [(None, text, None, 9, *["z"] * len(names), {"b": 1})]
    schema = "doc_id long, text string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names) + ", notes map<string,int>"
    docs = spark.createDataFrame(given, schema)
    kept = jaccard.one_of_each(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {0, 3, 4, None}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and all(getattr(r, "_copy")[0] in "vz" for r in mixed.collect())
    cut = passages.without_repeats(docs, min_words=5)
    assert sorted(cut.columns) == sorted(docs.columns) and cut.count() == docs.count()
    assert {type(r.removed) for r in cut.collect()} <= {list, type(None)}


def test_shingles_look_a_word_up_once():
    shingle = jaccard.Shingler(2)
    assert shingle.known[b"new"] == xxhash.xxh3_64_intdigest(b"new")  # made where it is missing, without a second pass
    found = shingle("A b a B a b c")
    assert len(found) == 3 and (found[1:] > found[:-1]).all() and found.tolist() == sorted(set(shingle("a b c").tolist()) | set(shingle("b a").tolist()))
    assert len(shingle("one")) == 1 and not len(shingle(None))
