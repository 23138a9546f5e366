"""The prefix trie beside dictionaries of prefixes."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.llm import trie
from duelframe.llm.queries import QUERIES


def brute(conversations, rebuild=True):
    own = {}
    for c, turn, role, text in conversations:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        paths[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, m in members.items():
        gain = (len(m) - 1) * len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += node not in children
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children.get(n, 0), leaves[n], saved[n], sha(ends.get(n, []))) for n, m in members.items()),
        key=repr,
    )


def rows_of(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


def dialogues(seed, n=160, words="a b c d".split()):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-40, 4 * n), n):
        kind = rng.random()
        length = rng.choice([1, 2, 3, 5, 9]) if kind < 0.8 else rng.choice([8, 16, 17, 24, 40])
        for t in range(length):
            text = rng.choice(words) if kind < 0.5 else f"{t % 3} same" if kind < 0.9 else f"{c} {t}"
            turn = None if rng.random() < 0.03 else t if rng.random() < 0.9 else 0
            out.append((c, turn, rng.choice(["user", "user", "user", None]), rng.choice([text, text, text, None, text + " "]) if kind < 0.6 else text))
    out += rng.sample(out, 5)  # repeated rows
    out += [(None, 0, "user", "nobody"), (7_000_000_000, 1, None, None)]
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "segment", "shard"), [(1, 4096, 32_768), (2, 4096, 7), (3, 8, 5), (4, 4, 40), (5, 1, 16)])
def test_nodes_are_those_of_a_dictionary(spark, monkeypatch, seed, segment, shard):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "SHARD_ROWS", shard)
    given = dialogues(seed)
    turns = spark.createDataFrame(given, SCHEMA).repartition(6)
    placed = trie.turns_in_order(turns)
    found = trie.nodes(*trie.branched(placed, 20, 3, F.crc32(F.col("conv_id").cast("string")) % 4))
    assert rows_of(found) == brute(given)
    assert rows_of(trie.prefix_trie(turns)) == brute(given, rebuild=False)


def test_empty_table_and_clashing_columns(spark):
    given = dialogues(9, 30)
    columns = ", ".join(f"{c} string" for c in ("place", "digest", "words", "part", "level", "root", "path", "n", "base", "head"))
    wide = spark.createDataFrame([(*g, *["x"] * 10) for g in given], f"{SCHEMA}, {columns}")
    assert rows_of(trie.prefix_trie(wide)) == brute(given, rebuild=False)
    assert trie.prefix_trie(wide.limit(0)).count() == 0


def test_query_over_the_whole_table(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op11_prefix_trie"](spark, sf)) == brute(given)


def test_findclose_beside_a_stack():
    rng = np.random.default_rng(3)
    for size in (1, 5, 40, 700, 20_000):
        depth, marks = 0, []
        for _ in range(size):
            up = depth == 0 or rng.random() < (0.5 if size < 1000 else 0.8 if len(marks) < size / 3 else 0.3)
            marks.append(up)
            depth += 1 if up else -1
        marks += [False] * depth
        stack, want = [], {}
        for i, up in enumerate(marks):
            if up:
                stack.append(i)
            else:
                want[stack.pop()] = i
        found = trie.Parentheses(np.array(marks))
        at = np.array(sorted(want))
        assert found.findclose(at).tolist() == [want[i] for i in at.tolist()]
