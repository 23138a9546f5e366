"""Exact n-gram Jaccard join: routing keys, signature trees with dual traversal, linked components.

1. Each text becomes a set of hashed word shingles; equal sets are one class.
2. A set sends its first shingles as routing keys, by an order that all sets share: uncommon ones first,
   so that unrelated texts rarely meet, even if they share a passage. It sends one more than a partner may
   lack, so partners send a key in common, and nothing is lost. Sizes fall into levels, and keys into those
   of a set's own level and of the next, so that sets of other sizes do not meet.
3. In each group a signature tree holds bitmaps of the sets, OR- and AND-combined in its nodes, with
   ranges of sizes. Traversing frontier nodes against the tree prunes node pairs by the largest overlap
   that bitmaps and sizes leave possible. What survives joins candidates into clusters.
4. Each cluster is traversed again with the sets themselves, and pairs are decided exactly. Texts that
   are linked already are not compared again, so a family of thousands costs little more than its size.

Groups and clusters beyond a bound are cut into chunks that meet in pairs. Shingles and sets are known
by hashes of 64 and 128 bits. A null or wordless text has an empty set and links with nothing. A row
with a null id has a null component. Rows with equal ids are one node of the link graph. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.common import arrow_pass, chunk_pairs, connected_components, join_ids, materialise, own_names, sorted_groups

#: Shingles in so many texts of a task, and of the corpus, are common; bits that mark them.
TASK_TEXTS, COMMON_TEXTS, COMMON_BITS = 4, 64, 1 << 23
#: Least bits of a signature; rows of a group, and shingles of a cluster, that a task takes in one chunk.
BITS, GROUP_ROWS, CLUSTER_SHINGLES = 1024, 4096, 2_000_000
LEAF, FRONTIER = 32, 64
#: A routing key is frequent if a task meets it so often among so many keys.
FREQUENT, HELD_KEYS = 16, 2_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class Codes(dict):
    """Hashes of words, made at their first use."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


class Shingler:
    """Sorted distinct hashes of the word shingles of a text; hashes of words are remembered."""

    def __init__(self, size: int):
        self.size, self.known = size, Codes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # ASCII letters only
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(codes):
            return codes
        width = min(self.size, len(codes))
        out = np.full(len(codes) - width + 1, width, np.uint64)
        for k in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(out)])
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


class Levels:
    """Levels of set sizes: partners lie in the same or neighbouring ones. Below ``n``, ``p`` is the percent."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]
        while self.starts[-1] < 2**40:
            self.starts.append(self.starts[-1] * 100 // percent + 1)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def keys(self, hashes: np.ndarray, common: np.ndarray | None = None) -> list[int]:
        """Routing keys of a set: its first shingles; ``common`` marks widely shared ones, which come last.

        Partners share at least ``p * n / 100`` shingles, and one that is no smaller shares at least
        ``2 * p * n / (100 + p)``. A set sends one shingle more than may be missing there, by an order that
        all sets share, so partners send one in common: for its own level, where partners may be smaller,
        by the first bound, and for the next one, where they are larger, by the second.
        """
        n, p = len(hashes), self.percent
        if 100 * n < p * (n + 1):
            return []  # only equal sets are similar enough
        ordered = hashes if common is None else np.concatenate([hashes[~common], hashes[common]])
        level = self.of(n)
        sent = [(level, n + 1 + -p * n // 100), (level + 1, n + 1 + -2 * p * n // (100 + p))]
        return np.concatenate([mix(ordered[:k] ^ mix(np.uint64(of) << np.uint64(32))) for of, k in sent]).view(np.int64).tolist()


def signature(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of at least four bits a shingle; the width is a power of two."""
    width = max(BITS, 1 << math.ceil(math.log2(4 * max(1, len(hashes)))))
    bits = np.zeros(width, bool)
    bits[hashes & np.uint64(width - 1)] = True
    return np.packbits(bits).view(np.uint64)


def one_width(maps: list[bytes]) -> np.ndarray:
    """Bitmaps folded to the narrowest of them, one a row."""
    narrow = min(map(len, maps)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, narrow)) for m in maps])


class Tree:
    """Nodes over sets sorted by size: leaves of ``LEAF`` sets, above them nodes of ``LEAF`` leaves."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        self.levels = [(sizes, sizes, maps, maps)]  # smallest and largest size, OR and AND of the bitmaps
        while len(self.levels[-1][0]) > LEAF:
            low, high, any_, all_ = self.levels[-1]
            cut = np.arange(0, len(low), LEAF)
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.bitwise_or.reduceat(any_, cut), np.bitwise_and.reduceat(all_, cut)))


def _may_link(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """Whether node pairs (rows of ``a`` against rows of ``b``) may hold a linked pair, by the overlap left possible."""
    (low_a, high_a, any_a, all_a), (low_b, high_b, any_b, all_b) = a, b
    missing = lambda all_, any_: np.bitwise_count(all_ & ~any_).sum(-1, dtype=np.int64)
    overlap = np.minimum(high_a[:, None] - missing(all_a[:, None], any_b[None]), high_b[None] - missing(all_b[None], any_a[:, None]))
    return (100 + percent) * overlap >= percent * (low_a[:, None] + low_b[None])


def clusters(sizes: np.ndarray, maps: np.ndarray, percent: int, exact: Callable | None = None) -> np.ndarray:
    """For each set the first set of its cluster, linking pairs that the bound, then ``exact``, leave.

    A frontier of linked sets, as one node, descends the tree of all sets that are not yet reached.
    Every set is in the frontier once, so every pair that is not already connected is considered.
    """
    order = np.argsort(sizes, kind="stable")
    tree = Tree(sizes[order], maps[order])
    n = len(order)
    root = np.full(n, -1)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        queue = [seed]
        while queue:
            front, queue = np.array(queue[:FRONTIER]), queue[FRONTIER:]
            s, m = tree.levels[0][0][front], tree.levels[0][2][front]
            node = (s.min(keepdims=True), s.max(keepdims=True), np.bitwise_or.reduce(m, keepdims=True), np.bitwise_and.reduce(m, keepdims=True))
            at = np.arange(len(tree.levels[-1][0]))
            for depth in range(len(tree.levels) - 1, 0, -1):
                level = tuple(x[at] for x in tree.levels[depth])
                at = at[_may_link(node, level, percent)[0]]
                below = len(tree.levels[depth - 1][0])
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < below]
            at = at[root[at] < 0]
            if not len(at):
                continue
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                a, b = np.nonzero(_may_link((s, s, m, m), tuple(x[part] for x in tree.levels[0]), percent))
                for i in np.unique(a):
                    near = part[b[a == i]]
                    near = near[root[near] < 0]
                    if exact is not None and len(near):
                        near = near[exact(order[front[i]], order[near])]
                    root[near] = seed
                    queue += near.tolist()
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def common_shingles(docs: DataFrame, size: int) -> bytes:
    """A bitmap, of fixed size, of shingles that many texts share.

    Each task counts its own texts and passes on what it saw several times; equal texts count once
    there. Marks may be missing or too many: routing is exact under any marks that are the same for
    all texts, they only keep unrelated texts apart.
    """

    def rows(batches: Iterator[pa.RecordBatch]):
        shingle, held, some, seen = Shingler(size), [], 0, set()

        def counted():
            found, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= TASK_TEXTS
            return {"hash": found[often].view(np.int64), "texts": times[often]}

        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = shingle(text)
                digest = hash(found.tobytes())
                if digest not in seen:
                    held.append(found)
                    some += len(found)
                    if len(seen) < 1_000_000:
                        seen.add(digest)
                if some > 4_000_000:
                    yield counted()
                    held, some = [], 0
        if held:
            yield counted()

    shared = arrow_pass(docs.select("text"), rows, "hash long, texts long").groupBy("hash").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= COMMON_TEXTS)
    at = F.col("hash").bitwiseAND(F.lit(COMMON_BITS - 1))
    words = shared.select(F.shiftright(at, 5).alias("word"), F.expr(f"shiftleft(1L, cast(hash & {COMMON_BITS - 1} & 31 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marks = np.zeros(COMMON_BITS // 32, np.uint32)
    for word, bits in words.collect():  # at most COMMON_BITS / 32 rows
        marks[word] = bits
    return marks.tobytes()


def sets_of(docs: DataFrame, size: int, percent: int, common: bytes) -> DataFrame:
    """``doc_id, n, digest, keys``: keys only once in a task for equal sets with ids, none for an empty set."""

    def rows(batches: Iterator[pa.RecordBatch]):
        shingle, levels, sent = Shingler(size), Levels(percent), set()
        marks = np.unpackbits(np.frombuffer(common, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            n, digests, keys = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = shingle(text)
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                sends = digest is not None and doc_id is not None and digest not in sent
                n.append(len(found))
                digests.append(digest)
                keys.append(levels.keys(found, marks[found & np.uint64(COMMON_BITS - 1)]) if sends else None)
                if sends and len(sent) < 1_000_000:
                    sent.add(digest)
            yield {"doc_id": batch.column("doc_id"), "n": n, "digest": digests, "keys": keys}

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n long, digest binary, keys array<long>")


def key_groups(keyed: DataFrame) -> DataFrame:
    """``g, doc_id``: the texts that share a routing key; keys of the same members are one group.

    Keys that a task meets often are counted where their rows are, and looked up in those counts. Only
    the others are brought together by key, and each has fewer rows than ``FREQUENT`` for every
    ``HELD_KEYS`` keys of the corpus.
    """

    def rows(batches: Iterator[pa.RecordBatch]):
        held, some = [], 0

        def often():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            return {"key": keys[times >= FREQUENT]}

        for batch in batches:
            held.append(batch.column("keys").flatten().to_numpy())
            some += len(held[-1])
            if some >= HELD_KEYS:
                yield often()
                held, some = [], 0
        if held:
            yield often()

    frequent = materialise(arrow_pass(keyed.where("keys IS NOT NULL").select("keys"), rows, "key long").distinct(), "frequent-keys")
    flat = keyed.select("doc_id", F.explode("keys").alias("key"))
    members = F.xxhash64("c", "x", "m").alias("g")
    told = {"c": F.count("*"), "x": F.expr("bit_xor(xxhash64(doc_id))"), "m": F.min("doc_id")}
    counts = materialise(join_ids(flat, frequent, "left_semi").groupBy("key").agg(*[v.alias(n) for n, v in told.items()]).where("c > 1").select("key", members), "key-counts")
    by_key = Window.partitionBy("key")
    rest = join_ids(flat, frequent, "left_anti").select("doc_id", *[v.over(by_key).alias(n) for n, v in told.items()])
    return join_ids(flat, counts, "inner").select("g", "doc_id").union(rest.where("c > 1").select(members, "doc_id")).distinct()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``rep, n, signature, hashes`` of some texts."""

    def rows(batches: Iterator[pa.RecordBatch]):
        shingle = Shingler(size)
        for batch in batches:
            found = [shingle(t) for t in batch.column("text").to_pylist()]
            yield {"rep": batch.column("rep"), "n": [len(h) for h in found], "signature": [signature(h).tobytes() for h in found], "hashes": [h.tobytes() for h in found]}

    return arrow_pass(docs.select("rep", "text"), rows, "rep long, n long, signature binary, hashes binary")


def _edges(dealt: DataFrame, key: str, decide: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Links ``(a, b)`` from each set of a group to the first of its cluster."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for group in sorted_groups(batches, [key, "lo", "hi"]):
            if group.num_rows > 1:
                rep = group["rep"].to_numpy()
                first = rep[decide(group)]
                yield {"a": rep[rep != first], "b": first[rep != first]}

    order = [key, "lo", "hi"]
    return arrow_pass(dealt.repartition(*order).sortWithinPartitions(*order), rows, "a long, b long", step=8192)


def links(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    found = materialise(sets_of(docs, size, percent, common_shingles(docs, size)), "sets")
    named = found.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialise(named.select("doc_id", "digest").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "classes")
    # ids of several sets stand for none of them: their rows are known by the class of the row's own set
    mixed = named.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo <> hi")
    mixed = materialise(mixed.select("doc_id"), "mixed-ids")
    single = join_ids(named, mixed, "left_anti")
    several = materialise(join_ids(named, mixed, "left_semi").join(classes, "digest").select("doc_id", "rep", "keys"), "several-sets")
    copies = classes.where("c > 1").join(single.select("doc_id", "digest"), "digest").where("doc_id <> rep").select("doc_id", "rep")

    groups = key_groups(single.select("doc_id", "keys").union(several.select("rep", "keys")))
    groups = materialise(groups.join(copies, "doc_id", "left").select("g", F.coalesce("rep", "doc_id").alias("rep")).distinct(), "groups")
    needed = materialise(groups.select("rep").distinct(), "needed")
    texts = join_ids(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), needed, "left_semi")
    again = materialise(named.groupBy(F.col("doc_id").alias("rep")).agg(F.count("*").alias("c")).where("c > 1").select("rep"), "repeated-ids")
    once = signatures(join_ids(texts, again, "left_anti"), size)
    known = materialise(once.union(signatures(join_ids(texts, again, "left_semi").distinct(), size).dropDuplicates(["rep", "hashes"])), "signatures")

    def bounded(group: pa.Table) -> np.ndarray:
        return clusters(group["n"].to_numpy(), one_width(group["signature"].to_pylist()), percent)

    dealt = chunk_pairs(groups, "g", "rep", GROUP_ROWS).join(known.drop("hashes"), "rep")
    cluster = materialise(connected_components(materialise(_edges(dealt, "g", bounded), "candidates")), "clusters").withColumnRenamed("id", "rep")

    def exactly(group: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(h, np.uint64) for h in group["hashes"].to_pylist()]
        n = group["n"].to_numpy()

        def similar(one: int, others: np.ndarray) -> np.ndarray:
            out = np.empty(len(others), bool)
            mine = sets[one]
            for k in range(0, len(others), 256):
                part = others[k : k + 256]
                flat = np.concatenate([sets[j] for j in part])
                at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                overlap = np.add.reduceat((mine[at] == flat).astype(np.int64), np.append(0, np.cumsum(n[part])[:-1]))
                out[k : k + 256] = 100 * overlap >= percent * (n[one] + n[part] - overlap)
            return out

        maps = one_width(group["signature"].to_pylist())
        return clusters(n, maps, percent, similar)

    whole = chunk_pairs(cluster.join(known.select("rep", "n"), "rep"), "component", "rep", CLUSTER_SHINGLES, "n").drop("n").join(known, "rep")
    one_node = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    linked = connected_components(materialise(_edges(whole, "component", exactly).union(one_node), "linked")).withColumnRenamed("id", "rep")
    told = classes.join(linked, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = found.select("doc_id", "n", "digest").join(told, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def digested(docs: DataFrame, size: int, digest: str) -> DataFrame:
    """``docs`` with a column of the digest of the text's set, null if that is empty."""

    def run(batches):
        shingle = Shingler(size)
        for batch in batches:
            found = [shingle(t) for t in batch.column("text").to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in found], pa.binary())
            yield batch.append_column(digest, digests)

    return docs.mapInArrow(run, T.StructType(list(docs.schema)).add(digest, "binary"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, and rows without an id.

    Rows with equal ids and equal sets are one document, and so are rows without an id and with equal
    sets that are not empty. Of these the row of the smallest hash stays. Columns may have any name or
    type.
    """
    digest, row = own_names("digest", "row")
    gone = materialise(links(docs, size, percent).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = join_ids(docs, gone, "left_anti")
    again = materialise(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated-rows")
    doubtful = digested(join_ids(kept.where("doc_id IS NOT NULL"), again, "left_semi").union(kept.where("doc_id IS NULL")), size, digest)
    whole = F.struct(*docs.columns)
    wordless = doubtful.where(F.col("doc_id").isNull() & F.col(digest).isNull()).select(*docs.columns)
    worded = doubtful.where(F.col("doc_id").isNotNull() | F.col(digest).isNotNull())
    one = worded.groupBy("doc_id", digest).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(row))
    return join_ids(kept.where("doc_id IS NOT NULL"), again, "left_anti").union(wordless).union(one.select(f"{row}.*"))
