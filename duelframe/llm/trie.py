"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

Each conversation is the path of its turns' digests. Paths are range-sorted, so that a shard holds a
stretch of the trie in depth-first order, and written as balanced parentheses. ``findclose`` (by the
smallest excess of blocks) delimits a subtree, the rank of ``()`` counts its leaves, and running totals
give what it saves. Only the first and the last path of a shard, its spines, can hold nodes that
neighbours hold too; spines of all shards (two rows a shard) are merged in one more trie.

Paths are cut after ``SEGMENT`` turns. A piece begins its own trie below the digest of all turns before
it; a piece that no other conversation shares needs none, so one endless dialogue is a chain of rows
that any task may write. Tries of pieces are solved from the deepest up, and each hands its totals to
the node it hangs below.

Turns are ordered by number (null first), then by the digest of role and text. Repeated rows are
repeated turns. Null roles and texts are empty. Rows without a conversation id belong to none. Turns
are known by digests of 128 bits. An empty table has no nodes. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import WORD, arrow_pass, join_ids, materialise

#: Turns of a piece of a path.
SEGMENT = 4096
#: Conversations and turns of a shard; a task writes as many shards as its rows need.
SHARD_ROWS, SHARD_TURNS = 32_768, 1_000_000
#: Parentheses of a block of the excess sequence.
BLOCK = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()


# -- balanced parentheses ---------------------------------------------------------------------------


class Parentheses:
    """A sequence of opening (true) and closing marks with the smallest excess of blocks."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        padded = np.full(-(-len(opens) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        padded[: len(opens)] = self.excess
        self.least = [padded.reshape(-1, BLOCK).min(1)]  # of one block, of two, of four ...
        while len(self.least[-1]) > 1:
            last = self.least[-1]
            self.least.append(np.minimum.reduceat(last, np.arange(0, len(last), 2)))
        pairs = opens & ~np.append(opens[1:], True)
        self.pairs = np.append(0, np.cumsum(pairs))

    def _within(self, at: np.ndarray, goal: np.ndarray, found: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Scan from ``at`` to the end of its block; returns which of ``which`` found nothing."""
        while len(which):
            hit = self.excess[at] == goal
            found[which[hit]] = at[hit]
            on = ~hit & ((at + 1) % BLOCK != 0) & (at + 1 < len(self.excess))
            left = which[~hit & ~on]
            if len(left):
                self._left.append(left)
            which, at, goal = which[on], at[on] + 1, goal[on]
        return np.concatenate(self._left) if self._left else np.zeros(0, int)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Where the marks that open at ``at`` are closed: the first smaller excess behind them."""
        goal, found = self.excess[at] - 1, np.full(len(at), -1)
        self._left: list[np.ndarray] = []
        open_ = self._within(at, goal, found, np.arange(len(at)))
        if len(open_):
            block, level = at[open_] // BLOCK, np.zeros(len(open_), int)
            target = goal[open_]
            node, depth, climbing = block, level, np.ones(len(open_), bool)
            while climbing.any():  # up until a right neighbour holds a small enough excess
                for v in np.unique(depth[climbing]):
                    here = np.flatnonzero(climbing & (depth == v))
                    row = self.least[v]
                    right = node[here] + 1
                    fits = (node[here] % 2 == 0) & (right < len(row))
                    fits[fits] = row[right[fits]] <= target[here[fits]]
                    node[here[fits]] = right[fits]
                    climbing[here[fits]] = False
                    up = here[~fits]
                    node[up] //= 2
                    depth[up] = v + 1
            while (depth > 0).any():  # down to the first block that holds it
                for v in np.unique(depth[depth > 0]):
                    here = np.flatnonzero(depth == v)
                    row = self.least[v - 1]
                    child = node[here] * 2
                    node[here] = np.where(row[child] <= target[here], child, child + 1)
                    depth[here] = v - 1
            self._left = []
            self._within(node * BLOCK, target, found, open_)
        return found

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Leaf pairs ``()`` from ``at`` to ``close``."""
        return self.pairs[close] - self.pairs[at]


class Forest:
    """The trie of paths in sorted order; nodes are numbered as they open."""

    def __init__(self, roots: list[str], paths: list[bytes]):
        n = len(paths)
        self.length = np.array([len(p) // 16 for p in paths], np.int64)
        flat = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
        start = np.append(0, np.cumsum(self.length))
        shared = np.full(n, -1)  # the depth down to which a path is that of the row before
        if n > 1:
            both = np.minimum(self.length[1:], self.length[:-1])
            row = np.repeat(np.arange(n - 1), both)
            place = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(both)[:-1]), both)
            differ = (flat[start[row + 1] + place] != flat[start[row] + place]).any(1)
            shared[1:] = both
            np.minimum.at(shared, row[differ] + 1, place[differ])
            shared[1:][np.array([a != b for a, b in zip(roots, roots[1:], strict=False)], bool)] = -1
        self.shared, self.new = shared, self.length - shared
        closes = np.append(np.append(0, self.length[:-1] - shared[1:]), self.length[-1] + 1)
        counts = np.ravel(np.column_stack([closes, np.append(self.new, 0)]))
        self.marks = Parentheses(np.repeat(np.tile([False, True], n + 1), counts))
        self.starts = np.cumsum(counts)[0::2][:n]  # of each row, behind the marks that close before it
        self.row = np.repeat(np.arange(n), self.new)
        self.first = np.append(0, np.cumsum(self.new))
        self.depth = np.arange(len(self.row)) - self.first[self.row] + shared[self.row] + 1
        self.open = np.flatnonzero(self.marks.opens)
        self.close = self.marks.findclose(self.open)
        self.end = np.cumsum(self.marks.opens)[self.close]  # the first node behind the subtree
        self.rows = np.searchsorted(self.starts, self.close, "right") - self.row
        size = len(self.row)
        self._key = self.depth * size + np.arange(size)
        self._order = np.argsort(self._key)
        self._key = self._key[self._order]
        self.parent = np.where(self.depth > 0, self.node_at(self.depth - 1, np.arange(size)), -1)

    def node_at(self, depth: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The last node of ``depth`` that opens up to node ``before``."""
        at = np.searchsorted(self._key, depth * len(self.row) + before, "right") - 1
        return self._order[np.maximum(at, 0)]

    def path_nodes(self) -> np.ndarray:
        """The nodes of every row's path, root first, one row behind the other."""
        row = np.repeat(np.arange(len(self.length)), self.length + 1)
        depth = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(self.length + 1)[:-1]), self.length + 1)
        return self.node_at(depth, self.first[row + 1] - 1)

    def below(self, amount: np.ndarray) -> np.ndarray:
        """Sums of a node's amount over its subtree."""
        total = np.append(0, np.cumsum(amount))
        return total[self.end] - total[: len(amount)]

    def count_children(self, counted: np.ndarray) -> np.ndarray:
        parent = self.parent[counted & (self.parent >= 0)]
        return np.bincount(parent, minlength=len(self.row))


def smallest(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The smallest of ``values[start : start + count]`` by minima over spans of powers of two."""
    out = np.empty(len(start), values.dtype)
    power = np.frexp(count)[1] - 1  # floor of log2
    spans, width = values, 1
    for k in range(int(power.max()) + 1 if len(power) else 0):
        here = power == k
        out[here] = np.minimum(spans[start[here]], spans[start[here] + count[here] - width])
        spans, width = np.minimum(spans[:-width], spans[width:]) if len(spans) > width else spans, width * 2
    return out


# -- shards and spines ------------------------------------------------------------------------------

NODE, SPINE, ENDS, ROOT = range(4)
_ROWS = (
    "kind int, block long, side int, ref long, parent_ref long, root string, path binary, words array<int>, conv_id long, depth long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids string, "
    "members array<long>, least array<long>, children array<long>, leaves array<long>, saved array<long>"
)
_NAMES = [c.strip().split(" ")[0] for c in _ROWS.split(",")]


def _ref(block: int, side: np.ndarray | int, depth: np.ndarray | int) -> np.ndarray | int:
    """A node of a spine, by its shard, side and depth (below 2 ** 13)."""
    return ((block * 2 + side) << 13) | depth


def _columns(kind: int, n: int, **given) -> dict:
    return {"kind": [kind] * n} | {name: given.get(name, [None] * n) for name in _NAMES[1:]}


def _nulls(values: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=null)


def shard(block: int, at_root: bool, t: pa.Table) -> Iterator[dict]:
    """Nodes of one shard, its spines, and the ids that end at nodes of a spine."""
    roots, paths, convs = t["root"].to_pylist(), t["path"].to_pylist(), t["conv_id"].to_numpy()
    f = Forest(roots, paths)
    n, rows = len(f.row), len(paths)
    flat_words = t["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    word_start = np.append(0, np.cumsum(f.length))
    words = np.where(f.depth > 0, flat_words[np.minimum(word_start[f.row] + f.depth - 1, max(0, len(flat_words) - 1))] if len(flat_words) else 0, 0)
    # a run of rows with equal paths ends at one node, the last that the first of them opened
    top = np.flatnonzero(f.new > 0)
    until = np.append(top[1:], rows)
    last = f.first[top + 1] - 1
    carried = {c: t[c].fill_null(-1).to_numpy()[top] for c in ("below_leaves", "below_saved", "below_children")}
    on = carried["below_leaves"] >= 0  # a path that goes on in another piece
    first_spine = np.arange(n) <= f.length[0]
    last_spine = f.close >= len(f.marks.opens) - (f.length[-1] + 1)
    spine = first_spine | last_spine
    least = smallest(convs, f.row, f.rows)

    amount = np.where(spine, 0, (f.rows - 1) * words)
    more = np.zeros(n, np.int64)
    children = f.count_children(~spine)
    whole = last[on & ~spine[last]]
    at = on & ~spine[last]
    amount[whole] += carried["below_saved"][at]
    more[whole] += carried["below_leaves"][at] - 1
    children[whole] = carried["below_children"][at]
    saved = f.below(amount)
    leaf_spine = np.flatnonzero(spine & (f.close == f.open + 1))
    more[leaf_spine] -= 1
    leaves = f.marks.leaves(f.open, f.close) + f.below(more)

    ends = np.full(n, NO_ENDS, dtype=object)
    below_ends = t["below_ends"].to_pylist()
    chunks: list[tuple[int, str]] = []
    for a, b, node, goes_on in zip(top.tolist(), until.tolist(), last.tolist(), on.tolist(), strict=True):
        if goes_on:
            ends[node] = below_ends[a]
            continue
        ids = ",".join(map(str, convs[a:b].tolist()))  # sorted by id within equal paths
        if spine[node]:
            chunks.append((int(_ref(block, 0 if first_spine[node] else 1, int(f.depth[node]))), ids))
        else:
            ends[node] = hashlib.sha256(ids.encode()).hexdigest()

    side = np.where(first_spine, 0, 1)
    shown = ~spine & ((f.depth > 0) | at_root)
    hangs = np.where(f.parent >= 0, spine[f.parent], False)
    parent = np.where(f.parent >= 0, least[f.parent], 0)
    refs = _ref(block, side[f.parent], f.depth[f.parent])
    yield _columns(
        NODE, int(shown.sum()), conv_id=least[shown], depth=f.depth[shown], parent_conv_id=_nulls(parent[shown], (hangs | (f.parent < 0))[shown]),
        parent_ref=_nulls(refs[shown], ~hangs[shown]), n_convs=f.rows[shown], n_children=children[shown], n_leaves=leaves[shown], saved_tokens=saved[shown], ends_sha256=ends[shown].tolist(),
    )
    if not at_root:
        whole = ~spine & (f.depth == 0)
        yield _columns(ROOT, int(whole.sum()), root=[roots[r] for r in f.row[whole]], n_children=children[whole], n_leaves=leaves[whole], saved_tokens=saved[whole], ends_sha256=ends[whole].tolist())
    for which, row in enumerate((0, rows - 1)):
        nodes = np.arange(f.length[0] + 1) if not which else np.flatnonzero(last_spine)
        once = np.ones(len(nodes), bool) if not which else ~first_spine[nodes]
        run = np.searchsorted(top, row, "right") - 1
        tell = lambda x, keep=once, nodes=nodes: [np.where(keep, x[nodes], 0)]
        yield _columns(
            SPINE, 1, block=[block], side=[which], root=[roots[row]], path=[paths[row]], words=[flat_words[word_start[row] : word_start[row + 1]]],
            members=tell(f.rows), least=[least[nodes]], children=tell(children), leaves=tell(leaves), saved=tell(saved),
            n_leaves=[int(carried["below_leaves"][run])], saved_tokens=[int(carried["below_saved"][run])], n_children=[int(carried["below_children"][run])],
            ends_sha256=[below_ends[top[run]]],
        )
    if chunks:
        yield _columns(ENDS, len(chunks), block=[block] * len(chunks), ref=[r for r, _ in chunks], ids=[i for _, i in chunks])


def shards(at_root: bool):
    def rows(batches: Iterator[pa.RecordBatch]):
        part, count, held, turns = TaskContext.get().partitionId(), 0, [], 0

        def block():
            return shard((part << 24) | count, at_root, pa.Table.from_batches(held))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            turns += len(batch.column("words").flatten())
            if turns > SHARD_TURNS or sum(b.num_rows for b in held) > SHARD_ROWS:
                yield from block()
                count, held, turns = count + 1, [], 0
        if held:
            yield from block()

    return rows


def merged_spines(at_root: bool):
    """The trie of all spines: totals of their nodes, and which of the shards' nodes are one."""

    def rows(batches: Iterator[pa.RecordBatch]):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        roots, paths = t["root"].to_pylist(), t["path"].to_pylist()
        f = Forest(roots, paths)
        n = len(f.row)
        nodes = f.path_nodes()
        flat = {c: t[c].combine_chunks().flatten().to_numpy() for c in ("members", "least", "children", "leaves", "saved")}
        total = {c: np.bincount(nodes, flat[c], n) for c in ("members", "children")}
        exact = {c: np.zeros(n, np.int64) for c in ("leaves", "saved")}
        for c, into in exact.items():
            np.add.at(into, nodes, flat[c])
        members, own_children = (total[c].astype(np.int64) for c in ("members", "children"))
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, nodes, flat["least"])
        flat_words = t["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        word_start = np.append(0, np.cumsum(f.length))
        words = np.where(f.depth > 0, flat_words[np.minimum(word_start[f.row] + f.depth - 1, max(0, len(flat_words) - 1))] if len(flat_words) else 0, 0)
        bottom = nodes[np.cumsum(f.length + 1) - 1]  # of every row
        carry = {c: np.full(n, -1) for c in ("n_leaves", "saved_tokens", "n_children")}
        for c, into in carry.items():
            np.maximum.at(into, bottom, t[c].to_numpy())
        on = carry["n_leaves"] >= 0
        children = np.where(on, carry["n_children"], own_children + f.count_children(np.ones(n, bool)))
        saved = exact["saved"] + f.below((members - 1) * words + np.where(on, carry["saved_tokens"], 0))
        leaf = np.where(on, carry["n_leaves"], (children == 0).astype(np.int64))
        leaves = exact["leaves"] + f.below(leaf)
        ends: list[str | None] = [None] * n
        for node, said in zip(bottom.tolist(), t["ends_sha256"].to_pylist(), strict=True):
            ends[node] = said or ends[node]

        row = np.repeat(np.arange(len(paths)), f.length + 1)
        depth = f.depth[nodes]
        side, block = t["side"].to_numpy()[row].astype(np.int64), t["block"].to_numpy()[row]
        refs = _ref(block, side, depth)
        name = np.zeros(n, np.int64)
        name[nodes[::-1]] = refs[::-1]  # the first that names it
        yield _columns(SPINE, len(refs), ref=refs, parent_ref=name[nodes], conv_id=least[nodes])
        shown = (f.depth > 0) | at_root
        parent = np.where(f.parent >= 0, least[f.parent], 0)
        told = {"ref": name, "conv_id": least, "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}
        yield _columns(NODE, int(shown.sum()), depth=f.depth[shown], parent_conv_id=_nulls(parent[shown], (f.parent < 0)[shown]), ends_sha256=[e for e, s in zip(ends, shown, strict=True) if s], **{c: v[shown] for c, v in told.items()})
        if not at_root:
            top = f.depth == 0
            yield _columns(ROOT, int(top.sum()), root=[roots[r] for r in f.row[top]], ends_sha256=[e for e, s in zip(ends, top, strict=True) if s], **{c: v[top] for c, v in told.items() if c != "conv_id"})

    return rows


def _digest_of_parts(parts: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids, shard by shard: the strings pass through a task, none are held."""

    def rows(batches: Iterator[pa.RecordBatch]):
        last, running = None, None
        for batch in batches:
            done: dict[str, list] = {"ref": [], "ends_sha256": []}
            for ref, ids in zip(batch.column("ref").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if ref != last:
                    if last is not None:
                        done["ref"].append(last)
                        done["ends_sha256"].append(running.hexdigest())
                    last, running = ref, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield done
        if last is not None:
            yield {"ref": [last], "ends_sha256": [running.hexdigest()]}

    return arrow_pass(parts.repartition("ref").sortWithinPartitions("ref", "block"), rows, "ref long, ends_sha256 string", step=16)


def _solve(pieces: DataFrame, level: int) -> tuple[DataFrame, DataFrame | None]:
    """Nodes of the tries of one level's pieces, and what each root hands up (none at the top)."""
    at_root = level == 0
    sorted_ = pieces.repartitionByRange("root", "path", "conv_id").sortWithinPartitions("root", "path", "conv_id")
    cut = materialise(arrow_pass(sorted_, shards(at_root), _ROWS, step=4096), "trie-shards")
    spines = cut.where(F.col("kind") == SPINE)
    order = ["root", "path", "block", "side"]
    merged = materialise(arrow_pass(spines.repartition("root").sortWithinPartitions(*order), merged_spines(at_root), _ROWS, step=4096), "trie-spines")
    names = materialise(merged.where(F.col("kind") == SPINE).select(F.col("ref").alias("parent_ref"), F.col("parent_ref").alias("name"), F.col("conv_id").alias("top")), "trie-names")
    parts = cut.where(F.col("kind") == ENDS).join(names.select(F.col("parent_ref").alias("ref"), "name"), "ref").select(F.col("name").alias("ref"), "block", "ids")
    ended = materialise(_digest_of_parts(parts), "trie-ends")
    said = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ends = F.coalesce(F.col("e"), F.col("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256")
    told = ended.select("ref", F.col("ends_sha256").alias("e"))
    of_spines = merged.where(F.col("kind") == NODE).join(told, "ref", "left").select(*said[:-1], ends)
    inside = cut.where((F.col("kind") == NODE) & F.col("parent_ref").isNull()).select(*said)
    hanging = join_ids(cut.where((F.col("kind") == NODE) & F.col("parent_ref").isNotNull()), names.select("parent_ref", "top"), "inner")
    hanging = hanging.withColumn("parent_conv_id", F.col("top")).select(*said)
    nodes = inside.union(hanging).union(of_spines).withColumn("depth", F.col("depth") + level * SEGMENT)
    if at_root:
        return nodes, None
    up = ["root", "n_leaves", "saved_tokens", "n_children"]
    roots = cut.where(F.col("kind") == ROOT).select(*up, "ends_sha256").union(merged.where(F.col("kind") == ROOT).join(told, "ref", "left").select(*up, ends))
    return nodes, roots


# -- conversations as paths -------------------------------------------------------------------------


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, digest, words`` of every turn, ``place`` counted from 0.

    Rows are range-sorted, so a long conversation spreads over tasks; places are counted in each task
    and shifted by what earlier tasks hold of its first conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest")
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", digest, F.regexp_count(text, F.lit(WORD)).alias("words"))
    order = ["conv_id", "turn", "digest"]

    def rows(batches: Iterator[pa.RecordBatch]):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            new = np.append(conv[0] != last, conv[1:] != conv[:-1])
            at = np.arange(len(conv))
            start = np.maximum.accumulate(np.where(new, at, -1))
            inside = np.where(start >= 0, at - start, at + seen)
            last, seen = conv[-1], int(inside[-1]) + 1
            yield {"conv_id": conv, "part": np.full(len(conv), part), "inside": inside, "digest": batch.column("digest"), "words": batch.column("words")}

    spread = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words")
    counted = materialise(arrow_pass(spread, rows, "conv_id long, part int, inside long, digest string, words int", step=8192), "turns")
    shares = counted.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only the first conversation of a task can have begun in another: at most one row a task
    shift = shares.withColumn("earlier", earlier).where("earlier > 0").select("conv_id", "part", "earlier")
    return counted.join(F.broadcast(shift), ["conv_id", "part"], "left").select("conv_id", (F.col("inside") + F.coalesce("earlier", F.lit(0))).alias("place"), "digest", "words")


def branched(turns: DataFrame, every: int, heads: int, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another: ``(turns, convs)`` with ``convs(conv_id, n)``.

    The first ``taken`` turns (at most ``heads``, a function of ``conv_id``) are those of conversation
    ``conv_id - conv_id % every``, as many as it has; its own turns follow behind the same number.
    """
    first = turns.where((F.col("place") < heads) & (F.col("conv_id") % every == 0))
    listed = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    given = F.least(taken, F.coalesce(F.array_size("head"), F.lit(0)))
    convs = materialise(convs.join(listed, "base", "left").select("conv_id", F.slice("head", F.lit(1), given.cast("int")).alias("head"), given.alias("given"), (taken - given).alias("lost"), (given + F.greatest(F.col("own") - taken, F.lit(0))).alias("n")), "heads")
    begun = convs.select("conv_id", F.explode("head").alias("h")).select("conv_id", F.col("h.place"), F.col("h.digest"), F.col("h.words"))
    short = materialise(convs.where("lost > 0").select("conv_id", "lost"), "short-heads")
    own = join_ids(turns.where(F.col("place") >= taken), short, "left")
    own = own.select("conv_id", (F.col("place") - F.coalesce("lost", F.lit(0))).alias("place"), "digest", "words")
    return begun.union(own), convs.select("conv_id", "n")


def _pieces(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, level, path, words``: at most ``SEGMENT`` turns; the last one may be empty."""
    marks = convs.select("conv_id", F.col("n").cast("long").alias("place"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("int").alias("words"))
    level = F.floor(F.col("place") / SEGMENT).cast("int").alias("level")
    listed = turns.union(marks).groupBy("conv_id", level).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("t"))
    said = F.filter("t", lambda x: x["digest"].isNotNull())
    path = F.unhex(F.array_join(F.transform(said, lambda x: x["digest"]), ""))
    return listed.select("conv_id", "level", path.alias("path"), F.transform(said, lambda x: x["words"]).alias("words"))


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie.

    ``turns(conv_id, place, digest, words)`` and every conversation, also one without turns, in
    ``convs(conv_id, n)`` with its number of turns. Result: ``conv_id`` (the smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    The digest of the ids that end at a node is a chain; it passes through one task as one string per
    shard.
    """
    pieces = materialise(_pieces(turns, convs), "paths")
    deepest = pieces.agg(F.max("level")).first()[0]
    none = {"below_leaves": F.lit(None).cast("long"), "below_saved": F.lit(None).cast("long"), "below_children": F.lit(None).cast("long"), "below_ends": F.lit(None).cast("string")}
    if not deepest:
        return _solve(pieces.withColumns({"root": F.lit("")} | none), 0)[0]

    # the digest of all turns up to the end of a piece: a sum, so that pieces need no chain
    long_ = join_ids(pieces, materialise(pieces.where("level = 1").select("conv_id"), "long-conversations"), "left_semi")
    hex_ = F.md5(F.concat(F.col("level").cast("string").cast("binary"), F.lit(":").cast("binary"), "path"))
    number = lambda at: F.conv(F.substring(hex_, at, 15), 16, 10).cast("decimal(38,0)")
    upto = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    known = long_.withColumn("next_root", F.md5(F.concat_ws(":", F.col("level"), F.sum(number(1)).over(upto), F.sum(number(16)).over(upto))))
    known = known.withColumn("root", F.coalesce(F.lag("next_root").over(Window.partitionBy("conv_id").orderBy("level")), F.lit("")))
    known = materialise(known, "long-paths")
    shared = materialise(known.where("level > 0").groupBy("root").agg(F.count("*").alias("c")).where("c > 1").select("root"), "shared-roots")
    several = materialise(join_ids(known.where("level > 0"), shared, "left_semi"), "shared-pieces")
    alone = join_ids(known.where("level > 0"), shared, "left_anti")

    own = F.sha2(F.col("conv_id").cast("string"), 256)
    goes_on = F.size("words") == SEGMENT
    chain = alone.select("conv_id", "level", goes_on.alias("on"), F.size("words").alias("n"), F.explode(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)))).alias("at")).where("at <= n")
    # a lone piece goes on to a lone piece, whose first turn, if any, is the child of its last
    follows = alone.where((F.size("words") > 0)).select("conv_id", (F.col("level") - 1).alias("level"), F.lit(True).alias("more"))
    chain = chain.join(follows, ["conv_id", "level"], "left")
    tail = F.col("at") == F.col("n")
    stops = tail & (~F.col("on") | F.col("more").isNull())
    out = [
        chain.select(
            "conv_id", (F.col("level").cast("long") * SEGMENT + F.col("at")).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            F.when(stops, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            F.when(stops, own).otherwise(NO_ENDS).alias("ends_sha256"),
        )
    ]
    lone = alone.select(F.col("root").alias("next_root"), F.lit(1).cast("long").alias("below_leaves"), F.lit(0).cast("long").alias("below_saved"), (F.size("words") > 0).cast("long").alias("below_children"), F.when(F.size("words") > 0, NO_ENDS).otherwise(own).alias("below_ends"), "level")
    roots = None
    most = several.agg(F.max("level")).first()[0] or 0
    for level in range(most, -1, -1):
        here = several.where(F.col("level") == level) if level else known.where("level = 0")
        below = lone.where(F.col("level") == level + 1).drop("level")
        if roots is not None:
            below = below.union(roots.select(F.col("root").alias("next_root"), F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved"), F.col("n_children").alias("below_children"), F.col("ends_sha256").alias("below_ends")))
        here = here.join(below, "next_root", "left").select("root", "path", "words", "conv_id", *none)
        if not level:
            usual = join_ids(pieces.where("level = 0"), materialise(pieces.where("level = 1").select("conv_id"), "long-conversations"), "left_anti")
            here = here.union(usual.select(F.lit("").alias("root"), "path", "words", "conv_id", *[v.alias(k) for k, v in none.items()]))
        found, roots = _solve(here, level)
        roots = materialise(roots, "trie-roots") if roots is not None else None
        out.append(found)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)`` as they are."""
    turns = turns_in_order(conversations)
    return nodes(turns, turns.groupBy("conv_id").agg(F.count("*").alias("n")))
