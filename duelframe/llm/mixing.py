"""Mixing sources to target weights by weighted fair queueing.

Each source's texts are shuffled by a hash of (doc_id, round), once per round of repeats, and laid end
to end. A copy's virtual finish time is the source's words up to and with it, divided by the source's
target. All copies are ordered by finish time and taken until the budget, the size of all texts, is
reached. Within a source the order is that of (round, hash), so what is taken is everything up to one
position per source; the texts themselves are never shuffled.

Running totals are built from sums per range of hashes, so a source with a third of all rows is spread
over thousands of windows, and only the range of finish times that the budget falls into is sorted
whole. Sources are one row each.

Null texts have size 0, a null source is a source of its own and sorts last, null ids hash alike.
Copies with equal hashes (repeated rows) are taken or left together. A source of size 0 has target 0.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import WORD, materialise, own_names

_HASH_BITS, _CHUNK_BITS = 60, 48
#: Finish times are counted in steps of 1/1024 up to 4; the budget is met near 1.
_STEPS, _LAST = 1024, 4096


def position(round_: int | Column) -> Column:
    """Place of a copy in its shuffled source: the round, then 60 bits of a hash."""
    round_ = F.lit(round_) if isinstance(round_, int) else round_
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), round_.cast("string")))
    return round_.cast("long") * F.lit(1 << _HASH_BITS) + F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size, target``: shares by weight, stopped at ``most`` times the size.

    Sources are sorted by the water level at which they are full; the first that the level does not
    fill fixes the level, and those before it are full.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = sizes.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("long"))
    full = F.col("source_size") * most
    by_level = Window.orderBy(full / F.col("weight"), "turn")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = listed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("left"),
        F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
        F.row_number().over(by_level).alias("place"),
    )
    fits = F.col("left") * F.col("weight") <= full * F.col("open")
    level = F.min(F.when(fits, F.struct("place", "left", "open"))).over(everything)
    share = F.col("level.left").cast("double") * F.col("weight") / F.col("level.open")
    return levels.withColumn("level", level).select("source", "source_size", F.when(F.col("place") < F.col("level.place"), full.cast("double")).otherwise(share).alias("target"))


def cutoffs(sized: DataFrame, aims: DataFrame, most: int = 3) -> DataFrame:
    """``source, cut``: the last position that is taken of each source."""
    joined = sized.join(aims, sized["source"].eqNullSafe(aims["source"])).select(sized["source"], "doc_id", "size", "target", F.explode(F.array(*map(F.lit, range(most)))).alias("round"))
    placed = joined.where("target > 0").select("source", "size", "target", position(F.col("round")).alias("at"))
    chunked = placed.withColumn("chunk", F.shiftright("at", _CHUNK_BITS))
    sums = chunked.groupBy("source", "chunk").agg(F.sum("size").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select(F.col("source").alias("b_source"), F.col("chunk").alias("b_chunk"), before.alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source", "chunk").orderBy("at"))
    run = chunked.withColumn("inside", inside).join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("chunk") == F.col("b_chunk")))
    timed = materialise(run.select("source", "at", "size", ((F.col("base") + F.col("inside")) / F.col("target")).alias("finish")), "finish")
    timed = timed.withColumn("step", F.least(F.floor(F.col("finish") * _STEPS), F.lit(_LAST)))
    budget = aims.agg(F.sum("source_size").alias("budget"))
    steps = timed.groupBy("step").agg(F.sum("size").alias("s")).select("step", F.sum("s").over(Window.orderBy("step")).alias("upto"), "s")
    steps = steps.crossJoin(F.broadcast(budget)).where("upto - s <= budget").select("step", (F.col("upto") - F.col("s")).alias("before"), "upto", "budget")  # one row of budget
    known = timed.join(F.broadcast(steps), "step")  # at most _LAST + 1 rows
    whole = known.where("upto <= budget").groupBy("source").agg(F.max("at").alias("cut"))
    part = known.where("upto > budget").withColumn("total", F.col("before") + F.sum("size").over(Window.partitionBy("step").orderBy("finish", F.col("source").asc_nulls_last(), "at")))
    part = part.where("total <= budget").groupBy("source").agg(F.max("at").alias("cut"))
    return whole.union(part).groupBy("source").agg(F.max("cut").alias("cut"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Sizes of all rows, and per source its size, target and cutoff."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialise(docs.select(F.col("doc_id").cast("long"), F.col("source"), size.alias("size")), "sizes")
    aims = materialise(targets(sized, weights, most), "targets")
    cuts = cutoffs(sized, aims, most).withColumnRenamed("source", "c_source")
    full = aims.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").select(F.col("source").alias("_source"), F.col("source_size").alias("_size"), F.col("target").alias("_target"), F.coalesce("cut", F.lit(-1)).alias("_cut"))
    return sized, materialise(full, "cuts")


def copies(most: int = 3, cut: str = "_cut") -> Column:
    """How often a row is taken, given its source's cutoff."""
    return sum((F.when(position(k) <= F.col(cut), 1).otherwise(0) for k in range(1, most)), F.when(position(0) <= F.col(cut), 1).otherwise(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """What the mix takes of every row: ``doc_id, size, source_size, target, taken``."""
    sized, sources = plan(docs, weights, most)
    joined = sized.join(sources, sized["source"].eqNullSafe(sources["_source"]))
    return joined.select("doc_id", "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * copies(most)).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: the rows of ``docs``, repeated as often as each is taken."""
    _, sources = plan(docs, weights, most)
    source, cut, copy = own_names("source", "cut", "copy")
    joined = docs.join(sources.select(F.col("_source").alias(source), F.col("_cut").alias(cut)), F.col("source").eqNullSafe(F.col(source)))
    repeats = F.explode(F.array_repeat(F.lit(1), copies(most, cut)))
    return joined.withColumn(copy, repeats).select(*docs.columns)
