"""Look-back computations over ordered histories, safe for histories that outgrow one task.

A plain window sends a key's whole history to one task. That is fine while the largest history is
bounded, and ruinous when one key owns a third of the table. ``measure`` counts (one pre-aggregated
scan, one row to the driver) and picks between two exact plans:

* direct: ``Window.partitionBy(key).orderBy(date, id)``;
* cut: the history is cut along its own order into cells of about equal numbers of rows, so that a
  burst is cut as finely as it needs. Bounded frames run per cell on the cell's rows plus the few
  last rows of earlier cells; growing frames run per cell and add the totals of earlier cells. Only
  per-cell summaries are ever brought together per key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from duelframe.session import cut_lineage

MAX_ROWS_CONF = "duelframe.maxRowsPerHistory"
DEFAULT_MAX_ROWS = 2_000_000
_CELL = ["_cell"]
_HALO = "_is_halo"
#: Value and length of the run that a cell continues.
_RUN = ["_run_of", "_run"]
#: Cells whose bounds may be broadcast: some 16 MB.
BROADCAST_CELLS = 1_000_000


@dataclass(frozen=True)
class Layout:
    """Keys and order of a history, and where it has to be cut.

    ``bounds`` holds, per key with more than the allowed rows, the sorted places at which its cells
    begin; None means that the largest history fits one task. A place is a tick (day or minute) and
    a position inside it: the tie-breaker for dates, microseconds for timestamps. Any bounds are
    exact, since a row's cell is the number of bounds at or before it. ``cells`` counts the bounds.
    """

    keys: tuple[str, ...]
    date: str = "event_date"
    tie: str = "match_id"
    bounds: DataFrame | None = field(default=None, compare=False, repr=False)
    cells: int = 0
    #: Earlier rows beside each cell of a history that ``opened`` has cut; 0 when it is not open.
    depth: int = 0

    @property
    def order(self) -> list[str]:
        return [self.date, self.tie]

    @property
    def partition(self) -> list[str]:
        return list(self.keys) if self.bounds is None else [*self.keys, *_CELL]

    def cut(self, df: DataFrame) -> DataFrame:
        """Add the cell of each row; keys without bounds are one cell.

        The last bound at or before a row is found by bisection, with a fixed number of steps.
        """
        bounds = F.broadcast(self.bounds) if self.cells <= BROADCAST_CELLS else self.bounds
        place = F.struct(*_place(df, self.date, self.tie))
        steps = [2**k for k in range(max(1, self.cells).bit_length() - 1, -1, -1)]
        joined = df.join(bounds, reduce(lambda x, y: x & y, [df[k].eqNullSafe(bounds[f"_b_{k}"]) for k in self.keys]), "left")
        cell = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, step: F.when((at + step <= F.size("_bounds")) & (F.get("_bounds", at + step - 1) <= F.col("_at")), at + step).otherwise(at),
        )
        return joined.withColumn("_at", place).select(*df.columns, F.when(F.col("_bounds").isNull(), 0).otherwise(cell).alias(_CELL[0]))


    def opened(self, df: DataFrame, depth: int, runs: str) -> tuple[DataFrame, Layout]:
        """Cut once for several look-backs of at most ``depth`` rows, and for runs of equal values of ``runs``.

        The rows carry their cell, the last rows before it are beside them, and ``_run_of`` and ``_run`` are
        the run that the cell continues. The look-backs given the layout returned then share one exchange,
        and ``closed`` takes all of this away. A history that is not cut stays as it is.
        """
        if self.bounds is None:
            return df, self
        cut = self.cut(df)
        halo = _halo(cut, self, depth, None).withColumn(_HALO, F.lit(True))
        both = cut.withColumn(_HALO, F.lit(False)).unionByName(halo)
        continued = _runs_before(cut, self, runs)
        return _beside(both, continued, [*self.keys, *_CELL], self.cells), replace(self, depth=depth)

    def closed(self, df: DataFrame) -> DataFrame:
        return df.filter(~F.col(_HALO)).drop(_HALO, *_CELL, *_RUN) if self.depth else df


def _is_date(df: DataFrame, date: str) -> bool:
    return isinstance(df.schema[date].dataType, T.DateType)


def _place(df: DataFrame, date: str, tie: str) -> list[Column]:
    """Tick of a row (day, or start of the minute) and its position inside the tick."""
    if _is_date(df, date):
        return [F.unix_date(date).cast("long").alias("tick"), F.col(tie).cast("long").alias("pos")]
    micros = F.unix_micros(F.col(date).cast("timestamp"))
    return [F.floor(micros / F.lit(60_000_000)).cast("long").alias("tick"), micros.alias("pos")]


def measure(
    df: DataFrame,
    keys: Sequence[str],
    date: str = "event_date",
    tie: str = "match_id",
    max_rows: int | None = None,
    parts: int = 1,
) -> Layout:
    """Pick a layout from the size of the largest history.

    A history above the limit is cut into cells of about the limit, or of one of ``parts`` parts of it, for
    tasks that hold the rows of a cell several times. The answer is remembered per plan, on the session: a stale one would still be exact, only cut
    too coarsely.
    """
    spark = df.sparkSession
    limit = max_rows or int(spark.conf.get(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS)))
    sized = df.select(*keys, *_place(df, date, tie))
    measured = vars(spark).setdefault("_duelframe_layouts", {})
    known = (sized.semanticHash(), tuple(keys), date, tie, limit, parts)
    if known not in measured:
        measured[known] = _measure(sized, tuple(keys), date, tie, limit, parts)
    return measured[known]


def _measure(sized: DataFrame, keys: tuple[str, ...], date: str, tie: str, limit: int, parts: int = 1) -> Layout:
    counts = sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    large = counts.filter(F.col("n") > limit)
    limit = max(1, limit // parts)
    most = large.agg(F.max("n").alias("n"), F.sum(F.ceil(F.col("n") / limit)).alias("cells")).first()
    if most["n"] is None:
        return Layout(keys, date, tie)
    few = most["cells"] <= BROADCAST_CELLS

    def only(df: DataFrame, chosen: DataFrame, on: Sequence[str]) -> DataFrame:
        """Rows of ``df`` that have a partner; nulls equal nulls."""
        chosen = chosen.select(*[F.col(c).alias(f"_o_{c}") for c in on])
        match = reduce(lambda x, y: x & y, [df[c].eqNullSafe(chosen[f"_o_{c}"]) for c in on])
        return df.join(F.broadcast(chosen) if few else chosen, match, "left_semi")

    mine = only(sized, large, keys)
    ticks = cut_lineage(mine.groupBy(*keys, "tick").agg(F.count(F.lit(1)).alias("n")))
    in_order = Window.partitionBy(*keys).orderBy("tick")
    part = F.floor((F.sum("n").over(in_order) - F.col("n")) / F.lit(limit))
    starts = (
        ticks.withColumn("_part", part)
        .withColumn("_last", F.lag("_part").over(in_order))
        .filter(F.col("_part") > F.coalesce("_last", F.lit(0)))
        .select(*keys, "tick", F.lit(None).cast("long").alias("pos"))
    )
    hot = ticks.filter(F.col("n") > limit)
    fullest = hot.agg(F.max("n")).first()[0]
    if fullest is not None:  # a tick too large for one cell is cut at quantiles of the position
        shares = math.ceil(fullest / limit)
        quantiles = F.percentile_approx("pos", [i / shares for i in range(1, shares)], max(10_000, 20 * shares))
        inside = only(mine, hot, [*keys, "tick"]).groupBy(*keys, "tick").agg(quantiles.alias("pos"))
        starts = starts.unionByName(inside.withColumn("pos", F.explode("pos")))
    bounds = starts.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("tick", "pos"))).alias("_bounds"))
    bounds = cut_lineage(bounds.select(*[F.col(k).alias(f"_b_{k}") for k in keys], "_bounds"))
    return Layout(keys, date, tie, bounds, bounds.agg(F.sum(F.size("_bounds"))).first()[0] or 0)


@dataclass(frozen=True)
class Frames:
    """The frames an expression may look back over; the same expressions serve both plans."""

    partition: list[str]
    order: list[str]

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def prior(self, n: int) -> WindowSpec:
        """The ``n`` rows before the current one."""
        return self.ordered.rowsBetween(-n, -1)

    @property
    def before(self) -> WindowSpec:
        """All earlier rows at hand: right for "last known value", whose carrier is in the halo."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, -1)

    def prior_by(self, position: str, n: int) -> WindowSpec:
        """Rows whose ``position`` is one to ``n`` below the current one."""
        return Window.partitionBy(*self.partition).orderBy(position).rangeBetween(-n, -1)


def _halo(cut: DataFrame, layout: Layout, depth: int, carry: Column | None) -> DataFrame:
    """The last ``depth`` carried rows before each cell, labelled with that cell."""
    payload = [c for c in cut.columns if c not in (*layout.keys, *_CELL)]
    flag = F.lit(True) if carry is None else F.coalesce(carry, F.lit(False))
    newest = Window.partitionBy(*layout.keys, *_CELL).orderBy(
        F.desc("_carry"), *[F.desc(c) for c in layout.order]
    )
    # row_number <= depth is applied before the shuffle as well, so only the tails travel
    tails = (
        cut.withColumn("_carry", flag)
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= depth)
        .groupBy(*layout.keys, *_CELL)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.when(F.col("_carry"), F.struct(F.col("_rn").alias("_rn"), F.struct(*payload).alias("_row")))
                ),
                lambda a, b: b["_rn"] - a["_rn"],  # oldest first; rows may hold types without an order
            ).alias("_tail")
        )
        .withColumn("_full", F.size("_tail") > 0)
    )
    by_cell = Window.partitionBy(*layout.keys).orderBy(*_CELL).rowsBetween(Window.unboundedPreceding, -1)
    by_rank = Window.partitionBy(*layout.keys).orderBy("_rank").rangeBetween(-depth, -1)
    joined = F.flatten(F.collect_list(F.when(F.col("_full"), F.col("_tail"))).over(by_rank))
    return (
        tails.withColumn("_rank", F.count(F.when(F.col("_full"), 1)).over(by_cell))
        .select(*layout.keys, *_CELL, joined.alias("_all"))
        .select(
            *layout.keys,
            *_CELL,
            F.explode(F.slice("_all", F.greatest(F.size("_all") - depth, F.lit(0)) + 1, depth)).alias("_h"),
        )
        .select(*layout.keys, *_CELL, "_h._row.*")
    )


def _beside(df: DataFrame, few: DataFrame, on: Sequence[str], cells: int) -> DataFrame:
    """``df`` with the columns of a table of one row per key; nulls equal nulls."""
    few = few.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in few.columns])
    match = reduce(lambda x, y: x & y, [df[c].eqNullSafe(few[f"_on_{c}"]) for c in on])
    return df.join(F.broadcast(few) if cells <= BROADCAST_CELLS else few, match, "left").drop(*[f"_on_{c}" for c in on])


def _runs_before(cut: DataFrame, layout: Layout, value: str) -> DataFrame:
    """Per cell the run of equal values, nulls left out, that the rows before it end in.

    Counts per cell and value tell the last value of a cell and where another one stood last; rows after
    that place are counted in a second pass. Only these counts are brought together per key.
    """
    cell = [*layout.keys, *_CELL]
    place = F.struct(*layout.order)
    known = F.col("_value").isNotNull()
    rows = cut.select(*cell, F.col(value).alias("_value"), place.alias("_place"))
    counts = rows.groupBy(*cell, "_value").agg(F.count(F.lit(1)).alias("_n"), F.max("_place").alias("_place"))
    last = F.max_by("_value", F.when(known, F.col("_place"))).over(Window.partitionBy(*cell))
    ends = cut_lineage(
        counts.withColumn("_ends", last)
        .groupBy(*cell)
        .agg(F.max("_ends").alias("_ends"), F.max(F.when(F.col("_value") != F.col("_ends"), F.col("_place"))).alias("_turn"))
    )
    after = known & (F.col("_turn").isNull() | (F.col("_place") > F.col("_turn")))
    tails = _beside(rows, ends, cell, layout.cells).groupBy(*cell).agg(
        F.max("_ends").alias("_ends"), F.count_if(F.col("_turn").isNotNull()).alias("_turned"), F.count_if(after).alias("_tail")
    )
    in_order = Window.partitionBy(*layout.keys).orderBy(*_CELL)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    begins = F.col("_ends").isNotNull() & ((F.col("_turned") > 0) | F.col("_came").isNull() | (F.col("_came") != F.col("_ends")))
    so_far = F.sum("_tail").over(Window.partitionBy(*layout.keys, "_nth").orderBy(*_CELL))
    runs = (
        tails.withColumn("_came", F.last("_ends", ignorenulls=True).over(earlier))
        .withColumn("_nth", F.count_if(begins).over(in_order))
        .withColumn("_so_far", so_far)
        .select(
            *cell,
            F.col("_came").alias("_run_of"),
            F.coalesce(F.last("_so_far").over(earlier), F.lit(0)).alias("_run"),
        )
    )
    return cut_lineage(runs)


def lookback(
    df: DataFrame,
    layout: Layout,
    depth: int,
    columns: Callable[[Frames], Mapping[str, Column]],
    carry: Column | None = None,
) -> DataFrame:
    """Add columns computed over at most ``depth`` earlier rows (earlier *carried* rows if given)."""
    if layout.depth and (carry is not None or depth > layout.depth):
        raise ValueError("the history was opened for less")
    if layout.bounds is None or layout.depth:
        made = columns(Frames(layout.partition, layout.order))
        return df.select("*", *[c.alias(n) for n, c in made.items()])
    cut = layout.cut(df)
    halo = _halo(cut, layout, depth, carry).withColumn("_is_halo", F.lit(True))
    both = cut.withColumn("_is_halo", F.lit(False)).unionByName(halo)
    made = columns(Frames(layout.partition, layout.order))
    return (
        both.select("*", *[c.alias(n) for n, c in made.items()])
        .filter(~F.col("_is_halo"))
        .drop("_is_halo", *_CELL)
    )


_GROWING = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _combine(how: str, a: Column, b: Column) -> Column:
    if how == "count":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    if how == "sum":
        return F.coalesce(a + b, a, b)
    return (F.greatest if how == "max" else F.least)(a, b)


def running(
    df: DataFrame,
    layout: Layout,
    totals: Mapping[str, tuple[str, Column]],
    include_current: bool = False,
) -> DataFrame:
    """Add growing totals over all earlier rows; ``totals`` maps a name to (sum|count|max|min, column)."""
    end = 0 if include_current else -1
    frame = Window.partitionBy(*layout.partition).orderBy(*layout.order).rowsBetween(
        Window.unboundedPreceding, end
    )
    if layout.depth:
        raise ValueError("totals grow over whole histories, not over an opened one")
    if layout.bounds is None:
        return df.select("*", *[_GROWING[how](c).over(frame).alias(n) for n, (how, c) in totals.items()])
    cut = layout.cut(df)
    cells = cut.groupBy(*layout.keys, *_CELL).agg(
        *[_GROWING[how](c).alias(f"_t_{n}") for n, (how, c) in totals.items()]
    )
    before = Window.partitionBy(*layout.keys).orderBy(*_CELL).rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    prefix = cells.select(
        *layout.keys,
        *_CELL,
        *[over[how](f"_t_{n}").over(before).alias(f"_p_{n}") for n, (how, _) in totals.items()],
    )
    local = cut.select("*", *[_GROWING[how](c).over(frame).alias(f"_l_{n}") for n, (how, c) in totals.items()])
    on = [*layout.keys, *_CELL]
    prefix = prefix.select(*[F.col(c).alias(f"_q_{c}") for c in on], *[f"_p_{n}" for n in totals])
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in on])
    return local.join(prefix, match, "left").select(
        *df.columns,
        *[
            _combine(how, F.col(f"_p_{n}"), F.col(f"_l_{n}")).alias(n)
            for n, (how, _) in totals.items()
        ],
    )
