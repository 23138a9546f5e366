"""Streams whose result does not depend on the order in which files land.

Each operator keeps, per key, what may still be preceded or corrected, and uses event-time timers to
let it go. Nothing is dropped without a word: a row that comes too late to count is part of the output.
State lives in the RocksDB store, so a landing may hold far more than a task's memory. A call of the store
costs about as much as hundreds of rows, so state is packed: calls go with days, windows or slots of keys.
"""

from __future__ import annotations

import datetime
import pickle
import sys
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from itertools import islice

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import _parse_datatype_string

from duelframe.operators.ratings import RatingParams, _Chain
from duelframe.streaming.jobs import drain

# processors travel with their code, so workers need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The only store that keeps state of processors.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's own choices are restored."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def drain_ordered(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    with rocks_state(stream.sparkSession):
        return drain(stream, out, checkpoint, mode)


def drain_updates(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """As ``drain_ordered`` for an update stream: each batch is one folder, written anew if it is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with rocks_state(stream.sparkSession):
        query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def _event_clock(stream: DataFrame, at: str, late: str) -> DataFrame:
    """A watermark on ``at`` whose rows all reach the operator, late ones too: it reads a plain copy, ``_at``."""
    return stream.withColumn("_at", (F.unix_micros(F.col(at).cast("timestamp")) / 1000).cast("long")).withColumn("_clock", F.col(at).cast("timestamp")).withWatermark("_clock", late)


def _packed(rows: Iterable[tuple], width: int, at_once: int) -> Iterator[np.ndarray]:
    """Rows of whole numbers as arrays of at most ``at_once`` rows; a last column marks nulls by bits."""
    rows = iter(rows)
    while chunk := list(islice(rows, at_once)):
        marks = [sum(1 << i for i, v in enumerate(r) if v is None) if None in r else 0 for r in chunk]
        yield np.array([(*((v or 0) for v in r), m) if m else (*r, m) for r, m in zip(chunk, marks, strict=True)], dtype=np.int64).reshape(-1, width + 1)


# -- ratings in event order (STM-03) ----------------------------------------------------------------

_GAME = "match_id long, year int, home_id int, away_id int, home_score int, away_score int"
_WIDTH = len(_GAME.split(", "))
RATED = "league int, match_id long, event_date date, home_elo double, away_elo double, home_elo_prob double, late boolean"


class InOrder(StatefulProcessor):
    """Holds a league's games by day until the watermark has passed the day, then plays them by match id.

    A game of a day that is already played is late: it is reported, and rates nobody. A game that comes
    again before its day is played replaces the earlier row.
    """

    #: Games that are held before they are dealt to their days.
    AT_ONCE = 1_000_000

    def __init__(self, params: RatingParams):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "games binary")
        self.table = handle.getValueState("table", "ids array<int>, ratings array<double>, season int, played long")

    def _table(self) -> tuple[dict, int | None, int | None]:
        known = self.table.get()
        if known is None:
            return {}, None, None
        ids, ratings, season, played = known
        return dict(zip(ids, ratings, strict=True)), season, played

    def _games(self, day: int) -> np.ndarray | None:
        known = self.days.getValue((day,))
        return None if known is None else np.frombuffer(known[0], dtype=np.int64).reshape(-1, _WIDTH + 1)

    def _deal(self, chunks: list[np.ndarray]) -> None:
        """Adds rows of (game, day, nulls) to their days: one read and one write a day."""
        new = np.concatenate(chunks)
        new = new[np.argsort(new[:, _WIDTH], kind="stable")]
        days, starts = np.unique(new[:, _WIDTH], return_index=True)
        for day, games in zip(days.tolist(), np.split(np.delete(new, _WIDTH, axis=1), starts[1:]), strict=True):
            known = self._games(day)
            if known is None:
                self.handle.registerTimer(day)
            else:
                games = np.concatenate([known, games])
            self.days.updateValue((day,), (_last_per_match(games).tobytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        played = self._table()[2]
        late: list[tuple[int, int]] = []

        def open_rows():
            for r in rows:
                day = r[_WIDTH + 1]
                if played is not None and day <= played:
                    late.append((r[1], day))
                else:
                    yield r[1 : _WIDTH + 2]

        held: list[np.ndarray] = []
        for chunk in _packed(open_rows(), _WIDTH + 1, 50_000):
            held.append(chunk)
            if sum(map(len, held)) >= self.AT_ONCE:
                self._deal(held)
                held = []
            yield from self._late(key, late)
        if held:
            self._deal(held)
        yield from self._late(key, late)

    def _late(self, key, late: list[tuple[int, int]]) -> Iterator[Row]:
        for match_id, day in late:
            yield Row(league=key[0], match_id=match_id, event_date=_date(day), home_elo=None, away_elo=None, home_elo_prob=None, late=True)
        late.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        day = expiredTimerInfo.getExpiryTimeInMs()
        games = self._games(day)
        if games is None:
            return
        ratings, season, played = self._table()
        chain = _Chain(self.params)
        chain.rating, chain.season = ratings, season
        on = _date(day)
        for *game, nulls in games.tolist():
            if nulls:
                game = [None if nulls >> i & 1 else v for i, v in enumerate(game)]
            match_id, year, home, away, hs, aw = game
            before_home, before_away, prob, *_ = chain.play(year, home, away, hs, aw)
            yield Row(league=key[0], match_id=match_id, event_date=on, home_elo=before_home, away_elo=before_away, home_elo_prob=prob, late=False)
        self.days.removeKey((day,))
        self.table.update(([int(k) for k in chain.rating], [float(v) for v in chain.rating.values()], chain.season, day if played is None else max(played, day)))

    def close(self) -> None:
        pass


def _last_per_match(games: np.ndarray) -> np.ndarray:
    """The last of the rows of each match, by match id, a missing id first."""
    ids, known = games[:, 0], 1 - (games[:, -1] & 1)
    games = games[np.lexsort((ids, known))]  # a stable sort
    ids, known = games[:, 0], games[:, -1] & 1
    last = np.ones(len(games), dtype=bool)
    last[:-1] = (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
    return games[last]


def _date(ms: int) -> datetime.date:
    return datetime.date(1970, 1, 1) + datetime.timedelta(days=ms // 86_400_000)


def ratings_in_order(matches: DataFrame, params: RatingParams = RatingParams(), late: str = "30 days") -> DataFrame:
    """Pre-match ratings of every game that can no longer be preceded, and late games marked as such.

    A day is played once the stream has seen an event ``late`` after it. However files land, games that
    are not late are rated as in one ordered fold over them; state is one number per participant and
    the games of the days that are open. Games without a date or league have no place and are left out.
    """
    narrow = _event_clock(matches.where("event_date IS NOT NULL AND league IS NOT NULL"), "event_date", late).select("league", *[c.split(" ")[0] for c in _GAME.split(", ")], "_at", "_clock")
    # the clock column ends here: Spark would drop late rows by it
    return narrow.select("league", *[c.split(" ")[0] for c in _GAME.split(", ")], "_at").groupBy("league").transformWithState(
        statefulProcessor=InOrder(params), outputStructType=_parse_datatype_string(RATED), outputMode="append", timeMode="eventTime"
    )


# -- windows with corrections (STM-01) --------------------------------------------------------------

WINDOWS = "match_id long, window_start timestamp, kind string, home_ticks long, away_ticks long, quotes long, added long"


class Corrected(StatefulProcessor):
    """Sums of one window per match: emitted when the watermark passes its end, corrected after that.

    ``window`` tells the sums when it closes, ``correction`` the new sums after quotes that came later,
    ``late`` the quotes that came after the window was forgotten. ``added`` counts each quote once. A key
    is a window and a slot of matches, so that timers and reads of state serve many matches at a time.
    """

    #: Matches of one entry of the state.
    PART = 100_000

    def __init__(self, width_ms: int, keep_ms: int):
        self.width, self.keep = width_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "told boolean")
        self.sums = handle.getListState("sums", "part binary")

    def _row(self, at: datetime.datetime, kind: str, sums: Sequence[int], added: int) -> Row:
        return Row(match_id=sums[0], window_start=at, kind=kind, home_ticks=sums[1], away_ticks=sums[2], quotes=sums[3], added=added)

    def _known(self) -> np.ndarray:
        """Rows of (match, home, away, quotes), one a match, by match."""
        parts = [np.frombuffer(p[0], dtype=np.int64).reshape(-1, 4) for p in self.sums.get()]
        return np.concatenate(parts) if parts else np.empty((0, 4), dtype=np.int64)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        start, new = key[0], np.empty((0, 4), dtype=np.int64)
        for chunk in _packed(((r[0], r[3], r[4], 1) for r in rows), 4, 50_000):
            new = _summed(np.concatenate([new, chunk[:, :4]]))
        if not len(new):
            return
        told = self.told.get()
        if told is None and timerValues.getCurrentWatermarkInMs() >= start + self.width + self.keep:
            for sums in new.tolist():
                yield self._row(_moment(start), "late", sums, sums[3])
            return
        whole = new
        if told is None:
            self.told.update((False,))
            self.handle.registerTimer(start + self.width)
            self.handle.registerTimer(start + self.width + self.keep)
        else:
            whole = _summed(np.concatenate([self._known(), new]))
        self.sums.put([(whole[i : i + self.PART].tobytes(),) for i in range(0, len(whole), self.PART)])
        if told is not None and told[0]:
            at = np.searchsorted(whole[:, 0], new[:, 0])
            for sums, added in zip(whole[at].tolist(), new[:, 3].tolist(), strict=True):
                yield self._row(_moment(start), "correction", sums, added)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        told = self.told.get()
        if told is not None and not told[0]:
            self.told.update((True,))
            at = _moment(key[0])
            for sums in self._known().tolist():
                yield self._row(at, "window", sums, sums[3])
        if expiredTimerInfo.getExpiryTimeInMs() >= key[0] + self.width + self.keep:
            self.sums.clear()
            self.told.clear()

    def close(self) -> None:
        pass


def _moment(ms: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).replace(tzinfo=None)


def _summed(rows: np.ndarray) -> np.ndarray:
    """One row a match, by match, of rows of (match, numbers that add up)."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    ids, starts = np.unique(rows[:, 0], return_index=True)
    return np.column_stack([ids, np.add.reduceat(rows[:, 1:], starts, axis=0)])


def corrected_windows(quotes: DataFrame, at: str, late: str = "2 days", width_minutes: int = 30, keep_days: int = 60, slots: int = 4) -> DataFrame:
    """Sums per match and tumbling window, their corrections, and what came too late for both.

    Quotes without a match or time belong to no window and are left out. The state of a window is three
    numbers a match, packed, and lives until ``keep_days`` after its end; matches of a window share ``slots`` tasks.
    """
    width = width_minutes * 60_000
    timed = _event_clock(quotes.where(F.col("match_id").isNotNull() & F.col(at).isNotNull()), at, late).withColumn("_start", F.col("_at") - F.pmod(F.col("_at"), F.lit(width)))
    slot = F.pmod(F.xxhash64("match_id"), F.lit(slots)).alias("_slot")
    counted = timed.select(F.col("match_id").cast("long"), "_start", slot, F.coalesce(F.col("home_ticks"), F.lit(0)).cast("long").alias("home_ticks"), F.coalesce(F.col("away_ticks"), F.lit(0)).cast("long").alias("away_ticks"))
    return counted.groupBy("_start", "_slot").transformWithState(
        statefulProcessor=Corrected(width, keep_days * 86_400_000), outputStructType=_parse_datatype_string(WINDOWS), outputMode="append", timeMode="eventTime"
    )


def latest_windows(told: DataFrame) -> DataFrame:
    """The sums of every window after its last correction: the one with the most quotes."""
    last = F.max_by(F.struct("home_ticks", "away_ticks", "quotes"), "quotes").alias("l")
    return told.where("kind <> 'late'").groupBy("match_id", "window_start").agg(last).select("match_id", "window_start", "l.*")


# -- last row per key (STM-04) ----------------------------------------------------------------------


class KeepLast(StatefulProcessor):
    """Lets a row pass if it comes after all earlier ones of its key by its own order, and says which revision it is.

    State is the order of the last row that passed; it is forgotten once the watermark is ``keep_ms``
    past the newest event of the key. A group is a slot of keys: its state is one entry and one timer,
    at the first time when a key of it may be forgotten.
    """

    def __init__(self, names: Sequence[str], keys: Sequence[str], keep_ms: int):
        self.names, self.keys, self.keep = list(names), [list(names).index(k) for k in keys], keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # per key: order of the last row that passed, its revision, the newest event
        self.last = handle.getValueState("last", "slot binary, due long")

    def _due(self, slot: dict) -> int | None:
        return min((newest + self.keep for *_, newest in slot.values() if newest is not None), default=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, width = {}, len(self.names)
        for r in rows:
            order, at = r[width], r[width + 1]
            k = tuple(_plain(r[i]) for i in self.keys)
            known = best.get(k)
            if known is None:
                best[k] = [r, order, at]
                continue
            if order > known[1]:
                known[:2] = r, order
            if at is not None and (known[2] is None or at > known[2]):
                known[2] = at
        if not best:
            return
        state = self.last.get()
        slot, due = (pickle.loads(state[0]), state[1]) if state else ({}, None)
        make = Row(*self.names, "revision")
        for k, (r, order, newest) in best.items():
            at, revision, known = slot.get(k, (None, 0, None))
            passes = at is None or order > at
            newest = newest if known is None else known if newest is None else max(known, newest)
            slot[k] = (order if passes else at, revision + passes, newest)
            if passes:
                yield make(*r[:width], revision + 1)
        first = self._due(slot)
        if first is not None and (due is None or first < due):
            self.handle.registerTimer(first)
            due = first
        self.last.update((pickle.dumps(slot), due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.last.get()
        if state is None:
            return iter(())
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        slot = {k: v for k, v in pickle.loads(state[0]).items() if v[2] is None or v[2] + self.keep > now}
        if not slot:
            self.last.clear()
            return iter(())
        due = self._due(slot)
        if due is not None:
            self.handle.registerTimer(due)
        self.last.update((pickle.dumps(slot), due))
        return iter(())

    def close(self) -> None:
        pass


def _plain(v):
    """A value of a key as one that a dictionary finds again: lists and NaN are not."""
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return "NaN" if v != v else v


def keep_last(stream: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, late: str = "2 days", keep_days: int = 30, slots: int = 16_384) -> DataFrame:
    """The rows that were the last of their key, by ``order``, when they arrived, with a ``revision``.

    Ties in ``order`` go to the greatest row by its remaining columns, so the result does not depend on
    how rows land; equal rows pass once. State is one order per key that had an event, by the time
    ``at``, in the last ``keep_days`` and what may be late; keys share ``slots`` entries of it. A key that changes after that starts at
    revision 1 again; ``last_rows`` of the output is right either way.
    """
    rest = [c for c in stream.columns if c not in order]
    out = _parse_datatype_string(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", revision long")
    timed = _event_clock(stream.withColumn("_order", _order(stream, [*order, *rest])), at, late)
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("_slot")
    return timed.select(*stream.columns, "_order", "_at", slot).groupBy("_slot").transformWithState(
        statefulProcessor=KeepLast(stream.columns, keys, keep_days * 86_400_000), outputStructType=out, outputMode="update", timeMode="eventTime"
    )


def _order(df: DataFrame, names: Sequence[str]):
    """Columns as one string that sorts as they do; nulls first. Numbers, dates, timestamps and strings."""
    parts = []
    for name in names:
        kind, c = df.schema[name].dataType.typeName(), F.col(name)
        if kind in ("byte", "short", "integer", "long"):
            shown = F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
        elif kind in ("date", "timestamp"):
            shown = F.lpad(F.hex(F.unix_micros(c.cast("timestamp")).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
        elif kind == "string":
            shown = F.hex(c)
        else:
            raise ValueError(f"no order for {name} of type {kind}")
        parts.append(F.coalesce(F.concat(F.lit("1"), shown), F.lit("0")))
    return F.concat_ws(" ", *parts)


def last_rows(passed: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key of what ``keep_last`` let pass."""
    columns = [c for c in passed.columns if c != "revision"]
    rest = [c for c in columns if c not in order]
    picked = passed.withColumn("_order", _order(passed, [*order, *rest])).groupBy(*keys).agg(F.max_by(F.struct(*columns), "_order").alias("_r"))
    return picked.select("_r.*")
