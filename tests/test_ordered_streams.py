"""Streams that land in three shuffled parts, beside the batch results."""

import datetime
import random

import pytest
from pyspark.sql import Row, functions as F

from duelframe.operators.ratings import RatingParams, _Chain, rate
from duelframe.sources import adapters as A
from duelframe.streaming import jobs as Z, ordered as O


def landings(spark, df, folder, parts=3, seed=1, first=None):
    """A stream over ``folder`` and a function that lands the k-th part."""
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    piece = [rows[k::parts] for k in range(parts)]
    if first is not None:
        piece[0] += [r for p in piece[1:] for r in p if first(r)]
        piece[1:] = [[r for r in p if not first(r)] for p in piece[1:]]

    def land(k):
        spark.createDataFrame(piece[k], df.schema).coalesce(2).write.mode("append").parquet(folder)

    land(0)
    return spark.readStream.schema(df.schema).parquet(folder), land


COLUMNS = ["league", "event_date", "match_id", "year", "home_id", "away_id", "home_score", "away_score"]


def rated_over_landings(spark, games, tmp_path, late, parts=3):
    stream, land = landings(spark, games, str(tmp_path / "in"), parts)
    for k in range(parts):
        if k:
            land(k)
        O.drain_ordered(O.ratings_in_order(stream, RatingParams(), late), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_ratings_over_three_landings(spark, sf, tmp_path):
    games = A.matches(spark, sf).select(*COLUMNS).where("league < 2 AND year < 1997")
    seen = rated_over_landings(spark, games, tmp_path, "4000 days", parts=1)
    assert not seen  # all games may still be preceded
    seen = rated_over_landings(spark, games, tmp_path / "b", "20 days")
    on_time, late = [r for r in seen if not r.late], {r.match_id for r in seen if r.late}
    newest = max(r.event_date for r in games.collect())
    assert late and len(seen) == len({r.match_id for r in seen})
    want = {r.match_id: r for r in rate(games.where(~F.col("match_id").isin(list(late)))).collect()}
    assert len(on_time) > 20
    for r in on_time:  # none is mis-rated
        w = want[r.match_id]
        assert (r.home_elo, r.away_elo, r.home_elo_prob) == pytest.approx((w.home_elo, w.away_elo, w.home_elo_prob), abs=1e-9)
    held = {g.match_id for g in games.collect()} - {r.match_id for r in seen}
    assert all(g.event_date >= newest - datetime.timedelta(days=20) for g in games.collect() if g.match_id in held)


def test_landings_in_order_lose_nothing(spark, sf, tmp_path):
    games = A.matches(spark, sf).select(*COLUMNS).where("league = 1 AND year < 1997")
    folder = str(tmp_path / "in")
    cuts = ["1995-09-01", "1996-06-01", "2100-01-01"]
    lower = "1900-01-01"
    for upper in cuts:
        games.where(F.col("event_date").between(F.lit(lower), F.date_sub(F.lit(upper), 1))).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(games.schema).parquet(folder)
        O.drain_ordered(O.ratings_in_order(stream, late="0 days"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        lower = upper
    seen = {r.match_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.match_id: r for r in rate(games).collect()}
    assert not [r for r in seen.values() if r.late]
    for i, r in seen.items():
        assert (r.home_elo, r.away_elo) == pytest.approx((want[i].home_elo, want[i].away_elo), abs=1e-9)
    assert len(want) - len(seen) <= 5  # the newest day is open


def quotes_of(spark, sf):
    return A.table(spark, sf, "lineitem").where("l_orderkey % 40 = 0").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_shipdate").cast("timestamp").alias("quoted_at"), F.col("l_linenumber").alias("line_no"),
        (F.col("l_quantity").cast("int") + 21).alias("home_ticks"), (F.lit(72) - F.col("l_quantity").cast("int")).alias("away_ticks"),
    )


def test_every_quote_is_counted_or_listed(spark, sf, tmp_path):
    quotes = quotes_of(spark, sf)
    stream, land = landings(spark, quotes, str(tmp_path / "in"))
    for k in range(3):
        if k:
            land(k)
        O.drain_ordered(O.corrected_windows(stream, "quoted_at", keep_days=400), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    told = spark.read.parquet(str(tmp_path / "out"))
    kinds = {r.kind: r.n for r in told.groupBy("kind").agg(F.sum("added").alias("n")).collect()}
    newest = quotes.agg(F.max("quoted_at")).first()[0]
    open_ = quotes.where(F.col("quoted_at") + F.expr("INTERVAL 30 MINUTES") > F.lit(newest) - F.expr("INTERVAL 2 DAYS")).count()
    assert sum(kinds.values()) + open_ == quotes.count() and min(kinds.get(k, 0) for k in ("window", "correction", "late")) > 0
    late = {(r.match_id, r.window_start) for r in told.where("kind = 'late'").collect()}
    want = {(r.match_id, r.quoted_at): (r.h, r.a, r.n) for r in quotes.groupBy("match_id", "quoted_at").agg(F.sum("home_ticks").alias("h"), F.sum("away_ticks").alias("a"), F.count("*").alias("n")).collect()}
    final = O.latest_windows(told).collect()
    assert final and all(want[r.match_id, r.window_start] == (r.home_ticks, r.away_ticks, r.quotes) for r in final if (r.match_id, r.window_start) not in late)


def test_last_row_per_key_over_three_landings(spark, sf, tmp_path):
    rows = quotes_of(spark, sf).select("match_id", (F.col("line_no") % 2).cast("int").alias("slot"), F.to_date("quoted_at").alias("day"), "home_ticks")
    stream, land = landings(spark, rows, str(tmp_path / "in"), seed=5)
    for k in range(3):
        if k:
            land(k)
        O.drain_updates(O.keep_last(stream, ["match_id", "slot"], ["day", "home_ticks"], at="day", keep_days=3000), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    passed = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = {(r.match_id, r.slot): (r.l.day, r.l.home_ticks) for r in rows.groupBy("match_id", "slot").agg(F.max(F.struct("day", "home_ticks")).alias("l")).collect()}
    found = O.last_rows(passed, ["match_id", "slot"], ["day", "home_ticks"]).collect()
    assert {(r.match_id, r.slot): (r.day, r.home_ticks) for r in found} == want and len(found) == len(want)
    assert want.keys() <= {(r.match_id, r.slot) for r in passed.where("revision = 1").collect()} and passed.where("revision > 1").count() > 0



class Calls:
    """A handle that keeps one group's state in plain objects and counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers, self.stored = 0, set(), {}

    def _state(self, name, *_):
        handle, missing = self, object()

        class State:
            def _at(self, key=missing, value=missing):
                handle.calls += 1
                at = name if key is missing else (name, key)
                if value is not missing:
                    handle.stored[at] = value
                return handle.stored.get(at)

            def get(self):
                return self._at()

            def getValue(self, key):
                return self._at(key)

            def update(self, value):
                self._at(value=value)

            def updateValue(self, key, value):
                self._at(key, value)

            def removeKey(self, key):
                handle.calls += 1
                handle.stored.pop((name, key), None)

            def clear(self):
                handle.calls += 1
                handle.stored.pop(name, None)

        class Parts(State):
            def get(self):
                return iter(self._at() or ())

            def put(self, values):
                self._at(value=values)

        return Parts() if name == "sums" else State()

    getMapState = getValueState = getListState = _state

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


DAY = 86_400_000


def started(processor):
    handle = Calls()
    processor.init(handle)
    return processor, handle


def test_calls_of_the_store_do_not_go_with_quotes():
    quotes = [Row(match_id=m, _start=0, _slot=0, home_ticks=m % 7, away_ticks=1) for m in range(3000) for _ in range(2)]
    windows, handle = started(O.Corrected(1000, DAY))
    assert not list(windows.handleInputRows((0, 0), iter(quotes), At(0))) and handle.calls < 20
    told = list(windows.handleExpiredTimer((0, 0), At(1000), At(1000)))
    assert {(r.match_id, r.home_ticks, r.away_ticks, r.quotes) for r in told} == {(m, 2 * (m % 7), 2, 2) for m in range(3000)}
    (more,) = windows.handleInputRows((0, 0), iter(quotes[10:11]), At(2000))
    assert (more.kind, more.match_id, more.home_ticks, more.quotes, more.added) == ("correction", 5, 15, 3, 1) and handle.calls < 40
    assert not list(windows.handleExpiredTimer((0, 0), At(1000 + DAY), At(1000 + DAY))) and not handle.stored
    (late,) = windows.handleInputRows((0, 0), iter(quotes[:1]), At(1000 + DAY))
    assert late.kind == "late"


def test_calls_of_the_store_do_not_go_with_games():
    games = [Row(league=1, match_id=m, year=2000, home_id=m % 5, away_id=5 + m % 7, home_score=None if m % 9 == 0 else m % 40, away_score=10, _at=m % 3 * DAY) for m in range(3000)]
    again = [Row(league=1, match_id=3, year=2000, home_id=3, away_id=8, home_score=0, away_score=50, _at=0), Row(league=1, match_id=None, year=2000, home_id=1, away_id=2, home_score=1, away_score=2, _at=0)]
    order, handle = started(O.InOrder(RatingParams()))
    assert not list(order.handleInputRows((1,), iter(games + again), At(0))) and handle.calls < 20 and handle.timers == {0, DAY, 2 * DAY}
    played = [r for day in range(2) for r in order.handleExpiredTimer((1,), At(day * DAY), At(day * DAY))]
    chain, want = _Chain(RatingParams()), []
    for g in [again[1], *sorted((g for g in [*games[:3], *games[4:], again[0]] if g._at < 2 * DAY), key=lambda g: (g._at, g.match_id))]:
        want.append((g.match_id, *chain.play(g.year, g.home_id, g.away_id, g.home_score, g.away_score)[:3]))
    assert [(r.match_id, r.home_elo, r.away_elo, r.home_elo_prob) for r in played] == want
    assert [r.match_id for r in order.handleInputRows((1,), iter(games[:2]), At(DAY))] == [0, 1]  # late


def test_calls_of_the_store_do_not_go_with_keys():
    rows = [Row(match_id=m, day=d, _order=f"{d}", _at=d * DAY, _slot=0) for d in (1, 3, 2) for m in (*range(1000), None)]
    last, handle = started(O.KeepLast(["match_id", "day"], ["match_id"], 5 * DAY))
    passed = list(last.handleInputRows((0,), iter(rows), At(0)))
    assert sorted((r.match_id or 0, r.day, r.revision) for r in passed) == sorted((m, 3, 1) for m in (0, *range(1000))) and handle.calls < 10
    newer = Row(match_id=7, day=4, _order="4", _at=4 * DAY, _slot=0)
    assert [(r.match_id, r.revision) for r in last.handleInputRows((0,), iter([newer, rows[8]]), At(0))] == [(7, 2)]
    assert handle.timers == {8 * DAY}
    list(last.handleExpiredTimer((0,), At(8 * DAY), At(8 * DAY)))  # all but match 7 are forgotten
    assert [(r.match_id, r.revision) for r in last.handleInputRows((0,), iter([newer, rows[8]]), At(8 * DAY))] == [(8, 1)]
    list(last.handleExpiredTimer((0,), At(9 * DAY), At(9 * DAY)))
    assert handle.calls < 40 and not handle.stored


def test_closed_windows_are_never_broadcast(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(m, at + datetime.timedelta(days=m), 30, 40) for m in range(20)]
    spark.createDataFrame(rows, "match_id long, quoted_at timestamp, home_ticks int, away_ticks int").write.parquet(str(tmp_path / "in"))
    quotes = spark.readStream.schema("match_id long, quoted_at timestamp, home_ticks int, away_ticks int").parquet(str(tmp_path / "in"))
    decisions = spark.range(20).selectExpr("id AS match_id", "0.5D AS model_prob", "0.5D AS old_prob")
    query = Z.drain(Z.redecide(Z.price_windows(quotes, "quoted_at", "match_id"), decisions), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert "Broadcast" not in query._jsq.explainInternal(False)
    assert sorted(r.match_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(17))
