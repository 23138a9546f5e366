"""The cut plan must equal the plain window for every look-back operator, also under heavy skew."""

import datetime
import re

import pytest
from conftest import same
from pyspark.sql import functions as F

from duelframe.operators import groups as G, history as H, windows as W
from duelframe.operators.history import Layout, measure
from duelframe.operators.sides import team_log
from duelframe.plans.common import log
from duelframe.sources import adapters as A


def skewed_matches(spark, n=600):
    """A third of all games on one participant, many on one single day, some without a score."""
    day = F.when(F.col("id") % 5 == 0, F.lit(40)).otherwise((F.col("id") * 7) % 90).cast("int")
    home = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise((F.col("id") * 11) % 6 + 1)
    away = F.when(home == 0, (F.col("id") * 5) % 6 + 1).otherwise((home + F.col("id") % 5) % 6 + 7)
    return spark.range(n).select(
        F.col("id").alias("match_id"),
        F.date_add(F.lit(datetime.date(2001, 1, 1)), day).alias("event_date"),
        F.lit(2001).alias("year"),
        (day / 7).cast("int").alias("round"),
        home.cast("int").alias("home_id"),
        away.cast("int").alias("away_id"),
        F.when(F.col("id") % 9 != 0, (F.col("id") * 13) % 5).cast("int").alias("home_score"),
        F.when(F.col("id") % 9 != 0, (F.col("id") * 17) % 4).cast("int").alias("away_score"),
        F.lit(0).alias("venue_id"),
        F.lit(1).alias("league"),
    )


@pytest.fixture(scope="module")
def games(spark):
    m = skewed_matches(spark)
    return m.persist()


def layouts(df, keys):
    direct = measure(df, keys, max_rows=10**9)
    cut = measure(df, keys, max_rows=20)
    assert direct.bounds is None
    assert cut.bounds is not None
    return direct, cut


def fullest(df, layout):
    return layout.cut(df).groupBy(*layout.partition).count().agg(F.max("count")).first()[0]


def test_measure_cuts_hot_days_by_id(games):
    df = team_log(games)
    assert fullest(df, measure(df, ["entity_id"], max_rows=20)) <= 40


def test_no_cell_is_much_above_the_limit(spark):
    """A long even history beside a burst of days, a burst in one day with scattered ids, null keys and dates, many small keys."""
    id = F.col("id")
    day = (
        F.when(id < 2000, id % 1000)
        .when(id < 3900, 500 + id % 20)
        .when(id < 5000, F.lit(77))
        .when(id < 5060, F.lit(None))
        .when(id < 6000, id % 400)
        .otherwise(id % 50)
    )
    key = F.when(id < 2000, 1).when(id < 3900, 2).when(id < 5060, 3).when(id < 6000, F.lit(None)).otherwise(id % 300 + 10)
    df = spark.range(9000).select(
        key.alias("k"), F.date_add(F.lit(datetime.date(2001, 1, 1)), day.cast("int")).alias("event_date"),
        F.when(id % 7 == 0, id * id * 1000).otherwise(id).alias("match_id"), (id % 13).alias("x"),
    )
    layout = measure(df, ["k"], max_rows=100)
    assert fullest(df, layout) <= 200
    assert df.count() == layout.cut(df).count()
    plain = measure(df, ["k"], max_rows=10**9)
    totals = {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "n": ("count", F.col("x"))}
    same(H.running(df, plain, totals), H.running(df, layout, totals))
    last = lambda w: {"three": F.collect_list("x").over(w.prior(3))}
    same(H.lookback(df, plain, 3, last), H.lookback(df, layout, 3, last))


def test_no_cell_of_timestamps_is_much_above_the_limit(spark):
    id = F.col("id")
    micros = F.when(id < 800, id * 3_600_000_000).when(id < 2000, 7_000_000_000 + id * 37).otherwise(id * 60_000_000)
    df = spark.range(3000).select(F.lit(1).alias("k"), F.timestamp_micros(micros).alias("ts"), id.alias("event_id"), (id % 5).alias("x"))
    layout = measure(df, ["k"], "ts", "event_id", max_rows=50)
    assert fullest(df, layout) <= 100
    last = lambda w: {"three": F.collect_list("x").over(w.prior(3))}
    same(H.lookback(df, measure(df, ["k"], "ts", "event_id", max_rows=10**9), 3, last), H.lookback(df, layout, 3, last))


def test_rolling_form(games):
    df = team_log(games)
    a, b = layouts(df, ["entity_id"])
    same(W.rolling_form(df, a), W.rolling_form(df, b))


def test_streak(games):
    df = team_log(games)
    a, b = layouts(df, ["entity_id"])
    same(W.streak(df, a), W.streak(df, b))


def test_consistency_and_schedule(games):
    df = team_log(games)
    a, b = layouts(df, ["entity_id"])
    same(W.scoring_consistency(df, a), W.scoring_consistency(df, b))
    same(W.schedule(df, a), W.schedule(df, b))


def test_head_to_head(games):
    df = W.paired_events(games)
    a, b = layouts(df, ["low_id", "high_id"])
    same(W.head_to_head(df, a), W.head_to_head(df, b))


def test_expanding(games):
    df = team_log(games, ("match_id", "event_date", "venue_id", "year"))
    a, b = layouts(df, ["entity_id", "venue_id"])
    same(W.venue_record(df, a), W.venue_record(df, b))
    same(W.home_ground(df, a, a), W.home_ground(df, b, b))
    m = games.select("match_id", "event_date", "home_id", "home_score", "away_score", F.col("home_score").alias("attendance"), F.lit("r").alias("referee"))
    a, b = layouts(m, ["referee"])
    same(W.official_record(m, a), W.official_record(m, b))
    same(W.attendance_ratio(m, a), W.attendance_ratio(m, b))


def test_lineups(spark, sf):
    apps = A.appearances(spark, sf)
    lines = G.lineups(log(spark, sf), apps).persist()
    a, b = measure(lines, ["entity_id"]), measure(lines, ["entity_id"], max_rows=15)
    assert a.bounds is None and b.bounds is not None
    same(G.lineup_stability(lines, a).select("match_id", "side", "lineup_stability"), G.lineup_stability(lines, b).select("match_id", "side", "lineup_stability"))
    same(G.slot_changes(lines, a, (1, 2)), G.slot_changes(lines, b, (1, 2)))
    same(G.expected_starters(apps), G.expected_starters(apps, max_rows=15))


def test_weighted(games):
    df = team_log(games).withColumn("weight", F.col("opponent_id") * 0.1 + 1)
    a, b = layouts(df, ["entity_id"])
    same(W.weighted_rolling(df, a, ["points_for"]), W.weighted_rolling(df, b, ["points_for"]))


def test_timestamp_histories_are_cut_by_seconds(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    a = measure(e, ["user_id"], "ts", "event_id")
    b = measure(e, ["user_id"], "ts", "event_id", max_rows=8)
    assert b.bounds is not None
    cols = lambda lay: W.rolling_stats(e, lay, ["value"], (3,))
    same(cols(a), cols(b))


def test_layout_defaults():
    assert Layout(("k",)).partition == ["k"]


@pytest.mark.parametrize("limit, parts", [(20, 1), (40, 8), (3, 1)])
def test_opened_history_gives_what_one_uncut_gives(games, limit, parts):
    """Form, consistency, schedule and streak from one cut, with unscored games, a hot day and games without a participant."""
    unknown = games.withColumn("home_id", F.when(F.col("match_id") % 31 != 0, F.col("home_id")))
    df = team_log(unknown).withColumns({"halftime_lead": F.col("margin"), "penalty_diff": -F.col("margin")})
    out = {}
    for most in (10**9, limit):
        layout = measure(df, ["entity_id"], max_rows=most, parts=parts)
        assert (layout.bounds is None) == (most > limit)
        rows, opened = layout.opened(df, 8, "result")
        made = W.schedule(W.scoring_consistency(W.rolling_form(rows, opened), opened), opened)
        out[most] = opened.closed(W.streak(made, opened))
    same(out[10**9], out[limit])
    text = out[limit]._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"Exchange hashpartitioning\(entity_id#\d+, _cell", text))) <= 2  # the rows, and the last rows of cells


def test_runs_go_on_over_cells_without_results(spark):
    """A streak over several cells, cells without any result, turns at their ends, and a participant never scored."""
    said = "WWWWW--------------------WWL" + "L" * 30 + "W" + "-" * 25 + "D"
    value = {"W": 1.0, "L": 0.0, "D": 0.5, "-": None}
    start = datetime.date(2001, 1, 1)
    rows = [(1, i, start + datetime.timedelta(days=i), value[c]) for i, c in enumerate(said)]
    rows += [(2, 100 + i, start + datetime.timedelta(days=i), None) for i in range(30)]
    df = spark.createDataFrame(rows, "entity_id int, match_id long, event_date date, result double")
    for most in (3, 5, 11):
        layout = measure(df, ["entity_id"], max_rows=most)
        opened_rows, opened = layout.opened(df, 2, "result")
        got = {r.match_id: r.streak for r in opened.closed(W.streak(opened_rows, opened)).collect()}
        last, length = None, 0
        for _, i, _, v in rows[: len(said)]:
            assert got[i] == (0 if last is None else length if last == 1.0 else -length), (most, i)
            if v is not None:
                last, length = v, length + 1 if v == last else 1
        assert not any(got[100 + i] for i in range(30))
