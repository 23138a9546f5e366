"""Hand-made cases for the rules that are easy to get wrong."""

import datetime

from conftest import rows, same
from pyspark.sql import Row, functions as F

from duelframe.functions import numbers as N, text as X
from duelframe.operators import decisions as D, entity as E, features as FX, groups as G, imputation as I, link as L, metrics as M, ratings as R, windows as W
from duelframe.operators.history import Layout
from duelframe.operators.sides import team_log
from duelframe.schema import nan_to_null

DAY = datetime.date(2001, 3, 1)


def season(spark, scores, home=1, away=2, start=DAY, step=7, year=None):
    """Matches between two sides in order; None is an unplayed game."""
    data = [
        (i, start + datetime.timedelta(days=step * i), (year or start.year), i + 1, home, away, *(s or (None, None)))
        for i, s in enumerate(scores)
    ]
    return spark.createDataFrame(
        data, "match_id long, event_date date, year int, round int, home_id int, away_id int, home_score int, away_score int"
    ).withColumn("league", F.lit(0))


def of(df, entity, column):
    return [r[column] for r in df.filter(F.col("entity_id") == entity).orderBy("event_date", "match_id").collect()]


LOG = Layout(("entity_id",))


def test_streak_counts_draws_and_losses_as_negative(spark):
    m = season(spark, [(9, 1), (9, 1), (5, 5), (5, 5), (1, 9), (9, 1), (0, 0)])
    df = W.streak(team_log(m), LOG)
    assert of(df, 1, "streak") == [0, 1, 2, -1, -2, -1, 1]


def test_unscored_game_is_unknown_unless_legacy(spark):
    m = season(spark, [(9, 1), None, (9, 1), (9, 1)])
    now = of(W.rolling_form(team_log(m), LOG, windows=(3,)), 1, "win_rate_3")
    old = of(W.rolling_form(team_log(m), LOG, windows=(3,), legacy_unscored=True), 1, "win_rate_3")
    assert now == [None, 1.0, 1.0, 1.0]
    assert old[2] == 0.5 and round(old[3], 6) == round(2 / 3, 6)
    assert of(W.streak(team_log(m), LOG), 1, "streak") == [0, 1, 1, 2]


def test_head_to_head_counts_scored_meetings_from_both_sides(spark):
    a = season(spark, [(9, 1), None, (3, 5)])
    b = season(spark, [(7, 2)], home=2, away=1, start=DAY + datetime.timedelta(days=200)).withColumn("match_id", F.lit(9).cast("long"))
    df = W.head_to_head(W.paired_events(a.unionByName(b)), Layout(("low_id", "high_id")), (1, 3))
    last = {r["match_id"]: r for r in df.collect()}
    assert last[9]["h2h_matches_3"] == 2 and last[9]["h2h_home_win_rate_3"] == 0.5
    assert last[9]["h2h_avg_margin_1"] == 2.0  # the visitor of then is the host of now
    assert last[2]["h2h_matches_1"] == 1 and last[2]["h2h_avg_margin_1"] == 8.0
    assert last[0]["h2h_home_win_rate_all"] is None and last[0]["h2h_matches_all"] == 0


def test_spread_needs_three_games(spark):
    m = season(spark, [(4, 0), (8, 0), (12, 0), (1, 0)])
    got = of(W.scoring_consistency(team_log(m), LOG, windows=(5,)), 1, "pf_std_5")
    assert got[:3] == [None, None, None] and got[3] == 4.0


def test_nearest_date_takes_the_earlier_of_two_equally_near(spark):
    m = season(spark, [(1, 0)])
    d = lambda n: DAY + datetime.timedelta(days=n)
    feed = spark.createDataFrame([(1, d(1), 1, 2), (2, d(-1), 1, 2), (3, d(3), 1, 2)], "odds_id long, odds_date date, home_id int, away_id int")
    assert L.nearest_link(m, feed, []).first()["odds_id"] == 2
    far = feed.filter("odds_id = 3")
    assert L.nearest_link(m, far, []).first()["odds_id"] is None


def test_orientation_prefers_given_then_swapped(spark):
    m = season(spark, [(1, 0)])
    feed = spark.createDataFrame([(1, DAY, 2, 1), (2, DAY - datetime.timedelta(days=2), 1, 2)], "odds_id long, odds_date date, home_id int, away_id int")
    assert L.orientation_in_feed(m, feed).first()["orientation"] == "swapped"  # same day beats two days off
    assert L.orientation_in_feed(m, feed.filter("odds_id = 2")).first()["orientation"] == "direct"
    assert L.orientation_in_feed(m, feed.filter("odds_id = 9")).first()["orientation"] == "unmatched"


def test_season_regression_runs_after_the_first_read(spark):
    one = season(spark, [(9, 1)], year=2001)
    two = season(spark, [(1, 9), (1, 9)], start=DAY + datetime.timedelta(days=365), year=2002).withColumn("match_id", F.col("match_id") + 10)
    m = one.unionByName(two)
    got = {r["match_id"]: r for r in R.rate(m).collect()}
    after = got[0]["home_after"]
    assert got[10]["home_elo"] == after  # recorded before the regression
    kept = 1500 + 0.75 * (after - 1500)
    expected = kept + 20 * (0 - 1 / (1 + 10 ** ((3000 - kept - kept - 50) / 400)))
    assert abs(got[10]["home_after"] - expected) < 1e-9
    early = {r["match_id"]: r for r in R.rate(m, [R.RatingParams(reset_before_read=True)]).collect()}
    assert abs(early[10]["home_elo"] - kept) < 1e-9


def test_identity_survives_a_gap_of_two_years_only(spark):
    seen = spark.createDataFrame([("a", y) for y in (2001, 2003, 2006, 2007)], "name string, year int")
    got = rows(G.identity_islands(seen, ["name"]))
    assert [(r[3], r[0]) for r in got] is not None
    by_year = {r["year"]: r["first_year"] for r in G.identity_islands(seen, ["name"]).collect()}
    assert by_year == {2001: 2001, 2003: 2001, 2006: 2006, 2007: 2006}


def test_lineup_is_compared_with_the_last_known_one(spark):
    lines = spark.createDataFrame(
        [(0, DAY, "home", 1, [1, 2]), (1, DAY, "home", 1, None), (2, DAY, "home", 1, [2, 3])],
        "match_id long, event_date date, side string, entity_id int, starters array<long>",
    )
    assert of(G.lineup_stability(lines, LOG), 1, "lineup_stability") == [None, None, 0.5]


def test_missing_and_zero_prices(spark):
    df = spark.createDataFrame([(1.5, float("nan")), (0.0, 2.0), (None, 2.0), (2.0, 2.0)], "h double, a double")
    home, away, over = N.fair_pair("h", "a")
    got = [r[0] for r in nan_to_null(df).select(home).collect()]
    assert got == [None, None, None, 0.5]


def test_tier_boundaries_count_once(spark):
    df = spark.createDataFrame([(0.10,), (0.30,), (0.0,), (0.29,)], "c double")
    assert [r[0] for r in df.select(M.tier("c")).collect()] == ["lean", "lock", "tossup", "lean"]


def test_even_price_belongs_to_the_declared_side(spark):
    df = spark.createDataFrame([(2.0, 2.0, None, None, 1, 2)], "h double, a double, m double, s double, home_id int, away_id int")
    assert df.select(D.decide("h", "a", "m", "s")["tip"]).first()[0] == 2
    assert df.select(D.decide("h", "a", "m", "s", tie_home=True)["tip"]).first()[0] == 1


def test_round_order_and_parsers(spark):
    df = spark.createDataFrame([("7",), ("Grand Final",), ("Trial",)], "r string")
    assert [x[0] for x in df.select(X.round_sort_key("r")).collect()] == [7, 104, 99]
    one = spark.range(1)
    assert one.select(X.twelve_hour(F.lit("12:05 AM")), X.twelve_hour(F.lit("7:30 pm")), X.twelve_hour(F.lit("19:30")), X.twelve_hour(F.lit("19:30"), strict=False)).first() == Row(0, 19, None, 19)
    got = one.select(X.ordinal_date(F.lit("2nd March"), F.lit(2024)), X.lenient_int(F.lit("1,234")), X.lenient_int(F.lit("-")), X.snake(F.lit("runMetresTotal")), X.slug(F.lit("St. George  Park"))).first()
    assert tuple(got) == (datetime.date(2024, 3, 2), 1234, 0, "run_metres_total", "st-george-park")


def test_medians_are_exact(spark):
    df = spark.createDataFrame([(float(i * i % 97), None if i % 4 else i * 1.0, 5.0) for i in range(200)], "a double, b double, c double")
    import statistics

    a = statistics.median(r["a"] for r in df.collect())
    b = statistics.median(r["b"] for r in df.collect() if r["b"] is not None)
    assert I.exact_medians(df, ["a", "b", "c"], bins=4) == {"a": a, "b": b, "c": 5.0}
    assert I.exact_medians(df.filter("a > 1e9"), ["a"]) == {"a": None}


def test_with_without_equals_listing_the_games(spark):
    apps = spark.createDataFrame(
        [(m, 1, p, 2001, True) for m in range(12) for p in (1, 2, 3) if (m + p) % (p + 2)], "match_id long, entity_id int, member_id long, year int, is_starter boolean"
    )
    log = spark.createDataFrame([(m, 1, 2001, float(m % 2), 0.4, m - 5) for m in range(12)], "match_id long, entity_id int, year int, result double, expected double, margin int")
    got = {r["member_id"]: r for r in G.with_without(apps, log, 1, 1).collect()}
    for p in (1, 2, 3):
        played = {m for m in range(12) if (m + p) % (p + 2)}
        mean = lambda ms: sum(m % 2 - 0.4 for m in ms) / len(ms)
        assert abs(got[p]["elo_adj_impact"] - (mean(played) - mean(set(range(12)) - played))) < 1e-9
        assert got[p]["games_started"] == len(played)


def test_unknown_name_raises_when_strict(spark):
    import pytest

    aliases = spark.createDataFrame([("a", "A")], "alias string, canonical string")
    df = spark.createDataFrame([("b",)], "n string")
    assert E.canonical_names(df, ["n"], aliases, strict=False).first()[0] == "b"
    with pytest.raises(Exception, match="unknown name"):
        E.canonical_names(df, ["n"], aliases).collect()
    assert E.duplicate_aliases(aliases.union(spark.createDataFrame([("A ", "B")], aliases.schema))).count() == 1


def test_missing_ground_report_is_unknown(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, None, None, "")], "precipitation_mm double, wind_speed_kmh double, temperature_c double, ground_conditions string")
    assert [r["bad_conditions_score"] for r in FX.weather_features(df).collect()] == [None, 0.0]
    assert FX.weather_features(df, blank_when_missing=True).first()["bad_conditions_score"] == 0.0


def test_auc_handles_ties(spark):
    df = spark.createDataFrame([("m", p, y) for p, y in ((0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.8, 0))], "model string, prob double, label int")
    same(M.auc(df, ["model"]), spark.createDataFrame([("m", 4.0 / 6.0)], "model string, auc double"))
