"""Steps that the third review found too slow or too large: the same rows, in bounded tasks and fewer passes."""

import datetime
import json
import random
import statistics
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_plans import plan

from duelframe.operators import groups as G, imputation as I
from duelframe.plans import backtest as B, decision_queries, link_queries, source_queries
from duelframe.plans.catalog import QUERIES
from duelframe.sources import adapters as A, feeds as J, pages as P

DAY = datetime.date(2001, 1, 1)
STARTERS = "entity_id int, match_id long, event_date date, slot int, member_id long, member_name string, is_starter boolean"


def starters(spark):
    """Two participants, one without an id, a match of unknown number, one without starters, one listed on two days, empty slots and repeated rows."""
    made = []
    for match in range(40):
        for entity in (1, 2):
            starts = match != 11
            for slot in (1, 2, None):
                holder = None if match == 17 and slot == 2 else (match * 7 + entity + (slot or 5)) % 4
                row = (entity, match, DAY + datetime.timedelta(match % 13), slot, holder, f"P S{holder}", starts)
                made += [row] * (2 if match % 9 == 0 else 1)
    made += [(1, 5, DAY + datetime.timedelta(90), 1, 3, "P S3", True), (1, None, DAY, 1, 2, "P S2", True), (None, 5, DAY, 1, 2, "P S2", True)]
    return made


def usual_by_hand(made, n=5):
    games, held = defaultdict(set), defaultdict(list)
    for entity, match, day, slot, member, _, starts in made:
        if entity is not None:
            games[entity].add((day, -1 if match is None else match))
            if starts and match is not None:
                held[entity, match].append((slot, member))
    out = []
    for entity, known in games.items():
        order = sorted(known)
        for at, (_, match) in enumerate(order):
            spots = defaultdict(Counter)
            for _, earlier in order[max(0, at - n) : at]:
                for slot, member in held[entity, earlier]:
                    spots[slot][member] += 1
            for slot, who in spots.items():
                best = min(who, key=lambda m: (-who[m], -1 if m is None else m))
                out.append((entity, best, None if match == -1 else match, slot))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_rows", [None, 7])
def test_expected_starters_by_hand_without_repeating_starters(spark, max_rows):
    made = starters(spark)
    out = G.expected_starters(spark.createDataFrame(made, STARTERS), max_rows=max_rows)
    got = [tuple(r) for r in out.select("entity_id", "expected_member", "match_id", "slot").collect()]
    assert sorted(got, key=repr) == usual_by_hand(made)
    assert "sequence(" not in plan(out)


def test_lineup_changes_by_hand(spark):
    made = [r for r in starters(spark) if r[3] is not None]
    apps = spark.createDataFrame(made, STARTERS)
    expected = spark.createDataFrame(
        [(e, m, s, f"Q S{m % 4}") for e in (1, 2, None) for m in (3, 5, 9, 11, 99) for s in (1, 2, 3, 14)], "entity_id int, match_id long, slot int, expected string"
    )
    now = defaultdict(list)
    for entity, match, _, slot, _, name, starts in made:
        if starts:
            now[entity, match].append((slot, name))
    want = []
    for e, m, s, name in [tuple(r) for r in expected.collect()]:
        if s <= 13 and e is not None and now[e, m]:
            for actual in [a for k, a in now[e, m] if k == s] or [None]:
                if actual is None or actual.split(" ")[-1] != name.split(" ")[-1]:
                    want.append((actual, "MISSING" if actual is None else "REPLACED", e, name, m, s))
    out = G.lineup_changes(expected, apps)
    assert plan(out).count("Join") == 1
    assert rows(out) == sorted(want, key=repr)


def test_member_lines_are_dealt_in_tasks_of_bounded_size(spark, sf, monkeypatch):
    monkeypatch.setattr(A, "ROWS_PER_TASK", 500)
    lines = A.table(spark, sf, "lineitem").filter("l_orderkey is not null").count()
    n = -(-lines // 500)
    assert n > 4 and "hashpartitioning(l_orderkey" in plan(A.appearances(spark, sf)) and f", {n}), REPARTITION_BY_NUM" in plan(A.appearances(spark, sf))
    assert f", {n}), REPARTITION_BY_NUM" in plan(QUERIES["wn17_member_form"](spark, sf))


def test_arrays_become_rows_in_one_pass(spark):
    arrays = spark.createDataFrame(
        [(1, ["a", None], ["b"]), (2, None, ["c"]), (3, [], None)], "match_id int, lineup array<string>, bench array<string>"
    )
    out = G.appearance_rows(arrays, ["match_id"], bench_from=3)
    assert out.columns == ["match_id", "member_name", "slot", "is_starter"]
    assert {tuple(r) for r in out.collect()} == {(1, "a", 1, True), (1, None, 2, True), (1, "b", 3, False), (2, "c", 3, False)}
    assert "Union" not in plan(out)


def test_landed_pages_in_bundles_equal_single_files(spark, tmp_path):
    made = spark.createDataFrame(
        [(1990 + i % 3, i // 3, "<p>é\n" * i) for i in range(60)] + [(None, 1, "x"), (1991, None, "y"), (1992, 99, None)] + [(1990, 98, "twice")] * 2, "year int, round long, value string"
    )
    single, bundle = f"{tmp_path}/single", f"{tmp_path}/bundle"
    made.coalesce(1).write.partitionBy("year", "round").text(single)
    P.land_pages(made.coalesce(1), bundle)
    assert rows(P.landed_pages(spark, bundle, bundled=True)) == rows(P.landed_pages(spark, single))
    assert len(list((tmp_path / "bundle").rglob("part-*.parquet"))) <= 4
    assert len(list((tmp_path / "single").rglob("part-*.txt"))) == 64


def test_missing_impact_reads_the_lines_once(spark, sf):
    out = decision_queries.missing_raw(spark, sf)
    assert plan(out).count("lineitem.parquet]") == 1
    assert rows(link_queries.impact_list(spark, sf)) == rows(link_queries.impact_list(spark, sf, link_queries.members(spark, sf)))


FEATURE_ROWS = "match_id long, year int, home_win int, market_p double, a double, b double, c double"


def feature_rows():
    rng = random.Random(4)
    odd = (None, float("nan"), float("inf"))
    return [
        (i, 2001 + i % 4, rng.choice((0, 1)), 0.5, rng.choice((rng.random(), 0.25, *odd)), float(rng.randint(0, 3)) if i % 4 else None, rng.gauss(0, 1e6))
        for i in range(600)
    ]


def test_medians_of_many_slices_in_the_same_passes(spark, monkeypatch):
    made = feature_rows()
    passes = []
    monkeypatch.setattr(I, "_counted", lambda *args, found=I._counted: passes.append(1) or found(*args))
    slices = {2002: [2001], 2004: [2001, 2002, 2003], "odd": [2002, 2004], "none": [], "absent": [1999]}
    got = I.sliced_medians(spark.createDataFrame(made, FEATURE_ROWS), ["a", "b", "c"], F.col("year"), slices, bins=8)
    for name, years in slices.items():
        for at, c in ((4, "a"), (5, "b"), (6, "c")):
            values = [r[at] for r in made if r[1] in years and r[at] is not None and abs(r[at]) < float("inf")]
            assert got[name][c] == (statistics.median(values) if values else None), (name, c)
    assert len(passes) < 8  # all slices and columns zoom in together


def test_folds_share_medians_and_read_only_their_seasons(spark, monkeypatch):
    data = B.Dataset.build(spark.createDataFrame(feature_rows(), FEATURE_ROWS), ["a", "b", "c"], "market_p")
    assert data.df.columns == ["match_id", "season", "label", "market", "a", "b", "c", "weight"]
    assert "PartitionFilters: [isnotnull(season" in plan(data.df.filter("season < 2003"))
    calls = []
    monkeypatch.setattr(B, "sliced_medians", lambda *args, found=B.sliced_medians: calls.append(args[1]) or found(*args))
    half = data.only(["a"])
    found = half.medians_before([2002, 2003])
    for s in (2002, 2003):
        assert found[s] == I.exact_medians(data.df.filter(F.col("season") < s), ["a"])
    assert data.medians_before([2002, 2003])[2003] == I.exact_medians(data.df.filter("season < 2003"), ["a", "b", "c"])
    data.only(["b", "c"]).medians_before([2003])
    assert calls == [["a"], ["b", "c"]]


def feed_tables(spark, path):
    """Orders of a known and an unknown customer, one without lines and one twice; lines without a key, part, supplier or quantity."""
    day = datetime.datetime(2001, 2, 3)
    orders = [(1, 1, 10.0, day, "1-URGENT"), (2, 1, 20.0, None, "2-HIGH"), (3, 2, 30.0, day, "3-MEDIUM"), (4, 9, 40.0, day, "1-URGENT"), (5, 1, 50.0, day, "1-URGENT"), (5, 1, 50.0, day, "1-URGENT")]
    lines = [(1, day, 1, 30, 7, 5.0), (1, day, 2, 20, None, 6.0), (1, day, 3, None, 8, None), (3, day, 1, 61, 9, 50.0), (5, day, 1, 41, 7, 1.0), (5, day, 1, 41, 7, 1.0), (None, day, 1, 30, 7, 5.0), (4, day, 1, 30, 7, 5.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(1, 3), (2, None)], "c_custkey long, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_shipdate timestamp_ntz, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return [x for x in orders if x[1] != 9], lines


def test_bookmaker_messages_by_hand(spark, tmp_path):
    orders, lines = feed_tables(spark, str(tmp_path))
    want = []
    for key, cust, _, day, _ in orders:
        home, away = ("Nation 3", f"Nation {(4 + key % 24) % 25}") if cust == 1 else (None, None)

        def outcome(name, price, point):
            return {k: v for k, v in (("name", name), ("price", price), ("point", point)) if v is not None}

        for _, _, _, part, book, q in [x for x in lines if x[0] == key] or [(None,) * 6]:
            h, a = (None, None) if q is None else ((q + 21) / 20, (72 - q) / 20)
            p = None if part is None else (part % 41 - 20) / 2
            markets = [
                {"key": "h2h", "outcomes": [outcome(home, h, None), outcome(away, a, None)]},
                {"key": "spreads", "outcomes": [outcome(home, 1.9, p), outcome(away, 1.9, None if part is None else (20 - part % 41) / 2)]},
            ]
            whole = {"id": str(key), "home_team": home, "away_team": away, "commence_time": day and str(day.date()), "bookmakers": [] if book is None else [{"key": str(book), "markets": markets}]}
            want.append({k: v for k, v in whole.items() if v is not None})
    made = [json.loads(r.body) for r in source_queries.bookmaker_messages(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, made)) == sorted(map(repr, want)) and len(made) == 9


def test_bookmaker_feed_by_hand_with_odd_messages(spark):
    def message(books, **other):
        return json.dumps({"id": "1", "home_team": "H", "away_team": "A", "commence_time": "t", "bookmakers": books} | other)

    def head(h, a):
        return {"key": "h2h", "outcomes": [{"name": "H", "price": h}, {"name": "A", "price": a}, {"name": "Draw", "price": 9.0}]}

    bodies = [
        message([{"key": "x", "markets": [head(2.0, 3.0), {"key": "spreads", "outcomes": [{"name": "H", "point": -1.5}, {"name": "A", "point": 1.5}]}]}, {"key": "y", "markets": [head(4.0, 3.5)]}]),
        message([{"key": "z", "markets": [head(6.0, None), {"key": "totals", "outcomes": [{"name": "H", "price": 7.0, "point": 7.0}]}, {"key": "h2h"}, None]}, None, {"key": "w"}]),
        message([], id="2"), message(None, id="3"), message([{"markets": []}], id="4"), message([], id="2"),
        None, "", "no message", "[]", "{}",
    ]
    out = J.bookmaker_feed(spark.createDataFrame([(b,) for b in bodies], "body string"))
    none = (None, None, None)
    want = {("1", "H", "A", "t"): (4.0, 3.25, -1.5), **{(i, "H", "A", "t"): none for i in ("2", "3", "4")}, (None, None, None, None): none}
    assert {tuple(r)[:4]: tuple(r)[4:] for r in out.select("id", "home_team", "away_team", "commence_time", "h2h_home", "h2h_away", "spread_home").collect()} == want
    assert out.count() == len(want)


def test_bookmaker_messages_are_dealt_by_their_outcomes_and_written_apart_from_parsing(spark, sf, monkeypatch):
    monkeypatch.setattr(A, "ROWS_PER_TASK", 500)
    n = -(-4 * A.table(spark, sf, "lineitem").filter("l_orderkey is not null").count() // 500)
    steps = plan(QUERIES["src06_bookmaker_feed"](spark, sf))
    assert n > 4 and "hashpartitioning(match_id" in steps and f", {n}), REPARTITION_BY_NUM" in steps
    parsing = [line for line in steps.splitlines() if "from_json(" in line]
    assert parsing and not any("StructsToJson" in line for line in parsing)
