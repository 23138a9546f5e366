"""Tables that land as many files, in no order and while a session runs."""

import math
import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import same

from duelframe.operators.imputation import exact_medians
from duelframe.plans.catalog import QUERIES
from duelframe.session import build_session
from duelframe.sources import adapters as A
from duelframe.streaming import jobs as Z


@pytest.fixture(scope="module")
def parted(tmp_path_factory, sf):
    """The tables of ``sf``; orders, line items and events as 24 files each, rows shuffled."""
    folder = tmp_path_factory.mktemp("parted")
    draw = random.Random(1)
    for file in Path(sf).glob("*.parquet"):
        table = pq.read_table(file)
        if file.stem in ("orders", "lineitem", "events"):
            table = table.take(pa.array(draw.sample(range(table.num_rows), table.num_rows)))
            (folder / file.name).mkdir()
            step = math.ceil(table.num_rows / 24)
            for k in range(24):
                pq.write_table(table.slice(k * step, step), folder / file.name / f"part-{draw.random()}.parquet")
        else:
            pq.write_table(table, folder / file.name)
    return str(folder)


@pytest.mark.parametrize("name", ["stm01_price_windows", "stm02_upsert_stream", "stm03_rating_stream", "stm04_first_arrivals", "stm05_starting_soon"])
def test_streams_over_folders_equal_single_files(spark, sf, parted, name):
    same(QUERIES[name](spark, parted), QUERIES[name](spark, sf))


def test_upsert_keeps_rows_of_earlier_triggers(spark, parted, tmp_path):
    table = A.table(spark, parted, "orders")
    rows = table.selectExpr("o_orderkey AS k", "year(o_orderdate) AS year", "o_orderstatus AS state")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 5).parquet(f"{parted}/orders.parquet")
    stream = stream.selectExpr("o_orderkey AS k", "year(o_orderdate) AS year", "o_orderstatus AS state")
    out = str(tmp_path / "out")
    for run in range(2):  # the second run replays everything
        Z.upsert_stream(stream, out, str(tmp_path / f"checkpoint-{run}"), ["k"], ["year"])
        same(spark.read.parquet(out), rows)


def test_views_see_files_that_land_later(spark, sf, tmp_path):
    for name in ("orders", "customer"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = A.matches(spark, str(tmp_path)).count()
    spark.read.parquet(f"{sf}/orders.parquet").write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert A.matches(spark, str(tmp_path)).count() == 2 * before


def test_medians_skip_nan_and_infinities(spark):
    rows = [(1.0, float("nan"), None), (2.0, 5.0, None), (float("nan"), float("inf"), None), (9.0, 7.0, float("nan")), (None, float("-inf"), None)]
    assert exact_medians(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]) == {"a": 2.0, "b": 6.0, "c": None}
    wide = [(-1.7e308,), (1.7e308,), (3.0,)]
    assert exact_medians(spark.createDataFrame(wide, "a double"), ["a"]) == {"a": 3.0}


def test_a_running_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    again = build_session("other", 2)
    assert again.sparkContext.master == spark.sparkContext.master and again.conf.get("spark.sql.shuffle.partitions") == before


def test_digests_see_values_and_how_often_rows_repeat(spark):
    from duelframe.operators.sinks import season_digests, stale_seasons

    schema = "year int, a int, b string"
    one = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (1, 2, None), (2, 5, "y")], schema)
    assert stale_seasons(season_digests(one, ["a", "b"]), season_digests(one.orderBy("b").repartition(3), ["a", "b"])).count() == 0
    other = spark.createDataFrame([(1, 2, None), (1, 2, None), (1, 2, None), (2, 5, "y")], schema)  # an exclusive or would not tell
    assert [r.year for r in stale_seasons(season_digests(one, ["a", "b"]), season_digests(other, ["a", "b"])).collect()] == [1]


class _State:
    """What Spark gives a stateful update of one key."""

    def __init__(self):
        self.get, self.exists = None, False

    def update(self, value):
        self.get, self.exists = value, True


def test_a_task_holds_a_run_of_a_league_s_games(monkeypatch):
    import datetime
    import tracemalloc

    import numpy as np
    import pandas as pd

    from duelframe.operators.ratings import RatingParams, _Chain

    def games(n, seed):
        draw = np.random.default_rng(seed)
        day = [datetime.date(2001, 1, 1) + datetime.timedelta(days=int(d)) for d in draw.integers(0, 700, n)]
        score = [pd.Series(np.where(draw.random(n) < 0.1, np.nan, draw.integers(0, 40, n))) for _ in range(2)]
        home = draw.integers(0, 20, n).astype(np.int32)
        return pd.DataFrame({
            "league": np.int32(3), "event_date": pd.Series(day, dtype=object), "match_id": draw.permutation(n) + seed * n, "year": np.array([d.year for d in day], np.int32),
            "home_id": home, "away_id": ((home + 1) % 20).astype(np.int32), "home_score": score[0], "away_score": score[1],
        })

    monkeypatch.setattr(Z, "RUN", 500, raising=False)
    state, update = _State(), Z.rating_update(RatingParams())
    chain = _Chain(RatingParams())
    for triggers in ([games(500, 1), games(700, 2)], [games(600, 3)]):
        table = pd.concat(triggers).sort_values(["event_date", "match_id"])
        want = [
            (3, g.match_id, *chain.play(g.year, g.home_id, g.away_id, *(None if math.isnan(x) else int(x) for x in (g.home_score, g.away_score)))[:3])
            for g in table.itertuples()
        ]
        assert [tuple(r) for part in update((3,), iter(triggers), state) for r in part.itertuples(index=False)] == want
    assert state.get == (chain.rating, chain.season)

    monkeypatch.setattr(Z, "RUN", 50_000, raising=False)
    chunk = games(10_000, 4)
    tracemalloc.start()
    made = sum(len(part) for part in update((3,), (chunk.copy(deep=True) for _ in range(30)), _State()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 300_000 and most < 30_000_000  # 106 MB when all frames and results were held
