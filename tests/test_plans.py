"""Plan shapes: no products, pruned scans, one exchange per window key, Python only where declared."""

import re

import pytest

from duelframe.operators import windows as W
from duelframe.operators.history import measure
from duelframe.plans.catalog import QUERIES, SQL
from duelframe.plans.common import log
from duelframe.sources import adapters as A

# fits and streams run jobs while they are built; their plans are those of the queries they read
EAGER = ("ml", "stm", "src", "snk", "ev02")
PYTHON = {"rt03_season_regression", "rt04_rating_update", "rt05_rating_backfill", "rt06_rating_history", "rt07_parameter_search", "rt08_expected_log", "rt09_best_parameters", "ml17_feature_table"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(EAGER)])
def test_no_products_and_no_stray_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert name in PYTHON or "Python" not in text and "Pandas" not in text and "InArrow" not in text


def test_all_form_windows_share_one_exchange(spark, sf):
    df = log(spark, sf)
    layout = measure(df, ["entity_id"])
    out = W.streak(W.schedule(W.scoring_consistency(W.rolling_form(df, layout), layout), layout), layout)
    text = plan(out)
    assert len(re.findall(r"Exchange hashpartitioning\(entity_id", text)) == 1
    assert "SinglePartition" not in text


def test_scans_are_pruned(spark, sf):
    text = plan(A.matches(spark, sf).select("match_id", "home_id"))
    assert "o_orderstatus" not in text.split("ReadSchema")[1].split("\n")[0]
    text = plan(QUERIES["src01_parquet_scan"](spark, sf))
    assert "EqualTo(o_orderstatus,F)" in text


def test_every_check_has_a_query():
    assert not set(SQL) - set(QUERIES)
