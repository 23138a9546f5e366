"""A sample of registered queries against their SQL on the smallest tables (the tool checks all)."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check_queries import compare, connect

from duelframe.plans.catalog import QUERIES, SQL

SAMPLE = [
    "wn01_rolling_form", "wn04_streak", "wn05_head_to_head", "wn14_lineup_retention", "jn02_nearest_date", "jn09_either_orientation",
    "nrm04_orientation_in_feed", "nrm17_median_imputation", "ag04_with_without", "ag14_probability_metrics", "rt05_rating_backfill",
    "fe03_interactions", "dec03_decision_rule", "ev01_strategy_backtest", "ml09_walk_forward_blend", "src06_bookmaker_feed",
    "snk02_period_upsert", "stm03_rating_stream",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, sf, name):
    note, _, good = compare(spark, con, name, sf, QUERIES[name], SQL[name])
    assert good, note


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
