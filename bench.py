"""Headline queries, timed end to end: plan, run, and write every output row to the noop sink.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose the data and the threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from duelframe.session import build_session

HEADLINE = [
    "wn01_rolling_form", "wn04_streak", "wn05_head_to_head", "wn09_scoring_consistency", "wn14_lineup_retention",
    "wn16_rolling_process_stats", "wn17_member_form", "wn23_expected_starters", "jn02_nearest_date", "jn03_ladder_lookup",
    "jn13_lineup_changes", "nrm04_orientation_in_feed", "nrm17_median_imputation", "ag04_with_without",
    "ag05_with_without_walk_forward", "ag14_probability_metrics", "rt05_rating_backfill", "rt07_parameter_search",
    "fe03_interactions", "fe16_roster_continuity", "ev01_strategy_backtest", "ml08_blend_weight",
    "ml09_walk_forward_blend", "ml17_feature_table", "snk02_period_upsert", "stm01_price_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    only = sys.argv[1:]
    spark = build_session("bench", cpus)
    from duelframe.plans.catalog import QUERIES

    QUERIES["nrm10_played_decided"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    spent: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
