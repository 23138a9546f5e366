"""Findings of round 04: what steps and fits leave on disk."""

import time
from pathlib import Path

from conftest import same
from pyspark.sql import functions as F

from duelframe.operators.history import DEFAULT_MAX_ROWS, MAX_ROWS_CONF
from duelframe.plans import backtest as B, model_queries as M
from duelframe.session import FREED, in_steps, shared_folder


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def laid_out(spark):
    return {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("laid-out-*")}


def test_a_step_leaves_no_shuffle_files_and_no_table(spark):
    before, there, setting = shuffle_files(spark), laid_out(spark), spark.conf.get(FREED)
    given = spark.range(50_000).withColumn("k", F.xxhash64("id") % 999).groupBy("k").agg(F.sum("id").alias("n"))
    with in_steps(spark) as step:
        table = step(given)
        assert len(laid_out(spark) - there) == 1
        for _ in range(50):
            if not shuffle_files(spark) - before:
                break
            time.sleep(0.2)
        assert not shuffle_files(spark) - before
        same(table, given)
    assert laid_out(spark) <= there and spark.conf.get(FREED) == setting


def test_the_model_table_is_the_same_from_cut_histories(spark, sf):
    there, out = laid_out(spark), []
    try:
        for most in (DEFAULT_MAX_ROWS, 40):
            spark.conf.set(MAX_ROWS_CONF, str(most))
            out.append(M.dataset(spark, sf, drop_undecided=False))
    finally:
        spark.conf.unset(MAX_ROWS_CONF)
    same(out[0].df, out[1].df)
    assert len(laid_out(spark) - there) == 2 and out[0].sizes == out[1].sizes
    assert list(out[0].sizes) == out[0].seasons and sum(out[0].sizes.values()) == out[0].df.count()


def test_fits_run_beside_each_other_while_their_rows_have_room(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS_PER_CORE", 25)
    most, now, seen = 25 * spark.sparkContext.defaultParallelism, [], []

    def work(rows):
        now.append(rows)
        seen.append(list(now))
        time.sleep(0.1)
        now.remove(rows)
        return -rows

    jobs = [30, 31, 32, 60, 500, 33, 34, 501]
    assert B._concurrently(work, jobs, spark, lambda rows: rows) == [-rows for rows in jobs]
    assert all(sum(held) <= most or len(held) == 1 for held in seen) and any(len(held) > 1 for held in seen)
