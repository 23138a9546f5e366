"""Structured Streaming forms of the price refresh, the period upsert and the rating update."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack
from heapq import merge
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duelframe.operators.ratings import RatingParams, _Chain
from duelframe.operators.sinks import replace_periods
from duelframe.session import cut_lineage

# the stateful update travels with its code, so workers need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Landed Parquet files of one table, a file or a folder of part files, as a stream.

    A trigger takes all that has landed. Files land in no order of event time, and a cap on files
    would make what is late, and so the result, depend on it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that has landed, then stop; the checkpoint makes a restart continue."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return query


def price_windows(quotes: DataFrame, at: str, key: str, late: str = "2 days", width: str = "30 minutes") -> DataFrame:
    """Price consensus per match and tumbling window; a window is emitted once it can no longer change."""
    return (
        quotes.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("w"), key)
        .agg(F.sum("home_ticks").alias("home_ticks"), F.sum("away_ticks").alias("away_ticks"), F.count(F.lit(1)).alias("quotes"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key,
            (F.col("home_ticks") / (F.col("quotes") * F.lit(20.0))).alias("mean_home"),
            (F.col("away_ticks") / (F.col("quotes") * F.lit(20.0))).alias("mean_away"), "quotes",
        )
    )


def redecide(windows: DataFrame, decisions: DataFrame, threshold: float = 0.60, model_weight: float = 0.25) -> DataFrame:
    """Stream-static join: blend close calls anew with each fresh consensus.

    A trigger without new files has an empty input, and yet all windows that the watermark has closed since.
    Spark takes them for as small as that input and would send them to every executor: the join is a merge.
    """
    market = F.col("mean_away") / (F.col("mean_home") + F.col("mean_away"))
    new = model_weight * F.col("model_prob") + (1 - model_weight) * market
    close = decisions.filter(F.abs(F.col("old_prob") - 0.5) * 2 <= round((threshold - 0.5) * 2, 12))
    return windows.hint("merge").join(close, "match_id").select(
        "match_id", "window_start", "window_end", "quotes", "old_prob", new.alias("new_prob"),
        ((new >= 0.5) != (F.col("old_prob") >= 0.5)).alias("is_flip"),
    )


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], by: Sequence[str] = ("year", "round")) -> StreamingQuery:
    """Replace rows by key; a batch replayed after a failure changes nothing.

    Only the periods that a batch touches are read and rewritten. A key is expected to stay in its
    period; a batch may hold any part of a period, and the rest of it stays.
    """

    def apply(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut_lineage(batch)
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            table = spark.read.schema(batch.schema).parquet(path)
            touched = table.join(batch.select(*by).distinct(), list(by), "left_semi")
            batch = cut_lineage(touched.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch))
        replace_periods(batch, path, by)

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


STREAM_RATED = "league int, match_id long, home_elo double, away_elo double, home_elo_prob double"
RATING_STATE = "ratings map<int, double>, season int"


#: Games of a league that are sorted in memory, those read back at once, and those played and passed on at once.
RUN, BLOCK, PLAYED = 500_000, 2_000, 10_000


def _packed(games: pd.DataFrame) -> np.ndarray:
    """Day, match, season, sides, whether both scores are known, and scores, as one row of integers a game."""
    scores = games[["home_score", "away_score"]]
    day = games["event_date"].astype(object).where(games["event_date"].notna(), None).to_numpy().astype("datetime64[D]")
    columns = [
        np.where(np.isnat(day), np.iinfo(np.int64).max, day.astype("int64")),  # no day comes last
        *(games[c].astype("int64") for c in ("match_id", "year", "home_id", "away_id")),
        scores.notna().all(axis=1),
        *(scores[c].fillna(0).astype("int64") for c in scores),
    ]
    return np.column_stack([np.asarray(c, np.int64) for c in columns])


def _in_order(chunks: Iterator[pd.DataFrame]) -> Iterator[list[int]]:
    """Packed games by day and match: runs sorted in memory; several runs go to temporary files and are merged."""
    with ExitStack() as files:
        runs, parts, held = [], [], 0

        def run() -> np.ndarray:
            rows = np.concatenate(parts)
            parts.clear()
            return rows[np.lexsort((rows[:, 1], rows[:, 0]))]

        def kept(rows: np.ndarray):
            file = files.enter_context(tempfile.TemporaryFile())
            rows.tofile(file)
            return file

        def read(file) -> Iterator[list[int]]:
            file.seek(0)
            while data := file.read(BLOCK * 64):
                yield from np.frombuffer(data, np.int64).reshape(-1, 8).tolist()

        for chunk in chunks:
            parts.append(_packed(chunk))
            held += len(chunk)
            if held >= RUN:
                runs.append(kept(run()))
                held = 0
        last = run() if parts else np.empty((0, 8), np.int64)
        ends = (row for i in range(0, len(last), BLOCK) for row in last[i : i + BLOCK].tolist())
        yield from merge(*map(read, runs), ends, key=lambda row: row[:2]) if runs else ends


def rating_update(params: RatingParams) -> Callable:
    """Stateful update of one league: the state is one number per participant and the season.

    A micro-batch is put in match order before it is applied. A task holds a run of games and some results,
    however many games of a league a trigger takes.
    """

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain = _Chain(params)
        if state.exists:
            ratings, season = state.get
            chain.rating, chain.season = dict(ratings), season
        games = _in_order(chunks)
        while part := list(islice(games, PLAYED)):
            made = []
            for _, match, year, home_id, away_id, scored, hs, aw in part:
                home, away, prob, *_ = chain.play(year, home_id, away_id, *((hs, aw) if scored else (None, None)))
                made.append((key[0], match, home, away, prob))
            yield pd.DataFrame(made, columns=["league", "match_id", "home_elo", "away_elo", "home_elo_prob"])
        state.update(({int(k): float(v) for k, v in chain.rating.items()}, chain.season))

    return update


def rating_stream(matches: DataFrame, params: RatingParams = RatingParams()) -> DataFrame:
    """Pre-match ratings as results arrive, keyed by league."""
    narrow = matches.select("league", "event_date", "match_id", "year", "home_id", "away_id", "home_score", "away_score")
    return narrow.groupBy("league").applyInPandasWithState(
        rating_update(params), STREAM_RATED, RATING_STATE, "append", GroupStateTimeout.NoTimeout
    )


def first_arrivals(stream: DataFrame, at: str, keys: Sequence[str], late: str) -> DataFrame:
    """One row per key within the watermark; unlike the batch form it keeps the first arrival."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def starting_soon_stream(stream: DataFrame, starts: str, now: Column, from_minutes: int = 30, to_minutes: int = 90) -> DataFrame:
    """Events that start in the coming window; pass ``current_timestamp()`` as ``now`` when live."""
    from duelframe.operators.decisions import starting_soon

    return starting_soon(stream, starts, now, from_minutes, to_minutes)
