"""Filling gaps: exact medians fitted on a training slice, coherent price fills, clamps, weights."""

from __future__ import annotations

import math
from collections.abc import Collection, Hashable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

# fixed values: columns whose gap means "no" and is filled with 0 instead of the median
FLAG_COLUMNS = (
    "home_is_back_to_back", "away_is_back_to_back", "home_bye_last_round", "away_bye_last_round",
    "is_finals", "odds_home_favourite", "is_home", "is_neutral_venue",
    "odds_spread_agree", "elo_spread_agree", "attendance_high", "is_night_game", "is_afternoon_game", "is_day_game",
    "is_early_season", "is_mid_season", "is_late_season",
)
# fixed values: price movements that are 0, and neutral fills, when only the closing price is known
NO_MOVEMENT = (
    "odds_movement", "odds_movement_abs", "spread_movement", "spread_movement_abs", "total_movement",
    "total_movement_abs", "odds_home_range", "odds_away_range", "odds_home_range_close", "odds_away_range_close",
)
DRAW_FILL = 0.05
SPREAD_PER_PROB = 26.0
MAX_REST = 14


def exact_medians(df: DataFrame, columns: Sequence[str], bins: int = 1024) -> dict[str, float | None]:
    """Exact medians of many columns without bringing any column's values together.

    See ``sliced_medians``. The narrow projection is kept for the passes (memory, then disk; a lost
    block is recomputed), since ``df`` may be costly to read again.
    """
    numeric = df.select([_known(c).alias(c) for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return sliced_medians(numeric, columns, F.lit(0), {None: [0]}, bins)[None]
    finally:
        numeric.unpersist()


def _known(column: str) -> Column:
    """The value as a double; null for NaN and infinities."""
    value = F.col(column).cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def sliced_medians(
    df: DataFrame, columns: Sequence[str], group: Column, slices: Mapping[Hashable, Collection[int]], bins: int = 1024
) -> dict[Hashable, dict[str, float | None]]:
    """Exact medians of many columns in several slices of the rows, all found in the same passes.

    ``group`` gives each row's group, and a slice is a set of groups; slices may overlap. Each pass
    counts the values of all columns per group in ``bins`` equal parts of the ranges still open (at
    most ``bins`` rows per group, column and range) and zooms into the parts that hold a slice's
    middle. A slice is done when its middle two values are the ends of neighbouring parts or the part
    holds a single value; a range shrinks by ``bins`` per pass. NaN and infinities count as gaps.
    ``df`` is read once per pass.
    """
    groups = sorted({g for members in slices.values() for g in members})
    out: dict[Hashable, dict[str, float | None]] = {k: dict.fromkeys(columns) for k in slices}
    if not groups or not columns:
        return out
    place = {g: i for i, g in enumerate(groups)}
    members = {k: [place[g] for g in sorted(set(v))] for k, v in slices.items()}
    rows = df.select(group.cast("long").alias("group"), *[_known(c).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = rows.filter(F.col("group").isin(groups))
    first = rows.groupBy("group").agg(
        *[F.struct(F.count(f"_{i}"), F.min(f"_{i}"), F.max(f"_{i}")).alias(f"_{i}") for i in range(len(columns))]
    ).collect()  # one row per group
    wanted: dict[tuple[Hashable, int], tuple[tuple[float, float], int, int, int]] = {}
    for i, c in enumerate(columns):
        found = {place[r["group"]]: r[f"_{i}"] for r in first if r[f"_{i}"][0]}
        if not found:
            continue
        whole = min(f[1] for f in found.values()), max(f[2] for f in found.values())
        for k, mine in members.items():
            n = sum(found[g][0] for g in mine if g in found)
            if n:
                wanted[k, i] = whole, 0, (n - 1) // 2, n // 2
    while wanted:
        ranges = sorted({(i, *bounds) for (_, i), (bounds, *_) in wanted.items()})
        counted = _counted(rows, ranges, groups, bins)
        still = {}
        for (k, i), (bounds, below, r1, r2) in wanted.items():
            n, lo, hi = (part[members[k]] for part in counted[i, *bounds])
            n, lo, hi = n.sum(axis=0), lo.min(axis=0), hi.max(axis=0)
            upto = below + np.cumsum(n)
            left, right = (int(np.searchsorted(upto, r, side="right")) for r in (r1, r2))
            if left != right:
                out[k][columns[i]] = float((hi[left] + lo[right]) / 2)
            elif lo[left] == hi[left]:
                out[k][columns[i]] = float(lo[left])
            else:  # the same range for every slice that zooms in here
                _, least, most = counted[i, *bounds]
                zoomed = float(least[:, left].min()), float(most[:, left].max())
                still[k, i] = zoomed, int(upto[left] - n[left]), r1, r2
        wanted = still
    return out


def _counted(rows: DataFrame, ranges: Sequence[tuple[int, float, float]], groups: Sequence[int], bins: int) -> dict:
    """Per range (column, low, high): number, least and greatest value per group and part of the range."""

    def empty() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size = len(groups) * bins
        return [(np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)) for _ in ranges]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = empty()
        for batch in batches:
            at = np.searchsorted(groups, batch.column("group").to_numpy()) * bins
            values = {i: batch.column(f"_{i}").to_numpy(zero_copy_only=False) for i in {r[0] for r in ranges}}
            for (i, low, high), (n, lo, hi) in zip(ranges, held, strict=True):
                inside = (values[i] >= low) & (values[i] <= high)  # gaps are NaN here
                v = values[i][inside]
                part = np.zeros(len(v), np.int64)
                if low < high:
                    part = np.minimum(np.floor((v / 2 - low / 2) / (high / 2 - low / 2) * bins), bins - 1).astype(np.int64)
                key = at[inside] + part
                n += np.bincount(key, minlength=len(n))
                np.minimum.at(lo, key, v)
                np.maximum.at(hi, key, v)
        for j, (n, lo, hi) in enumerate(held):
            key = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"range": np.full(len(key), j), "key": key, "n": n[key], "lo": lo[key], "hi": hi[key]})

    used = rows.select("group", *[f"_{i}" for i in sorted({r[0] for r in ranges})])
    parts = used.mapInArrow(count, "range long, key long, n long, lo double, hi double")
    total = empty()
    for r in parts.groupBy("range", "key").agg(F.sum("n"), F.min("lo"), F.max("hi")).collect():  # at most ``bins`` per group and range
        n, lo, hi = total[r[0]]
        n[r[1]], lo[r[1]], hi[r[1]] = r[2], r[3], r[4]
    shape = len(groups), bins
    return {r: tuple(part.reshape(shape) for part in found) for r, found in zip(ranges, total, strict=True)}


def fill_with(df: DataFrame, medians: Mapping[str, float | None], flags: Sequence[str] = FLAG_COLUMNS) -> DataFrame:
    """Fill gaps with the fitted medians (0 for flags and for columns without any value)."""
    fills = {c: 0.0 if c in flags or m is None or math.isnan(m) else float(m) for c, m in medians.items()}
    return df.withColumns({c: F.coalesce(_known(c), F.lit(v)) for c, v in fills.items() if c in df.columns})


def clamp_openers(df: DataFrame, max_rest: int = MAX_REST) -> DataFrame:
    """Season openers: rest capped, off-season is no bye, line-up stability unknown in round 1."""
    first = F.coalesce(F.col("round_number") == 1, F.lit(False))
    out: dict[str, Column] = {}
    for side in ("home", "away"):
        rest, bye, kept = f"{side}_days_rest", f"{side}_bye_last_round", f"{side}_lineup_stability"
        if rest in df.columns:
            out[rest] = F.when(F.col(rest).isNotNull(), F.least(F.col(rest), F.lit(max_rest)))
        if bye in df.columns:
            out[bye] = F.when(first, F.lit(0)).otherwise(F.col(bye))
        if kept in df.columns:
            out[kept] = F.when(~first, F.col(kept))
    df = df.withColumns(out)
    if {"rest_diff", "home_days_rest", "away_days_rest"} <= set(df.columns):
        df = df.withColumn("rest_diff", F.col("home_days_rest") - F.col("away_days_rest"))
    if "lineup_stability_diff" in df.columns:
        df = df.withColumn("lineup_stability_diff", F.when(~first, F.col("lineup_stability_diff")))
    return df


def coherent_prices(df: DataFrame) -> DataFrame:
    """Fill price features from the closing price so that they tell one story."""
    fills: dict[str, Column] = {
        "odds_home_open_prob": F.col("odds_home_prob"),
        "odds_away_open_prob": F.col("odds_away_prob"),
        "spread_home_open": (F.col("odds_home_prob") - 0.5) * -SPREAD_PER_PROB,
        "spread_home_close": (F.col("odds_home_prob") - 0.5) * -SPREAD_PER_PROB,
        "bookmakers_surveyed": F.lit(1),
        "implied_draw_prob": F.lit(DRAW_FILL),
        "draw_competitiveness": F.lit(DRAW_FILL),
    } | {c: F.lit(0.0) for c in NO_MOVEMENT}
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in fills.items() if c in df.columns})


def backfill_close(odds: DataFrame) -> DataFrame:
    """Closing price from the opening one where it is absent, and a mark on such rows."""
    pairs = [(f"{p}_close", f"{p}_open") for p in ("h2h_home", "h2h_away", "line_home", "total_line")]
    estimated = F.lit(False)
    for close, opened in pairs:
        estimated = estimated | (F.col(close).isNull() & F.col(opened).isNotNull())
    return odds.withColumn("close_estimated", estimated).withColumns(
        {close: F.coalesce(close, opened) for close, opened in pairs}
    )


def mirror(df: DataFrame, source: str, targets: Sequence[str]) -> DataFrame:
    """Copy a column into others that are missing or empty."""
    return df.withColumns(
        {t: F.coalesce(F.col(t), F.col(source)) if t in df.columns else F.col(source) for t in targets}
    )


def recency_weight(df: DataFrame, decay: float = 0.92, year: str = "year") -> DataFrame:
    """``decay`` to the power of the row's age in seasons; the newest season is a scalar subquery."""
    newest = df.agg(F.max(year).alias("y")).select("y").scalar()
    return df.withColumn("weight", F.pow(F.lit(decay), newest - F.col(year)))
