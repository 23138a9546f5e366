"""Landed tables: Parquet and CSV with declared schemas, optional files, season caches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelframe.functions.numbers import reciprocal
from duelframe.schema import as_struct, empty, nan_to_null, numeric, require_columns

TRUE_WORDS = ("Y", "YES", "1", "TRUE")  # fixed values: spellings of a set flag


def scan(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """Parquet table with a declared schema; missing numbers become NULL."""
    reader = spark.read.schema(as_struct(ddl)) if ddl else spark.read
    return nan_to_null(reader.parquet(path))


def optional_scan(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table, or an empty one with the same schema when it has not been landed."""
    try:
        return scan(spark, path, ddl)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, ddl)


def optional_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A log kept as CSV, empty with its schema when absent."""
    try:
        return spark.read.option("header", True).schema(as_struct(ddl)).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, ddl)


def upcoming(spark: SparkSession, path: str, ddl: str, constants: Mapping[str, object], renames: Mapping[str, str]) -> DataFrame:
    """Fixture list with its required columns checked, constants added and odds renamed."""
    names = spark.read.option("header", True).csv(path).columns
    df = require_columns(spark.read.option("header", True).schema(as_struct(ddl)).csv(path), names)
    wanted = as_struct(ddl).names
    if missing := [c for c in wanted if c not in names]:
        raise ValueError(f"required columns are missing: {missing}")
    return df.withColumns({k: F.lit(v) for k, v in constants.items()}).withColumnsRenamed(dict(renames))


def set_flag(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.upper(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def odds_sheet(raw: DataFrame) -> DataFrame:
    """Typed odds from an all-text sheet: day-first dates, Y/N flags, nullable scores, implied
    probabilities and the winner flag."""
    prices = [c for c in raw.columns if c.startswith(("h2h_", "line_", "total_"))]
    scores = {c: numeric(c).cast("int") for c in ("home_score", "away_score")}
    df = raw.withColumns(
        {
            "date": F.try_to_timestamp("date", F.lit("d/M/yyyy")).cast("date"),
            "is_playoff": set_flag("is_playoff"),
            "is_overtime": set_flag("is_overtime"),
            **scores,
            **{c: numeric(c) for c in prices},
        }
    )
    return df.withColumns(
        {f"implied_prob_{s}": reciprocal(f"h2h_{s}") for s in ("home", "away", "draw") if f"h2h_{s}" in df.columns}
        | {"home_win": (F.col("home_score") > F.col("away_score")).cast("int")}
    )


def season_caches(spark: SparkSession, pattern: str, ddl: str) -> DataFrame:
    """Union of per-season JSON cache files in one scan."""
    return spark.read.schema(as_struct(ddl)).json(pattern)
