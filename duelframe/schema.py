"""Declared schemas, typed optional columns and the NULL-for-missing rule."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MATCHES = (
    "match_id long, event_date date, year int, round int, round_label string, home_id int, away_id int, "
    "home_score int, away_score int, venue_id int, referee string, attendance int, league int"
)
LADDERS = (
    "year int, round int, entity_id int, position int, played long, won long, lost long, drawn long, "
    "points_for long, points_against long, points_diff long, competition_points long"
)
UPCOMING = "home_team string, away_team string, venue string, date date, odds_home double, odds_away double"
DECISION_LOG = (
    "season int, round int, match_id long, category string, tip string, home_score int, away_score int, "
    "tip_correct int, model_correct int, fav_correct int, model_agreed_odds int"
)


def as_struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], as_struct(ddl))


def ensure_columns(df: DataFrame, optional: Mapping[str, str]) -> DataFrame:
    """Add every absent optional column as a typed NULL, so later operators need no guards."""
    absent = {c: F.lit(None).cast(t) for c, t in optional.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"required columns are missing: {absent}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is not a value here: averages skip NULL but would propagate NaN."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def align_to(df: DataFrame, target: T.StructType) -> DataFrame:
    """Cast a new batch to an existing table's column types and order (absent columns become NULL)."""
    present = set(df.columns)
    return df.select(
        [
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target
        ]
    )


def flat_columns(df: DataFrame) -> DataFrame:
    """Keep the columns a flat file can hold, decided from the declared types."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select([f.name for f in df.schema if not isinstance(f.dataType, nested)])


def numeric(col: str | Column) -> Column:
    """Lenient number: text that is not a number becomes NULL instead of raising under ANSI."""
    col = F.col(col) if isinstance(col, str) else col
    return col.cast("string").try_cast("double")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round double columns for reports, halves away from zero, with arithmetic that stays in codegen
    (``round`` on doubles goes through decimals). A negative zero becomes zero."""
    unit = f"1e{places}D"

    def shortened(c: str) -> str:
        size = f"cast(floor(abs(`{c}`) * {unit} + 0.5D) AS double) / {unit}"
        return f"CASE WHEN `{c}` < 0 THEN 0D - {size} ELSE {size} END AS `{c}`"

    return df.selectExpr(
        *[shortened(f.name) if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`" for f in df.schema]
    )
