"""The table of registered queries: a Spark function and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duelframe.plans.views_sql import check_sql
from duelframe.schema import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, r6: str = "", places: int = 6):
    """Register a query; ``sql`` is the body of its check, ``r6`` its rounded columns."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf), places)
        if sql is not None:
            SQL[name] = check_sql(sql, r6, places)
        return fn

    return keep
