"""Importing this module registers every query."""

from duelframe.plans import (  # noqa: F401
    aggregate_queries,
    decision_queries,
    feature_queries,
    link_queries,
    model_queries,
    scalar_queries,
    source_queries,
    stream_queries,
    table_queries,
    windows_queries,
)
from duelframe.plans import blend_queries  # noqa: F401  # its SQL builds on the views of the others
from duelframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
