"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import join_queries, pipeline_queries, scalar_queries, window_queries
from .registry import ORACLES, QUERIES

__all__ = ["join_queries", "oracle_sql", "pipeline_queries", "queries", "scalar_queries", "window_queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
