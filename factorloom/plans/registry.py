"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorloom.functions.columns import rounded
from factorloom.sources.derived import Panels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(panels) -> DataFrame``; floating columns are rounded to 8 digits."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: rounded(fn(Panels(spark, folder)))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap
