"""Joining a group-level table back to rows when one group may hold a large share of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``table`` (one row per key) to ``rows``.

    Spark broadcasts the table as long as its size in bytes allows (``spark.sql.autoBroadcastJoinThreshold``, also when
    the size is only known at run time); beyond that it splits the join's skewed partitions.
    """
    return rows.join(table, list(keys), how)
