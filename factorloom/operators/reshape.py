"""Union, set difference, keep-last and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by an explicit order; reduced map-side, so a hot key does not gather its rows."""
    rest = [n for n in df.columns if n not in keys]
    newest = F.max(F.struct(*order, *[F.col(n).alias(f"_{n}") for n in rest if n not in order])).alias("_row")
    picked = df.groupBy(*keys).agg(newest)
    return picked.select(*keys, *[F.col(f"_row.{n}" if n in order else f"_row._{n}").alias(n) for n in rest])


def widen(df: DataFrame, rows: str, axis: str, value: str, names: Sequence[str], order: str | None = None) -> DataFrame:
    """Long to wide over a stated list of names; the last value by ``order`` wins."""
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))) if order else F.max(value)
    return df.groupBy(rows).pivot(axis, list(names)).agg(last)


def lengthen(df: DataFrame, keys: Sequence[str], names: Sequence[str], axis: str, value: str, drop_null: bool = False) -> DataFrame:
    long = df.unpivot(list(keys), list(names), axis, value)
    return long.where(F.col(value).isNotNull()) if drop_null else long


def missing_names(requested: Sequence[str], available: DataFrame, column: str) -> DataFrame:
    """Requested names that never occur in ``available``."""
    wanted = available.sparkSession.createDataFrame([(n,) for n in requested], f"{column} string")
    return wanted.join(available.select(column).distinct(), column, "left_anti")
