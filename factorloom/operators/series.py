"""Per-symbol and per-series windows.

Panels are unique on (d, symbol) with a DATE d, so a symbol's window holds at most one row per
calendar date however many rows the panel has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def at_offset(value: str | Column, k: int, by: Sequence[str] = ("symbol",), order: str = "idx") -> Column:
    """Value exactly ``k`` sessions on (k < 0: back); null if the symbol has no row there."""
    value = F.col(value) if isinstance(value, str) else value
    return F.max(value).over(Window.partitionBy(*by).orderBy(order).rangeBetween(k, k))


def forward_return(horizon: int, price: str = "price") -> Column:
    """Bought one session after the signal, held ``horizon`` sessions."""
    return F.try_divide(at_offset(price, horizon + 1), at_offset(price, 1)) - 1


def change(k: int, price: str = "price") -> Column:
    """k-session change; null where the earlier price is missing or zero."""
    return F.try_divide(F.col(price), at_offset(price, -k)) - 1


def running(by: Sequence[str], order: str | Sequence[str]) -> Window:
    keys = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)


def compounded(ret: Column, window: Window) -> Column:
    """Running product of 1 + r; exact in sign and at zero, where the sum of logs is undefined."""
    gross = 1 + F.coalesce(ret, F.lit(0.0))
    dead = F.max(F.when(gross == 0, 1).otherwise(0)).over(window)
    negative = F.sum(F.when(gross < 0, 1).otherwise(0)).over(window)
    size = F.exp(F.sum(F.when(gross == 0, 0.0).otherwise(F.log(F.abs(gross)))).over(window))
    return F.when(dead == 1, 0.0).when(negative % 2 == 1, -size).otherwise(size)


def product_of(ret: Column) -> Column:
    """Aggregate form of ``compounded``: product of 1 + r over a group, null on an empty group."""
    gross = 1 + ret
    size = F.exp(F.sum(F.when(gross == 0, 0.0).otherwise(F.log(F.abs(gross)))))
    negative = F.sum(F.when(gross < 0, 1).otherwise(0))
    dead = F.max(F.when(gross == 0, 1).otherwise(0))
    return F.when(dead == 1, 0.0).when(negative % 2 == 1, -size).otherwise(size)


def drawdown(nav: Column, window: Window) -> Column:
    return nav / F.max(nav).over(window) - 1


def carried(value: str, by: Sequence[str] = ("symbol",), order: str | Sequence[str] = "d") -> Column:
    """Last known value up to the row."""
    return F.last(value, ignorenulls=True).over(running(by, order))


def filled_on(series: DataFrame, calendar: DataFrame, value: str, date: str = "d") -> DataFrame:
    """A single series carried forward onto calendar dates; dates before its start stay null."""
    marks = (calendar.select(date, F.lit(True).alias("wanted"))
             .join(series.select(date, value), date, "full"))
    filled = marks.withColumn(value, F.last(value, ignorenulls=True).over(
        Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)))
    return filled.where("wanted").select(date, value)


def last_known_many(by_symbol: DataFrame, wanted: DataFrame, value: str, symbol: str = "symbol", date: str = "d"
                    ) -> DataFrame:
    """As-of per symbol: for each wanted (d, symbol) the last non-null value at or before d."""
    marks = by_symbol.select(date, symbol, value, F.lit(0).alias("_kind")).unionByName(
        wanted.select(date, symbol).withColumns({value: F.lit(None).cast(by_symbol.schema[value].dataType),
                                                 "_kind": F.lit(1)}))
    return (marks.withColumn(value, carried(value, (symbol,), (date, "_kind")))
            .where("_kind = 1").select(date, symbol, value))
