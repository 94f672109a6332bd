"""Session calendars, as-of date maps, rebalance flags, walk-forward splits.

Everything here is keyed by a DATE column. The date type holds at most 3.65 million values, so a
calendar has a size bound that does not depend on the data, and may be numbered by one window or
broadcast. ``calendar_broadcast`` refuses the hint for any other type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType

from factorloom.functions.columns import CALENDAR_DAYS, TRADING_DAYS, period_key
from factorloom.session import materialise


def calendar_broadcast(df: DataFrame, date: str = "d") -> DataFrame:
    """Broadcast a table with one row per date; other key types keep Spark's own choice."""
    return F.broadcast(df) if isinstance(df.schema[date].dataType, DateType) else df


def sessions(prices: DataFrame, date: str = "d") -> DataFrame:
    """(d, idx): distinct dates numbered from 1.

    Written once: a calendar feeds many joins, and reading the dates again for each would scan the prices again.
    """
    return materialise(prices.select(F.col(date).alias("d")).distinct().withColumn(
        "idx", F.row_number().over(Window.orderBy("d"))))


def session_before(dates: DataFrame, calendar: DataFrame, name: str = "pos") -> DataFrame:
    """(d, pos): number of sessions at or before each date; 0 if there is none.

    The latest session is number ``pos``, the first later one is ``pos + 1``.
    """
    marks = (calendar.select("d", "idx", F.lit(0).alias("kind"))
             .unionByName(dates.select("d").distinct().select("d", F.lit(None).cast("int").alias("idx"),
                                                               F.lit(1).alias("kind"))))
    upto = Window.orderBy("d", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (marks.withColumn(name, F.coalesce(F.max("idx").over(upto), F.lit(0)))
            .where("kind = 1").select("d", name))


def with_index(df: DataFrame, calendar: DataFrame, date: str = "d") -> DataFrame:
    """Attach the session number of a date that is itself a session."""
    cal = calendar.withColumnRenamed("d", date)
    return df.join(calendar_broadcast(cal, date), date)


def holding_dates(signal_dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """(d, entry_idx, exit_idx, label_entry_date, label_exit_date) per signal date.

    Entry is the first session after the signal, exit the first after the next signal; both are
    null if either is missing, so the last signal is never labelled.
    """
    mapped = session_before(signal_dates, calendar)
    spans = mapped.select("d", (F.col("pos") + 1).alias("_in"), (F.lead("pos").over(Window.orderBy("d")) + 1).alias("exit_idx"))
    entry = calendar.select(F.col("idx").alias("_in"), F.col("d").alias("_entry"))
    exit_ = calendar.select(F.col("idx").alias("exit_idx"), F.col("d").alias("label_exit_date"))
    ok = F.col("label_exit_date").isNotNull()  # a known exit implies a known entry
    return (
        spans.join(entry, "_in", "left").join(exit_, "exit_idx", "left")
        .select("d", F.when(ok, F.col("_in")).alias("entry_idx"), F.when(ok, F.col("exit_idx")).alias("exit_idx"),
                F.when(ok, F.col("_entry")).alias("label_entry_date"), "label_exit_date"))


def changed_sessions(prices: DataFrame, date: str = "d", symbol: str = "symbol", price: str = "price") -> DataFrame:
    """Dates whose cross-section differs from the previous date's (missing equals missing)."""
    cal = sessions(prices, date)
    rows = with_index(prices.select(date, symbol, price), cal, date).where(F.col(price).isNotNull())
    now = rows.select("idx", symbol, F.col(price).alias("now"))
    before = rows.select((F.col("idx") + 1).alias("idx"), symbol, F.col(price).alias("before"))
    moved = (now.join(before, ["idx", symbol], "full")
             .groupBy("idx").agg(F.max(~F.col("now").eqNullSafe(F.col("before"))).alias("moved")))
    return (cal.join(moved, "idx", "left").where((F.col("idx") == 1) | F.coalesce("moved", F.lit(False)))
            .select("d"))


def rebalance_flags(calendar: DataFrame, frequency: str, date: str = "d") -> DataFrame:
    """(d, idx, rebalance): the first tradable session (idx 2) always rebalances; session 1 never does."""
    order = Window.orderBy(date)
    key = period_key(F.col(date), frequency)
    if frequency == "daily":
        due = F.lit(True)
    elif frequency == "alternate":
        due = F.col("idx") % 2 == 0
    else:
        due = (F.col("idx") == 2) | (key != F.lag(key).over(order))
    return calendar.withColumn("rebalance", F.when(F.col("idx") == 1, False).otherwise(due))


def refit_periods(calendar: DataFrame, frequency: str, start: str, end: str) -> DataFrame:
    """(name, train_cutoff, prediction_start, prediction_end) per refit period; cutoff is the last date before."""
    inside = F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    order = Window.orderBy("d")
    marked = calendar.select("d", F.lag("d").over(order).alias("prior")).where(inside)
    key: Column
    if frequency == "alternate":
        key = F.floor((F.row_number().over(order) - 1) / 2)
    else:
        key = period_key(F.col("d"), frequency)
    spans = (marked.withColumn("key", key).groupBy("key")
             .agg(F.min("d").alias("prediction_start"), F.max("d").alias("prediction_end"),
                  F.min_by("prior", "d").alias("train_cutoff")).where("train_cutoff IS NOT NULL"))
    first = F.col("prediction_start")
    name = {"monthly": F.date_format(first, "yyyy-MM"),
            "quarterly": F.concat(F.year(first).cast("string"), F.lit("Q"), F.quarter(first).cast("string"))
            }.get(frequency, F.date_format(first, "yyyy-MM-dd"))
    return spans.select(name.alias("name"), "train_cutoff", "prediction_start", "prediction_end")


def embargo_observations(dates: DataFrame, trading_days: int, date: str = "d") -> DataFrame:
    """One row: the embargo in observations of this calendar, from the median gap between dates."""
    order = Window.orderBy(date)
    gaps = (dates.select(date).distinct()
            .withColumn("gap", F.datediff(F.col(date), F.lag(date).over(order)).cast("double")))
    days = F.greatest(F.lit(1.0), F.median(F.when(F.col("gap") > 0, F.col("gap"))) * TRADING_DAYS / CALENDAR_DAYS)
    if trading_days <= 0:
        return gaps.agg(F.median("gap").alias("median_gap"), F.lit(0).alias("observations"))
    value = F.greatest(F.lit(1), F.ceil(trading_days / days)).cast("int")
    return gaps.agg(F.median("gap").alias("median_gap"),
                    F.coalesce(value, F.lit(max(1, trading_days))).alias("observations"))
