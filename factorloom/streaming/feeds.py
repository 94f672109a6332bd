"""Two live feeds on Structured Streaming: daily activity, and the latest signal per day and name.

Both group by the event's day, which is also the event-time column, and append a day once the watermark
has passed it. State holds only the open days' partial sums, spread by the grouping key. Sinks are parquet
folders with their own checkpoint, so a lost executor or a restart neither repeats nor drops a day.

The last days stay open until a later row moves the watermark, and a row that arrives after its day was written is late.
A second, stateless query therefore appends what every task has summed up of its part of a batch (``activity_parts``,
``signal_parts``); these parts hold each row once, late or not. ``corrected`` merges them into whole days, open ones with
them, and ``corrections`` says which written days late rows have changed, and by how much. Files are never read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from factorloom.functions.columns import transaction_fee

LATENESS = "1 day"
HELD_ROWS = 200_000  # sums a task holds before it passes them on


def read_feed(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def by_day(feed: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    return feed.withColumn("day", F.col(ts).cast("date").cast("timestamp")).withWatermark("day", lateness)


def daily_activity(feed: DataFrame, gross: str = "value", side: str = "side", lateness: str = LATENESS) -> DataFrame:
    """Orders, gross and fees per finished day."""
    fee = transaction_fee(F.col("day").cast("date"), F.col(side), F.col(gross))
    return by_day(feed, lateness=lateness).groupBy("day").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(gross).alias("gross"), F.sum(fee).alias("fees"))


def latest_signal(feed: DataFrame, symbol: str, value: str, order: str, lateness: str = LATENESS) -> DataFrame:
    """The last value per (day, name) among rows that arrive within the allowed lateness."""
    newest = F.max_by(value, F.struct("ts", order))
    return by_day(feed, lateness=lateness).groupBy("day", symbol).agg(newest.alias(value))


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Work through everything that is there, then stop; started again, it takes up only what is new."""
    query = (stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def combined(rows: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Each task's rows merged as far as they meet in it; the same columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = merge(batch if held is None else pd.concat([held, batch]))
            if len(held) > HELD_ROWS:
                yield held
                held = None
        if held is not None:
            yield held

    return rows.mapInPandas(run, rows.schema)


def activity_parts(feed: DataFrame, gross: str = "value", side: str = "side") -> DataFrame:
    """(day, orders, gross, fees): sums that add up to the days of all rows with a time."""
    day = F.col("ts").cast("date")
    rows = feed.where(F.col("ts").isNotNull()).select(
        day.cast("timestamp").alias("day"), F.lit(1).cast("long").alias("orders"), F.col(gross).cast("double").alias("gross"),
        transaction_fee(day, F.col(side), F.col(gross)).cast("double").alias("fees"))
    return combined(rows, lambda x: x.groupby("day", as_index=False).sum(min_count=1))


def signal_parts(feed: DataFrame, symbol: str, value: str, order: str) -> DataFrame:
    """(day, name, ts, order, value): the last row per day and name that a task has seen."""
    rows = feed.where(F.col("ts").isNotNull()).select(F.col("ts").cast("date").cast("timestamp").alias("day"), symbol, "ts", order, value)
    return combined(rows, lambda x: x.sort_values(["ts", order], na_position="first").drop_duplicates(["day", symbol], keep="last"))


def whole_activity(parts: DataFrame) -> DataFrame:
    return parts.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("orders", "gross", "fees")])


def whole_signals(parts: DataFrame, symbol: str, value: str, order: str) -> DataFrame:
    return parts.groupBy("day", symbol).agg(F.max_by(value, F.struct("ts", order)).alias(value))


def corrected(written: DataFrame, whole: DataFrame, *keys: str) -> DataFrame:
    """``whole`` days (or ``keys``) with ``state``: written (as the feed had it), corrected (late rows came) or open."""
    keys = list(keys or ["day"])
    values = [c for c in whole.columns if c not in keys]
    earlier = written.select(*keys, F.struct(*values).alias("earlier"))
    closed = F.col("day") <= F.lit(written.agg(F.max("day")).first()[0])
    now = F.struct(*[F.col(c) for c in values])
    same = F.col("earlier").isNotNull()
    for c in values:
        near = F.abs(F.col(f"earlier.{c}") - F.col(c)) <= 1e-9 * F.greatest(F.abs(c), F.lit(1.0))
        same = same & (F.col(f"earlier.{c}").eqNullSafe(F.col(c)) | F.coalesce(near, F.lit(False)))
    state = F.when(~F.coalesce(closed, F.lit(False)), "open").when(same, "written").otherwise("corrected")
    return whole.join(earlier, keys, "left").select(*keys, *values, state.alias("state"), "earlier", now.alias("now"))


def corrections(written: DataFrame, whole: DataFrame, *keys: str) -> DataFrame:
    """The written days that late rows have changed: what was written (null: nothing) and what holds now."""
    return corrected(written, whole, *keys).where("state = 'corrected'").drop("state")
