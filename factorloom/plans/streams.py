"""Section L: the two live feeds, run over the whole events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.plans.oracle import r
from factorloom.plans.registry import query
from factorloom.session import scratch_path
from factorloom.streaming import feeds

def sided(rows):
    return rows.withColumn("side", F.when(F.col("user_id") % 2 == 0, "SELL").otherwise("BUY"))


def whole(p, work, parts, merge, name, columns, *keys):
    """Every day of the feed, merged from its parts, and the days that the feed has closed by itself."""
    schema = p.table("events").schema
    out = []
    for part, kind in ((work, columns), (parts, None)):
        stream = part(sided(feeds.read_feed(p.spark, p.folder, "events.parquet", schema)))
        target = scratch_path(p.spark, name)
        feeds.run_available(stream, target, scratch_path(p.spark, f"{name}-checkpoint"))
        out.append(p.spark.read.schema(kind or stream.schema).parquet(target))
    days = feeds.corrected(out[0], merge(out[1]), *keys)
    return days.drop("state", "earlier", "now").withColumn("d", F.col("day").cast("date")).drop("day")


@query("l01_daily_activity", f"""SELECT CAST(ts AS DATE) AS d, count(*) AS orders, {r('sum(value)')} AS gross,
    {r("sum(greatest(value*0.0003::DOUBLE, 5) + value*0.00001::DOUBLE + CASE WHEN user_id % 2 = 0 THEN value*CASE WHEN CAST(ts AS DATE) >= DATE '2023-08-28' THEN 0.0005::DOUBLE ELSE 0.001::DOUBLE END ELSE 0 END)")} AS fees
    FROM events GROUP BY 1""")
def daily_activity(p):
    return whole(p, feeds.daily_activity, feeds.activity_parts, feeds.whole_activity, "activity", "day timestamp, orders bigint, gross double, fees double")


@query("l02_latest_signal", f"""SELECT CAST(ts AS DATE) AS d, user_id, {r('arg_max(value, {ts: ts, id: event_id})')} AS value FROM events GROUP BY 1, 2""")
def latest_signal(p):
    signal = ("user_id", "value", "event_id")
    return whole(p, lambda rows: feeds.latest_signal(rows, *signal), lambda rows: feeds.signal_parts(rows, *signal),
                 lambda parts: feeds.whole_signals(parts, *signal), "signals", "day timestamp, user_id bigint, value double", "day", "user_id")
