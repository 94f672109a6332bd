"""Section B: sinks, written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import columns as c
from factorloom.operators import ic
from factorloom.plans.inputs import predictions
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query
from factorloom.session import scratch_path
from factorloom.sources import readers, writers


@query("b01_partitioned_predictions", sql(f"""SELECT model, CAST(year(d) AS VARCHAR) || 'Q' || quarter(d) AS period, count(*) AS n, {r('sum(prediction)')} AS total
    FROM pred GROUP BY 1, 2""", "pred"))
def partitioned_predictions(p):
    rows = predictions(p).withColumn("period", c.quarter_name(F.col("d")))
    back = p.spark.read.parquet(writers.write_predictions(rows, scratch_path(p.spark, "by_model")))
    return back.groupBy("model", "period").agg(F.count("*").alias("n"), F.sum("prediction").alias("total"))


@query("b02_factor_file", sql(f"SELECT d, symbol, {r('prediction')} AS disc FROM pred WHERE model = 'disc'", "pred"))
def factor_file(p):
    rows = predictions(p).where("model = 'disc'")
    return readers.read_factor(p.spark, writers.write_factor_file(rows, scratch_path(p.spark, "factor_file"), "disc"), "disc")


@query("b03_csv_tables", sql(f"SELECT d, symbol, side, count(*) AS n, {r('sum(gross)')} AS gross FROM ledger GROUP BY 1,2,3", "ledger"))
def csv_tables(p):
    path = writers.write_csv(p.ledger(), scratch_path(p.spark, "orders"))
    back = p.spark.read.option("header", True).schema("order_id bigint, d date, symbol string, side string, gross double").csv(path)
    return back.groupBy("d", "symbol", "side").agg(F.count("*").alias("n"), F.sum("gross").alias("gross"))


@query("b04_json_metrics", sql(f"SELECT model, {r('avg(rank_ic)')} AS mean, count(rank_ic) AS observations FROM ic GROUP BY model", "ic"))
def json_metrics(p):
    rows = predictions(p).where("prediction IS NOT NULL AND label IS NOT NULL")
    stats = ic.ic_statistics(ic.daily_ic(rows, ("model", "d"), slices=p.slices()), ("model",))
    path = writers.write_json(stats, scratch_path(p.spark, "metrics"))
    return p.spark.read.schema("model string, mean double, observations bigint").json(path)
