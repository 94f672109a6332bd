"""Sinks: partitioned predictions, re-loadable factor files, CSV result tables, JSON metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_predictions(predictions: DataFrame, path: str) -> str:
    """Parquet folders by model and period. Rebalancing gives small folders one file and splits large ones over tasks."""
    predictions.hint("rebalance", "model", "period").write.partitionBy("model", "period").parquet(path)
    return path


def write_factor_file(predictions: DataFrame, path: str, name: str) -> str:
    """(ticker, date, <name>) sorted within files, in the form ``read_factor`` loads."""
    rows = predictions.select(F.col("symbol").alias("ticker"), F.date_format("d", "yyyyMMdd").cast("int").alias("date"),
                              F.col("prediction").alias(name))
    rows.repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date").write.parquet(path)
    return path


def write_csv(table: DataFrame, path: str) -> str:
    table.write.option("header", True).csv(path)
    return path


def write_json(row: DataFrame, path: str) -> str:
    row.write.json(path)
    return path
