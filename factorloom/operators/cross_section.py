"""Cross-sectional statistics by date: aggregate once, send the small result back to the rows.

No window groups by date, so a date that holds most of the rows never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factorloom.functions.columns import clip, finite, is_infinite
from factorloom.operators.align import with_industry
from factorloom.operators.calendar import calendar_broadcast
from factorloom.operators.ranking import add_rank, bucket, drop_rank, group_quantile, needs_slices, percent
from factorloom.operators.spread import attach

TINY = 1e-12


def correlation(x: str | Column, y: str | Column) -> Column:
    """Correlation of two columns that are null together; null, not an error, where one is flat."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread))


def with_stats(df: DataFrame, by: Sequence[str], *stats: Column) -> DataFrame:
    """Attach group aggregates. Groups of a date and driver-known names are calendar-sized and broadcast."""
    table = df.groupBy(*by).agg(*stats)
    return df.join(calendar_broadcast(table, "d") if "d" in by else table, list(by))


def zscore(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("d",), limit: float | None = 5.0,
           zero_spread: str = "null") -> DataFrame:
    """(x - mean) / population std by group over observed values.

    ``zero_spread``: "null" empties a flat group, "center" divides by 1 (gives 0), "keep" leaves x.
    """
    clean = df.withColumns({c: finite(F.col(c)) for c in columns})
    stats = [s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    joined = with_stats(clean, by, *stats)
    out = {}
    for c in columns:
        x, mean, std = F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}")
        flat = {"null": F.lit(None).cast("double"), "center": x - mean, "keep": x}[zero_spread]
        z = F.when(std > TINY, (x - mean) / std).otherwise(flat)
        out[c] = z if limit is None else clip(z, -limit, limit)
    return joined.withColumns(out).select(*df.columns)


def standardise(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("d",)) -> DataFrame:
    """z-score of observed values, then missing becomes 0; infinite input fails the job."""
    guard = {c: F.when(is_infinite(F.col(c)), F.raise_error(F.lit(f"infinite value in {c}")).cast("double"))
             .otherwise(F.col(c)) for c in columns}
    z = zscore(df.withColumns(guard), columns, by, None, "center")
    return z.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def percent_rank(df: DataFrame, value: str, by: Sequence[str] = ("d",), name: str = "pct", slices: int | None = None
                 ) -> DataFrame:
    ranked = add_rank(df, by, value, prefix="_r", slices=slices)
    return drop_rank(ranked.withColumn(name, percent("_r")), "_r")


def quantile_bucket(df: DataFrame, value: str, q: int, by: Sequence[str] = ("d",), name: str = "bucket",
                    slices: int | None = None) -> DataFrame:
    ranked = add_rank(df, by, value, prefix="_r", slices=slices)
    return drop_rank(ranked.withColumn(name, bucket(q, "_r")), "_r")


def neutralise(rows: DataFrame, mapping: DataFrame, score: str = "score") -> DataFrame:
    """Demean by (d, industry) and restore the date's spread; a row without industry fails the job."""
    known = with_industry(rows.where(F.col(score).isNotNull()), mapping)
    gap = F.raise_error(F.concat(F.lit("no industry for "), F.col("symbol"))).cast("string")
    covered = known.withColumn("industry", F.when(F.col("industry").isNull(), gap).otherwise(F.col("industry").cast("string")))
    means = covered.groupBy("d", "industry").agg(F.avg(score).alias("_mean"))
    centred = attach(covered, means, ["d", "industry"]).withColumn("_c", F.col(score) - F.col("_mean"))
    scaled = with_stats(centred, ("d",), F.stddev_pop(score).alias("_raw"), F.stddev_pop("_c").alias("_new"))
    factor = F.when(F.col("_new") > TINY, F.col("_raw") / F.col("_new")).otherwise(1.0)
    return scaled.withColumn("neutral", F.col("_c") * factor).drop("_mean", "_c", "_raw", "_new")


def neutral_audit(neutralised: DataFrame, score: str = "score") -> DataFrame:
    """Per date: names, industries, largest industry mean, spread before and after."""
    per_industry = neutralised.groupBy("d", "industry").agg(F.avg("neutral").alias("mean"))
    means = per_industry.groupBy("d").agg(F.max(F.abs("mean")).alias("max_abs_industry_mean"),
                                          F.count(F.lit(1)).alias("industry_count"))
    spread = neutralised.groupBy("d").agg(F.count(score).alias("covered"), F.stddev_pop(score).alias("raw_score_std"),
                                          F.stddev_pop("neutral").alias("optimized_score_std"))
    return spread.join(calendar_broadcast(means), "d")


def consensus(contributions: DataFrame, quantile: float = 0.90, confirmations: int = 1, bonus: float = 0.05,
              slices: int | None = None) -> DataFrame:
    """Votes per (d, symbol) from long (d, symbol, style, x): a style votes buy (sell) where its
    contribution is positive (negative) and beyond the style's upper (lower) quantile of the date.
    """
    cuts = group_quantile(contributions, ("d", "style"), "x", {"upper": quantile, "lower": 1.0 - quantile},
                          slices=slices)
    placed = contributions.join(calendar_broadcast(cuts), ["d", "style"])
    buy = (F.col("x") >= F.col("upper")) & (F.col("x") > 0)
    sell = (F.col("x") <= F.col("lower")) & (F.col("x") < 0)
    votes = placed.groupBy("d", "symbol").agg(
        F.sum(buy.cast("int")).alias("buy_votes"), F.sum(sell.cast("int")).alias("sell_votes"),
        F.sum(F.when(buy, F.col("x")).otherwise(0.0)).alias("bullish"))
    eligible = F.col("buy_votes") >= confirmations
    raw = votes.select("d", "symbol", "buy_votes", "sell_votes", eligible.alias("buy_eligible"),
                       F.when(eligible, F.col("bullish") + bonus * F.col("buy_votes")).alias("prediction"))
    return zscore(raw, ["prediction"], limit=None, zero_spread="keep")


__all__ = ["zscore", "standardise", "percent_rank", "quantile_bucket", "neutralise", "neutral_audit", "consensus",
           "with_stats", "needs_slices"]
