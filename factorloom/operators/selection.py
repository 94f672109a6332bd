"""Choosing names and weights on each date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factorloom.functions.columns import finite
from factorloom.operators.calendar import calendar_broadcast
from factorloom.operators.cross_section import with_stats, zscore
from factorloom.operators.ranking import add_rank, drop_rank, key_of, percent
from factorloom.operators.spread import attach


def style_score(exposures: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of exposure times the date's style weight, standardised by date."""
    score = (exposures.join(calendar_broadcast(weights), ["d", "style"]).groupBy("d", "symbol")
             .agg(F.sum(F.col("x") * F.col("w")).alias("prediction")))
    return zscore(score, ["prediction"], limit=None, zero_spread="center")


BUCKETS = 64  # parts of a date that are cut down on their own before they meet


def _first_n(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each date, numbered, whatever n and the date's size.

    Every (date, bucket) is cut to n rows before the date's parts meet, and Spark cuts each task's rows ahead of either
    shuffle where n is small enough.
    """
    place = F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS))
    part = Window.partitionBy("d", "_bucket").orderBy(*order)
    cut = rows.withColumn("_bucket", place).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= n)
    whole = Window.partitionBy("d").orderBy(*order)
    return cut.drop("_bucket", "rank").withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n)


def top_n(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    """Best ``n`` names per date (ties by symbol); a score that is missing, NaN or infinite is no candidate."""
    return _first_n(scores.where(finite(F.col(score)).isNotNull()), n, F.col(score).desc(), F.col("symbol"))


def worst_n(scores: DataFrame, n: int) -> DataFrame:
    """Worst ``n`` names per date (ties by symbol); a name without a score, or with NaN, is the worst."""
    return _first_n(scores, n, key_of(scores, "score").asc_nulls_first(), F.col("symbol"))


def top_quantile(scores: DataFrame, q: float, score: str = "score", slices: int | None = None) -> DataFrame:
    """Best max(1, ceil(n*q)) names per date."""
    ranked = add_rank(scores.where(finite(F.col(score)).isNotNull()), ("d",), score, prefix="_r", ascending=False, slices=slices)
    keep = ranked.where(F.col("_r_pos") <= F.greatest(F.lit(1), F.ceil(F.col("_r_n") * q)))
    return drop_rank(keep.withColumn("rank", F.col("_r_pos")), "_r")


def weights(selected: DataFrame, mode: str = "score", score: str = "score", slices: int | None = None) -> DataFrame:
    """Weight per (d, symbol): "equal", "score" (percent rank over its sum), or "tilted" (a fifth equal, the rest by rank)."""
    if mode == "equal":
        out = with_stats(selected, ("d",), F.count(F.lit(1)).alias("_n"))
        return out.withColumn("weight", 1.0 / F.col("_n")).drop("_n")
    ranked = add_rank(selected, ("d",), score, prefix="_w", slices=slices).withColumn("_pct", F.coalesce(percent("_w"), F.lit(0.0)))
    out = with_stats(ranked, ("d",), F.sum("_pct").alias("_sum"), F.count(F.lit(1)).alias("_names"))
    share = F.when(F.col("_sum") > 1e-12, F.col("_pct") / F.col("_sum")).otherwise(1.0 / F.col("_names"))
    value = share if mode == "score" else F.when(F.col("_sum") > 1e-12, 0.20 / F.col("_names") + 0.80 * share).otherwise(share)
    return drop_rank(out.withColumn("weight", value), "_w").drop("_pct", "_sum", "_names")


def equal_industry_budget(weighted: DataFrame, industries: DataFrame) -> DataFrame:
    """Rescale weights so that each industry present on a date holds the same share."""
    rows = weighted.join(industries, "symbol", "left").withColumn("industry", F.coalesce(F.col("industry").cast("string"), F.lit("UNKNOWN")))
    budget = rows.groupBy("d", "industry").agg(F.sum("weight").alias("_sum"))
    count = budget.groupBy("d").agg(F.count(F.lit(1)).alias("_industries"))
    shares = budget.join(calendar_broadcast(count), "d")
    return (attach(rows, shares, ["d", "industry"])
            .withColumn("weight", F.col("weight") / F.col("_sum") / F.col("_industries")).drop("_sum", "_industries"))


def buffered_replacement(scores: DataFrame, holdings: DataFrame, n: int, ratio: float, retain: DataFrame | None = None
                         ) -> DataFrame:
    """One step from given holdings: drop the worst held names outside the top ``n`` that are not retained,
    at most int(n*ratio) per date, and refill with the best names not held.

    ``scores``: d, symbol, score (known scores only). ``holdings``: d, symbol. Returns d, symbol, action.
    """
    cap = int(n * ratio)
    known = scores.where(F.col("score").isNotNull())
    best = top_n(known, n).select("d", "symbol", F.lit(True).alias("_top"))
    held = (holdings.select("d", "symbol").join(known.select("d", "symbol", "score"), ["d", "symbol"], "left")
            .join(best, ["d", "symbol"], "left"))
    if retain is not None:
        held = held.join(retain.select("d", "symbol", "retain"), ["d", "symbol"], "left")
    else:
        held = held.withColumn("retain", F.lit(False))
    loose = held.where(F.col("_top").isNull() & ~F.coalesce("retain", F.lit(False)))
    sold = worst_n(loose, cap).select("d", "symbol", F.lit("sell").alias("action"))
    return sold.unionByName(_refill(known, holdings, sold, n))


def _refill(candidates: DataFrame, holdings: DataFrame, sold: DataFrame, n: int) -> DataFrame:
    """Best candidates not held after the sales, one per free slot."""
    kept = holdings.select("d", "symbol").join(sold.select("d", "symbol"), ["d", "symbol"], "left_anti")
    free = (holdings.groupBy("d").agg(F.count(F.lit(1)).alias("held"))
            .join(sold.groupBy("d").agg(F.count(F.lit(1)).alias("sold")), "d", "left")
            .select("d", F.greatest(F.lit(n) - F.col("held") + F.coalesce("sold", F.lit(0)), F.lit(0)).alias("free")))
    pool = candidates.join(kept, ["d", "symbol"], "left_anti")
    ranked = top_n(pool, n).withColumnRenamed("rank", "k")  # no date has more than n free slots
    return (ranked.join(calendar_broadcast(free), "d").where(F.col("k") <= F.col("free"))
            .select("d", "symbol", F.lit("buy").alias("action")))


def decile_rotation(scores: DataFrame, holdings: DataFrame, n: int, ratio: float, q: float, slices: int | None = None) -> DataFrame:
    """One step from given holdings: drop the worst ceil(q*held) names (at least one, at most int(n*ratio)),
    buy from the top ceil(q*ranked) names not held. Returns d, symbol, action.
    """
    cap = int(n * ratio)
    known = scores.where(F.col("score").isNotNull())
    held = with_stats(holdings.select("d", "symbol"), ("d",), F.count(F.lit(1)).alias("_held")).join(
        known.select("d", "symbol", "score"), ["d", "symbol"], "left")
    quota = F.least(F.lit(cap), F.greatest(F.lit(1), F.ceil(F.col("_held") * q)))
    sold = worst_n(held.withColumn("quota", quota), cap).where(F.col("rank") <= F.col("quota")).select(
        "d", "symbol", F.lit("sell").alias("action"))
    front = top_quantile(known, q, slices=slices).drop("rank")
    return sold.unionByName(_refill(front, holdings, sold, n))
