"""Information coefficients and the summaries built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from factorloom.functions.columns import quarter_name
from factorloom.operators import gram
from factorloom.operators.calendar import calendar_broadcast
from factorloom.operators.cross_section import TINY, correlation
from factorloom.operators.ranking import add_rank, average, bucket, needs_slices, percent
from factorloom.operators.series import at_offset


def ranked_pairs(df: DataFrame, by: Sequence[str], prediction: str, label: str, tie: Sequence[str] = ("symbol",),
                 slices: int | None = None) -> DataFrame:
    """Average ranks of both sides over rows where both are known (``_p``/``_l`` hold those values)."""
    both = F.col(prediction).isNotNull() & F.col(label).isNotNull()
    pairs = df.withColumns({"_p": F.when(both, F.col(prediction)).cast("double"),
                            "_l": F.when(both, F.col(label)).cast("double")})
    slices = needs_slices(pairs, by) if slices is None else slices
    first = add_rank(pairs, by, "_p", tie, "rp", slices=slices)
    return add_rank(first, by, "_l", tie, "rl", slices=slices)


def _guarded(value: Column, least: int) -> Column:
    ok = (F.count("_p") >= least) & (F.stddev_samp("_p") > TINY) & (F.stddev_samp("_l") > TINY)
    return F.when(ok, value)


def ic_columns(least: int = 2) -> list[Column]:
    return [_guarded(correlation(average("rp"), average("rl")), least).alias("rank_ic"),
            _guarded(correlation("_p", "_l"), least).alias("pearson_ic"), F.count("_p").alias("stock_count"),
            F.stddev_samp("_p").alias("prediction_std"), F.stddev_samp("_l").alias("label_std")]


def daily_ic(df: DataFrame, by: Sequence[str] = ("d",), prediction: str = "prediction", label: str = "label",
             least: int = 2, tie: Sequence[str] = ("symbol",), slices: int | None = None) -> DataFrame:
    """Rank and Pearson IC per group; null where either side is flat or too few pairs exist."""
    return ranked_pairs(df, by, prediction, label, tie, slices).groupBy(*by).agg(*ic_columns(least))


def ratio_above(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.avg(F.when(value.isNotNull(), (value > 0).cast("double")))


def ic_statistics(daily: DataFrame, by: Sequence[str], value: str = "rank_ic") -> DataFrame:
    std = F.stddev_samp(value)
    return daily.groupBy(*by).agg(
        F.avg(value).alias("mean"), std.alias("std"), F.when(std > TINY, F.avg(value) / std).alias("icir"),
        ratio_above(value).alias("win_rate"), F.avg(F.abs(value)).alias("absolute_mean"),
        F.count(value).alias("observations"))


def horizon_ic(signals: DataFrame, returns: DataFrame, value: str, slices: int | None = None) -> DataFrame:
    """IC per (horizon, d); at least three names and two distinct values on each side."""
    rows = signals.join(returns, ["d", "symbol"])
    return daily_ic(rows, ("horizon", "d"), value, "forward_return", least=3, slices=slices)


def rank_change(ranked: DataFrame, dates: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, d, turnover): mean absolute change of percent rank from the previous date of the group."""
    order = Window.partitionBy(*by).orderBy("d") if by else Window.orderBy("d")
    idx = dates.select(*by, "d").distinct().withColumn("_idx", F.row_number().over(order))
    rows = ranked.join(calendar_broadcast(idx), [*by, "d"]).withColumn("_pct", percent("rp"))
    moved = rows.withColumn("_moved", F.abs(F.col("_pct") - at_offset("_pct", -1, (*by, "symbol"), "_idx")))
    return moved.groupBy(*by, "d").agg(F.avg("_moved").alias("turnover"))


def daily_metrics(predictions: DataFrame, by: Sequence[str] = ("model",), q: int = 5, slices: int | None = None
                  ) -> DataFrame:
    """Per (by, d): IC, sums and counts of the top and bottom bucket, rank turnover."""
    valid = predictions.where(F.col("prediction").isNotNull() & F.col("label").isNotNull())
    ranked = ranked_pairs(valid, [*by, "d"], "prediction", "label", slices=slices)
    rung = bucket(q, "rp")
    top, bottom = F.when(rung == q - 1, F.col("label")), F.when(rung == 0, F.col("label"))
    daily = ranked.groupBy(*by, "d").agg(*ic_columns(), F.sum(top).alias("top_sum"), F.count(top).alias("top_n"),
                                         F.sum(bottom).alias("bottom_sum"), F.count(bottom).alias("bottom_n"))
    return daily.join(calendar_broadcast(rank_change(ranked, valid, by)), [*by, "d"])


def metric_columns(turnover: Column) -> list[Column]:
    ic = F.col("rank_ic")
    n, std = F.count(ic), F.stddev_samp(ic)
    top, bottom = F.try_divide(F.sum("top_sum"), F.sum("top_n")), F.try_divide(F.sum("bottom_sum"), F.sum("bottom_n"))
    return [F.avg(ic).alias("mean_rank_ic"), F.avg("pearson_ic").alias("pearson_ic"), std.alias("rank_ic_std"),
            F.try_divide(F.avg(ic), std).alias("icir"), ratio_above(ic).alias("rank_ic_positive_ratio"),
            F.when(n > 1, F.try_divide(F.avg(ic), std / F.sqrt(n))).alias("rank_ic_t_stat"),
            top.alias("top_quantile_return"), bottom.alias("bottom_quantile_return"),
            (top - bottom).alias("top_bottom_return"), F.avg(turnover).alias("prediction_turnover"),
            n.alias("observation_days"), F.sum("stock_count").alias("sample_count")]


def metric_summary(predictions: DataFrame, by: Sequence[str] = ("model",), slices: int | None = None) -> DataFrame:
    return daily_metrics(predictions, by, slices=slices).groupBy(*by).agg(*metric_columns(F.col("turnover")))


def layered_metrics(predictions: DataFrame, slices: int | None = None) -> DataFrame:
    """The summary per model over the full test, each year and each quarter, from one pass over the days."""
    daily = daily_metrics(predictions, slices=slices).withColumns({"year": F.year("d").cast("string"), "quarter": quarter_name(F.col("d"))})

    def inside(period: str) -> Column:
        # a period's first date has no earlier date to compare with
        first = F.row_number().over(Window.partitionBy("model", period).orderBy("d")) == 1
        return F.when(~first, F.col("turnover"))

    marked = daily.withColumns({"turn_year": inside("year"), "turn_quarter": inside("quarter")})
    level = F.when(F.grouping("year") == 0, "year").when(F.grouping("quarter") == 0, "quarter").otherwise("full_test")
    turn = {k: F.avg(c) for k, c in (("year", "turn_year"), ("quarter", "turn_quarter"), ("full_test", "turnover"))}
    pieces = [c for c in metric_columns(F.col("turnover"))]
    grouped = marked.groupingSets([["model"], ["model", "year"], ["model", "quarter"]], "model", "year", "quarter").agg(
        level.alias("level"), *pieces, turn["year"].alias("_ty"), turn["quarter"].alias("_tq"))
    chosen = F.when(F.col("level") == "year", F.col("_ty")).when(F.col("level") == "quarter", F.col("_tq")).otherwise(
        F.col("prediction_turnover"))
    period = F.coalesce("year", "quarter", F.lit("all"))
    return (grouped.withColumns({"prediction_turnover": chosen, "period": period})
            .drop("year", "quarter", "_ty", "_tq"))


def double_sort(rows: DataFrame, q: int = 3, least: int = 30, slices: int | None = None) -> DataFrame:
    """Mean return in each (y bucket, x bucket) over dates with enough names; rows have d, symbol, x, y, r."""
    valid = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("r").isNotNull())
    slices = needs_slices(valid, ("d",)) if slices is None else slices
    ranked = add_rank(add_rank(valid, ("d",), "x", prefix="rx", slices=slices), ("d",), "y", prefix="ry", slices=slices)
    cells = ranked.where(F.col("rx_n") >= least).withColumns({"xb": bucket(q, "rx"), "yb": bucket(q, "ry")})
    return cells.groupBy("yb", "xb").agg(F.avg("r").alias("mean_return"), F.count("r").alias("n"))


def known_together(values: np.ndarray) -> np.ndarray:
    seen = (~np.isnan(values)).astype(float)
    return (seen.T @ seen).ravel()


def rank_products(values: np.ndarray) -> np.ndarray:
    """Per pair of columns, over rows where both are known: the rows, the products, the first's sums and squares."""
    seen = (~np.isnan(values)).astype(float)
    x = np.nan_to_num(values)
    return np.stack([seen.T @ seen, x.T @ x, x.T @ seen, (x * x).T @ seen]).ravel()


def pooled_spearman(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("d", "symbol")) -> DataFrame:
    """(x, y, spearman, n): rank correlation of each column pair over rows where both are known, dates pooled.

    A column is ranked once; it is ranked anew only for partners that are missing where it is known, once for all that are
    missing in the same rows. So a row is copied per ranking and not per pair, and all pairs come from one sum of products.
    ``keys`` tell rows apart. k*k numbers reach the driver.
    """
    k = len(columns)
    rows = df.select(*keys, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_x{i}") for i, c in enumerate(columns)])
    own = [f"_x{i}" for i in range(k)]
    found = gram.block_sums(rows.withColumn("_all", F.lit(0)), ["_all"], own, known_together).first()
    both = np.array(found["block"]).reshape(k, k) if found else np.zeros((k, k))
    n = np.diag(both)
    alike = [next(j for j in range(k) if both[i, j] == n[i] == n[j]) if n[i] else i for i in range(k)]  # the first with the same gaps
    rankings = sorted({(i, -1 if both[i, j] == n[i] else alike[j]) for i in range(k) for j in range(k)})
    place = {r: v for v, r in enumerate(rankings)}
    legs = [F.struct(F.lit(v).alias("v"), (F.col(own[i]) if j < 0 else F.when(F.col(own[j]).isNotNull(), F.col(own[i]))).alias("x"))
            for v, (i, j) in enumerate(rankings)]
    long = rows.select(*keys, F.explode(F.array(*legs)).alias("leg")).select(*keys, "leg.*").where("x IS NOT NULL")
    ranked = add_rank(long, ("v",), "x", keys, "rp")
    centred = (average("rp") - (F.col("rp_n") + 1) / 2) / F.col("rp_n")
    # a row has as many entries as there are rankings
    wide = ranked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("v", centred.alias("r")))).alias("m"))
    names = [f"_r{v}" for v in range(len(rankings))]
    vectors = wide.select(F.lit(0).alias("_all"), *[F.try_element_at("m", F.lit(v)).alias(name) for v, name in enumerate(names)])
    summed = gram.block_sums(vectors, ["_all"], names, rank_products).first()
    size = len(rankings)
    count, product, total, square = np.array(summed["block"]).reshape(4, size, size) if summed else np.zeros((4, size, size))
    out = []
    for i in range(k):
        for j in range(i + 1, k):
            a, b = (place[p, -1 if both[p, q] == n[p] else alike[q]] for p, q in ((i, j), (j, i)))
            m = count[a, b]
            spread = [square[u, v] - total[u, v] ** 2 / m if m else 0.0 for u, v in ((a, b), (b, a))]
            value = (product[a, b] - total[a, b] * total[b, a] / m) / math.sqrt(spread[0] * spread[1]) if min(spread) > 1e-12 else None
            value = None if value is None else float(value)
            out.append((columns[i], columns[j], value, int(m)))
    return df.sparkSession.createDataFrame(out, "x string, y string, spearman double, n bigint")


def coverage(df: DataFrame, columns: Sequence[str], total: str = "rows") -> DataFrame:
    """One row per column: known values and missing rate."""
    row = df.agg(F.count(F.lit(1)).alias(total), *[F.count(c).alias(c) for c in columns])
    return (row.unpivot([total], list(columns), "factor", "valid")
            .select("factor", "valid", (1 - F.try_divide("valid", total)).alias("missing_rate")))
