"""Single-factor research from one pass of ranks.

Every factor's rows are ranked once by score and by label, per date. Information coefficients, layers of any number, and
top-n portfolios are read off the same written ranks; layers are summed once per (factor, date, cells), a calendar-sized
table from which deciles, quintiles and their paths all follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from factorloom.operators import ic
from factorloom.operators.quality import union_all
from factorloom.operators.ranking import average, bucket
from factorloom.operators.series import compounded, running
from factorloom.session import materialise


def ranked(rows: DataFrame, slices: int | None = None) -> DataFrame:
    """Rows (factor, d, symbol, score, label) with both known, ranked per factor and date."""
    valid = rows.where("score IS NOT NULL AND label IS NOT NULL")
    return materialise(ic.ranked_pairs(valid, ["factor", "d"], "score", "label", slices=slices))


def coefficients(ranks: DataFrame) -> DataFrame:
    """(factor, name, value): mean, std, icir, win_rate, absolute_mean and observations of the daily rank IC."""
    daily = ranks.groupBy("factor", "d").agg(*ic.ic_columns())
    table = ic.ic_statistics(daily, ("factor",)).withColumn("observations", F.col("observations").cast("double"))
    return table.unpivot(["factor"], ["mean", "std", "icir", "win_rate", "absolute_mean", "observations"], "name", "value")


def layers(ranks: DataFrame, counts: Sequence[int]) -> DataFrame:
    """(factor, layers, d, layer, ret) for every number of layers; layer 0 is the top layer less the bottom one."""
    cells = [bucket(q, "rp").alias(f"b{q}") for q in counts]
    sums = materialise(ranks.select("factor", "d", "label", "rp_n", *cells).groupBy("factor", "d", "rp_n", *[f"b{q}" for q in counts]).agg(
        F.sum("label").alias("total"), F.count(F.lit(1)).alias("n")))
    out = []
    for q in counts:
        each = sums.where(F.col("rp_n") >= q).groupBy("factor", "d", (F.col(f"b{q}") + 1).alias("layer")).agg(
            (F.sum("total") / F.sum("n")).alias("ret"))
        spread = each.groupBy("factor", "d").agg(F.lit(0).alias("layer"), F.coalesce(
            F.max(F.when(F.col("layer") == q, F.col("ret"))) - F.max(F.when(F.col("layer") == 1, F.col("ret"))), F.lit(0.0)).alias("ret"))
        out.append(each.unionByName(spread).withColumn("layers", F.lit(q)))
    return union_all(out)


def layer_figures(returns: DataFrame) -> DataFrame:
    """(factor, layers, layer, mean_return, win_rate, nav): nav is the path's end."""
    path = running(("factor", "layers", "layer"), "d")
    return returns.withColumn("nav", compounded(F.col("ret"), path)).groupBy("factor", "layers", "layer").agg(
        F.avg("ret").alias("mean_return"), ic.ratio_above("ret").alias("win_rate"), F.max_by("nav", "d").alias("nav"))


def top_portfolios(ranks: DataFrame, n: int) -> DataFrame:
    """(factor, d, equal, weighted): mean label of the ``n`` best, equally weighted and in proportion to their rank."""
    best = ranks.where(F.col("rp_pos") > F.col("rp_n") - n)
    rank = average("rp")
    return best.groupBy("factor", "d").agg(F.avg("label").alias("equal"), (F.sum(rank * F.col("label")) / F.sum(rank)).alias("weighted"))
