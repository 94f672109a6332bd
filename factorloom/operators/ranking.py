"""Ranks within groups that stay distributed when one group is very large.

A plain window puts a whole group into one task. ``add_rank`` first measures the largest
group (one map-side-combined count). Up to ``spark.factorloom.maxGroupRows`` it uses a window.
Beyond that it range-partitions the rows on (group, value, tie), writes that layout once,
numbers rows inside each slice, and adds the rows of earlier slices as an offset; tied values
are merged per slice before they meet, so no step gathers a group.

Both forms sort one key column: the value with NaN as missing and -0.0 as 0.0. Missing values get no rank, infinite
ones rank at the ends, ties go by the tie columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factorloom.operators.spread import attach
from factorloom.session import materialise, max_group_rows


def largest_group(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in total)."""
    counts = df.groupBy(*by).count() if by else df.select(F.count(F.lit(1)).alias("count"))
    top, total = counts.agg(F.max("count"), F.sum("count")).first()
    return top or 0, total or 0


def needs_slices(df: DataFrame, by: Sequence[str]) -> int:
    """0 if windows by ``by`` are small enough, else the number of slices to cut."""
    limit = max_group_rows(df.sparkSession)
    top, total = largest_group(df, by)
    return 0 if top <= limit else max(2, -(-total // limit))


def key_of(df: DataFrame, value: str) -> Column:
    """What ranks compare: NaN counts as missing, and both zeros are one value."""
    if df.schema[value].dataType.typeName() in ("double", "float"):
        return F.when(~F.isnan(value), F.col(value) + 0.0)
    return F.col(value)


def _lead(ascending: bool) -> Column:
    """Missing keys first, so that what is known ends its group."""
    return F.col("_key").asc_nulls_first() if ascending else F.col("_key").desc_nulls_first()


def _by_window(df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str], prefix: str,
               ascending: bool) -> DataFrame:
    """One shuffle and one sort: every window below is served by the order (by, key, tie)."""
    names = {k: f"{prefix}_{k}" for k in ("pos", "lo", "hi", "n")}
    group = Window.partitionBy(*by)
    lead = _lead(ascending)
    peers = group.orderBy(lead)  # a running count by key takes in the whole tied block
    keyed = df.withColumn("_key", key_of(df, value))
    placed = keyed.withColumn("_row", F.row_number().over(group.orderBy(lead, *tie)))
    tied = placed.withColumns({"_first": F.rank().over(peers), "_last": F.count(F.lit(1)).over(peers)})
    counted = tied.withColumns({names["n"]: F.count("_key").over(group), "_all": F.count(F.lit(1)).over(group)})
    known, gaps = F.col("_key").isNotNull(), F.col("_all") - F.col(names["n"])
    places = {names[k]: F.when(known, F.col(c) - gaps) for k, c in (("pos", "_row"), ("lo", "_first"), ("hi", "_last"))}
    return counted.withColumns(places).select(*df.columns, *[names[k] for k in ("pos", "lo", "hi", "n")])


def _by_slices(df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str], prefix: str,
               ascending: bool, slices: int) -> DataFrame:
    names = {k: f"{prefix}_{k}" for k in ("pos", "lo", "hi", "n")}
    order = [_lead(ascending), *[F.col(t).asc() for t in tie]]
    keyed = df.withColumn("_key", key_of(df, value))
    known = keyed.where(F.col("_key").isNotNull())
    laid = materialise(known.repartitionByRange(slices, *[F.col(b) for b in by], *order)
                       .withColumn("_slice", F.spark_partition_id()))
    sizes = laid.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    # as many rows as slices a group touches
    group = Window.partitionBy(*by)
    ahead = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_slice", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"),
                           F.sum("_rows").over(group).alias(names["n"]))
    local = Window.partitionBy(*by, "_slice").orderBy(*order)
    numbered = (laid.withColumn("_local", F.row_number().over(local)).join(offsets, [*by, "_slice"])
                .withColumn(names["pos"], F.col("_local") + F.col("_before")).drop("_local", "_before"))
    per_slice = numbered.groupBy(*by, "_slice", "_key").agg(F.min(names["pos"]).alias("_lo"),
                                                           F.max(names["pos"]).alias("_hi"))
    tied = Window.partitionBy(*by, "_key")
    extents = per_slice.select(*by, "_slice", "_key", F.min("_lo").over(tied).alias(names["lo"]),
                               F.max("_hi").over(tied).alias(names["hi"]))
    ranked = numbered.join(extents, [*by, "_slice", "_key"]).select(*df.columns, *names.values())
    unknown = keyed.where(F.col("_key").isNull()).drop("_key").withColumns(
        {names[k]: F.lit(None).cast("long") for k in ("pos", "lo", "hi")})
    if not by:
        return ranked.unionByName(unknown.withColumn(names["n"], F.lit(laid.count())))
    totals = offsets.select(*by, names["n"]).distinct()
    counted = attach(unknown, totals, by, how="left")
    return ranked.unionByName(counted.withColumn(names["n"], F.coalesce(names["n"], F.lit(0))))


def add_rank(df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str] = ("symbol",), prefix: str = "rk",
             ascending: bool = True, slices: int | None = None) -> DataFrame:
    """Add ``_pos`` (unique, ties by ``tie``), ``_lo``/``_hi`` (extent of the tied block), ``_n`` (known rows).

    Null and NaN values get null ranks. Pass ``slices`` (from ``needs_slices``) to measure once for several ranks.
    """
    slices = needs_slices(df, by) if slices is None else slices
    if slices:
        return _by_slices(df, by, value, tie, prefix, ascending, slices)
    return _by_window(df, by, value, tie, prefix, ascending)


def average(prefix: str = "rk") -> Column:
    return (F.col(f"{prefix}_lo") + F.col(f"{prefix}_hi")) / 2


def percent(prefix: str = "rk") -> Column:
    """Average rank over count."""
    return average(prefix) / F.col(f"{prefix}_n")


def bucket(q: int, prefix: str = "rk") -> Column:
    """0-based equal-frequency bucket of the unique position: ceil((pos-1)*q/(n-1))-1, in integers."""
    step = F.col(f"{prefix}_n") - 1
    scaled = (F.col(f"{prefix}_pos") - 1) * q
    up = F.when(step > 0, F.floor((scaled + step - 1) / step)).otherwise(0)
    return F.when(F.col(f"{prefix}_pos").isNotNull(), F.greatest(up - 1, F.lit(0))).cast("int")


def drop_rank(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[f"{p}_{k}" for p in prefixes for k in ("pos", "lo", "hi", "n")])


def group_quantile(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float],
                   tie: Sequence[str] = ("symbol",), slices: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group, as one column per name.

    Reads the two neighbours off the ranks, so no group's values are gathered.
    """
    ranked = add_rank(df.where(key_of(df, value).isNotNull()).select(*by, value, *tie), by, value, tie, "q", slices=slices)
    outputs = []
    for name, p in probabilities.items():
        place = F.round((F.col("q_n") - 1) * p, 9)  # 0.9 * 30 must be 27, not a hair beside it
        low = F.floor(place)
        below = F.max(F.when(F.col("q_pos") - 1 == low, F.col(value)))
        above = F.max(F.when(F.col("q_pos") - 2 == low, F.col(value)))
        outputs.append((below + F.coalesce((above - below) * F.max(place - low), F.lit(0.0))).alias(name))
    return ranked.groupBy(*by).agg(*outputs)


def even_sample(df: DataFrame, order: Sequence[str], size: int, slices: int | None = None) -> DataFrame:
    """``size`` rows evenly spaced over the whole ordered frame, both ends included; all rows if there are fewer.

    The overall numbering is one group, so it takes the sliced form as soon as it passes the window bound.
    """
    lead, *rest = order
    ranked = add_rank(df, (), lead, rest, "_e", slices=slices)
    step, last = F.col("_e_n") - 1, size - 1
    at = F.col("_e_pos") - 1
    # row i is taken if some k in 0..size-1 has floor(k*step/last) = i, i.e. the k at or after i*last/step
    k = F.floor((at * last + step - 1) / step).cast("long")
    taken = (F.col("_e_n") <= size) | (F.floor(k * step / last) == at)
    return drop_rank(ranked.where(taken), "_e")
