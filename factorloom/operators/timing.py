"""Style timing: per-date design tables, timers, and the shared two-horizon model.

Every frame here has one row per date, or per date and style, so it is calendar-sized.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from factorloom.functions.columns import age_weight
from factorloom.operators import models
from factorloom.operators.style import benchmark_features, cross_style_ic, horizon_labels, timing_features, winners
from factorloom.operators.walkforward import purged_split

MEASURES = ("momentum_5", "momentum_20", "volatility_5")
HORIZONS = (5, 20)
EMBARGO_DAYS = 20


def feature_names(styles: Sequence[str]) -> list[str]:
    return [f"{s}_{m}" for s in styles for m in MEASURES] + ["benchmark_volatility", "benchmark_return"]


def timing_table(returns: DataFrame, dates: DataFrame, benchmark: DataFrame, styles: Sequence[str],
                 horizons: Sequence[int] = HORIZONS, label_horizon: int = 5) -> DataFrame:
    """One row per decision date: features known that day, the later winner, and targets per style and horizon."""
    known = timing_features(returns, dates, styles)
    wide = known.groupBy("d").agg(
        F.max("max_information_date").alias("max_information_date"),
        *[F.max(F.when(F.col("style") == s, F.col(m))).alias(f"{s}_{m}") for s in styles for m in MEASURES])
    out = wide.join(benchmark_features(benchmark), "d", "left")
    out = out.join(winners(horizon_labels(returns, label_horizon, styles)), "d", "left")
    for h in horizons:
        target = horizon_labels(returns, h, styles).groupBy("d").agg(
            F.first("label_exit_date").alias(f"label_exit_date_{h}"),
            *[F.max(F.when(F.col("style") == s, F.col("target"))).alias(f"target_{s}_{h}") for s in styles])
        out = out.join(target, "d", "left")
    return out.withColumn("information_available", F.coalesce(F.col("max_information_date") <= F.col("d"), F.lit(True)))


def momentum_ic(table: DataFrame, styles: Sequence[str], horizon: int) -> DataFrame:
    """(d, rank_ic): momentum against the realised return of the same horizon, across styles."""
    legs = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.col(f"{s}_momentum_{horizon}").alias("x"),
                                        F.col(f"target_{s}_{horizon}").alias("y")) for s in styles]))
    return cross_style_ic(table.select("d", legs.alias("leg")).select("d", "leg.*"), "x", "y").select("d", "rank_ic")


def weighted_training(table: DataFrame, cutoff: str, exit_column: str, margin: bool = False) -> DataFrame:
    """Rows realised before the cutoff, older ones weighing less."""
    day = F.lit(cutoff).cast("date")
    weight = age_weight(F.datediff(day, F.col("d")))
    if margin:
        weight = weight * (1 + F.greatest(F.col("winner_margin"), F.lit(0.0)))
    return table.where(F.col(exit_column) < day).withColumn("sample_weight", weight)


def equal_weights(dates: DataFrame, styles: Sequence[str]) -> DataFrame:
    return dates.select("d", F.explode(F.array(*[F.lit(s) for s in styles])).alias("style")).withColumn("w", F.lit(1.0 / len(styles)))


def softmax_weights(rows: DataFrame, values: dict[str, str], sharpness: float = 20.0) -> DataFrame:
    """(d, style, w): softmax over styles of the named columns; a missing value counts as 0."""
    raw = [F.coalesce(F.col(v), F.lit(0.0)) for v in values.values()]
    top = F.greatest(*raw) if len(raw) > 1 else raw[0]
    powers = [F.exp((x - top) * sharpness) for x in raw]
    total = sum(powers[1:], powers[0])
    legs = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), (x / total).alias("w")) for s, x in zip(values, powers)]))
    return rows.select("d", legs.alias("leg")).select("d", "leg.*")


def long_design(table: DataFrame, styles: Sequence[str], horizon: int | None = None) -> tuple[DataFrame, list[str]]:
    """(d, style) rows with all features, the style's own three, and one indicator per style; target if a horizon is given."""
    own = {f"own_{m}": m for m in MEASURES}
    legs = F.explode(F.array(*[
        F.struct(F.lit(s).alias("style"), *[F.col(f"{s}_{m}").alias(n) for n, m in own.items()],
                 *[F.lit(1.0 if s == other else 0.0).alias(f"is_{other}") for other in styles],
                 *([F.col(f"target_{s}_{horizon}").alias("target")] if horizon else [])) for s in styles]))
    shared = feature_names(styles)
    carried = [n for n in ("sample_weight", "label_exit_date") if n in table.columns]
    out = table.select("d", *carried, *shared, legs.alias("leg")).select("d", *carried, *shared, "leg.*")
    return out, [*shared, *own, *[f"is_{s}" for s in styles]]


def fit_horizon(train: DataFrame, styles: Sequence[str], horizon: int, trees: int = 8, depth: int = 2, step: float = 0.1):
    """One model for all styles. The tree count is the best on the last fifth of dates after an embargo; then all rows are refitted."""
    rows, features = long_design(train.withColumn("label_exit_date", F.col(f"label_exit_date_{horizon}")), styles, horizon)
    parts = purged_split(rows, EMBARGO_DAYS)
    options = {"label": "target", "weight": "sample_weight", "depth": depth, "stepSize": step}
    fit = parts.where("part = 'fit'")  # purged rows realise their label inside the validation span
    if not fit.limit(1).count():
        raise ValueError(f"no training date before the validation span has a realised label for horizon {horizon}")
    trial = models.fit_boosted(fit, features, trees=trees, **options)
    held = models.assembled(parts.where("part = 'validation'"), features)
    losses = trial.evaluateEachIteration(held.withColumn(trial.getLabelCol(), F.col("target")), "squared")
    best = min(range(len(losses)), key=losses.__getitem__) + 1
    forecast = models.predict(trial, parts.where("part = 'validation'"), features)
    validation = cross_style_ic(forecast, "prediction", "target").agg(F.avg("rank_ic")).first()[0]
    return models.fit_boosted(rows, features, trees=best, **options), features, best, validation


def forecast(model, features: Sequence[str], table: DataFrame, styles: Sequence[str], name: str) -> DataFrame:
    rows, _ = long_design(table, styles)
    return models.predict(model, rows, features, name).select("d", "style", name)
