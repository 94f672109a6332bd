"""Walk-forward linear models for every split and penalty from one scan of the panel.

Splits overlap, so joining rows to splits would copy the panel once per split. The sums that scaling and
least squares need are additive over dates: they are taken once per (d, label_exit_date), a calendar-sized
table, and each split adds up its own dates. Missing cells are left out of the scaling and count as 0 after
it, hence the pairwise sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from factorloom.functions import columns as c
from factorloom.operators import gram
from factorloom.operators.align import in_training, prediction_rows
from factorloom.operators.calendar import calendar_broadcast, embargo_observations
from factorloom.session import materialise

# Penalty grids.
RIDGE_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
ELASTIC_ALPHAS = (0.001, 0.01, 0.1, 1.0)
ELASTIC_L1_RATIOS = (0.2, 0.8)


def pairwise_sums(values: np.ndarray) -> np.ndarray:
    """Sums over rows of (features..., label): for each pair the rows where both are known, the products, and the sums of
    the first where the second is known; then per feature its product with the label and the label where it is known;
    then the label and the rows."""
    x, y = values[:, :-1], values[:, -1]
    seen = ~np.isnan(x)
    filled, mask = np.where(seen, x, 0.0), seen.astype(float)
    return np.concatenate([(mask.T @ mask).ravel(), (filled.T @ filled).ravel(), (filled.T @ mask).ravel(), filled.T @ y, mask.T @ y,
                           [y.sum(), len(y)]])


def moments(data: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(d, label_exit_date, rows, block): pairwise-observed sums of labelled rows, written once."""
    rows = data.where(F.col(label).isNotNull() & F.col("label_exit_date").isNotNull())
    sums = gram.block_sums(rows, ["d", "label_exit_date"], [*features, label], pairwise_sums)
    return materialise(sums.withColumn("rows", F.element_at("block", -1).cast("long")))


@dataclass
class System:
    """Scaling and normal equations of one split (columns centred and scaled on its training rows)."""

    name: str
    rows: int
    first: object
    last: object
    last_exit: object
    mean: np.ndarray
    scale: np.ndarray
    gram: np.ndarray
    rhs: np.ndarray
    label_mean: float


def split_sums(table: DataFrame, splits: DataFrame, start: str, mode: str = "expanding", years: int = 4,
               strict: bool = False) -> DataFrame:
    """(name, first, last, last_exit, block): each split's dates and the sums over its training rows, written once."""
    picked = in_training(table, splits, start, mode, years, strict)
    spans = picked.groupBy("name").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.max("label_exit_date").alias("last_exit"))
    return materialise(spans.join(gram.added(picked, ["name"]), "name"))


def solved(row, features: Sequence[str]) -> System:
    """The system of one row of ``split_sums``."""
    k, block = len(features), np.array(row["block"])
    full, cross, given = (block[i * k * k:(i + 1) * k * k].reshape(k, k) for i in range(3))
    xy_sum, label_seen, (label_sum, rows) = block[3 * k * k:3 * k * k + k], block[3 * k * k + k:-2], block[-2:]
    seen = np.diag(full)
    if (seen == 0).any():
        empty = [f for f, n in zip(features, seen) if n == 0]
        raise ValueError(f"{row['name']}: no training value in {empty}")
    mean = np.diag(given) / seen
    spread = np.sqrt(np.maximum(np.diag(cross) / seen - mean ** 2, 0.0))
    scale = np.where(spread > 0, spread, 1.0)
    centred = cross - given * mean[None, :] - (given * mean[None, :]).T + full * np.outer(mean, mean)
    xy = xy_sum - mean * label_seen
    return System(row["name"], int(rows), row["first"], row["last"], row["last_exit"], mean, scale,
                  centred / np.outer(scale, scale), xy / scale, label_sum / rows)


def systems(table: DataFrame, splits: DataFrame, features: Sequence[str], start: str, mode: str = "expanding",
            years: int = 4, strict: bool = False) -> list[System]:
    """The systems of a few splits on the driver (k*k numbers each); ``fits`` solves any number of them in tasks."""
    return [solved(row, features) for row in split_sums(table, splits, start, mode, years, strict).orderBy("name").collect()]


def coefficients(system: System, model: str, alpha: float = 0.0, l1_ratio: float = 0.0) -> np.ndarray:
    """Weights on the scaled columns; they are centred, so the intercept is the label mean and is not penalised."""
    if model == "elasticnet":
        return gram.solve_elastic(system.gram / system.rows, system.rhs / system.rows, alpha, l1_ratio)
    return np.linalg.lstsq(system.gram + alpha * np.eye(len(system.rhs)), system.rhs, rcond=None)[0]


FIT_SCHEMA = ("name string, model string, alpha double, l1_ratio double, intercept double, mean array<double>, "
              "scale array<double>, weight array<double>")


def fit_row(s: System, model: str, alpha: float, l1: float) -> tuple:
    return (s.name, model, float(alpha), float(l1), float(s.label_mean), s.mean.tolist(), s.scale.tolist(),
            [float(x) for x in coefficients(s, model, alpha, l1)])


def fit_table(spark, fits: Sequence[tuple[System, str, float, float]]) -> DataFrame:
    return spark.createDataFrame([fit_row(*f) for f in fits], FIT_SCHEMA)


def fits(sums: DataFrame, features: Sequence[str], candidates: Callable[[str], Sequence[tuple[str, float, float]]]) -> DataFrame:
    """Every split of ``split_sums`` fitted with its ``candidates`` (model, alpha, l1_ratio; by the split's name). A split is
    solved in the task that holds its sums; the fits are written, so that their size is known where they are joined."""
    names = [x.split()[0] for x in FIT_SCHEMA.split(", ")]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                system = solved(row, features)
                yield pd.DataFrame([fit_row(system, *c) for c in candidates(system.name)], columns=names)

    return materialise(sums.mapInPandas(solve, FIT_SCHEMA))


def score(rows: DataFrame, splits: DataFrame, fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """Predictions of every fit on its split's rows."""
    placed = prediction_rows(rows, splits.select("name", "prediction_start", "prediction_end"))
    return with_fit(placed.drop("prediction_start", "prediction_end"), fits, features)


def with_fit(rows: DataFrame, fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` (with the name of their split) with ``prediction``, once per fit of the split. Fits are sent to the rows as long as
    their size allows (Spark's threshold); beyond it Spark splits the join's skewed partitions."""
    joined = rows.join(fits, "name")
    value = F.col("intercept")
    for i, f in enumerate(features):
        scaled = (F.col(f) - F.get("mean", F.lit(i))) / F.get("scale", F.lit(i))
        value = value + F.coalesce(scaled, F.lit(0.0)) * F.get("weight", F.lit(i))
    return joined.withColumn("prediction", value).drop("intercept", "mean", "scale", "weight")


def scaled_rows(rows: DataFrame, splits: DataFrame, fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """Prediction rows scaled by their split's training statistics (one fit per split), missing as 0."""
    joined = prediction_rows(rows, splits).join(fits.select("name", "mean", "scale"), "name")
    return joined.select("name", "d", "symbol", *[
        F.coalesce((F.col(f) - F.get("mean", F.lit(i))) / F.get("scale", F.lit(i)), F.lit(0.0)).alias(f)
        for i, f in enumerate(features)])


def folds(data: DataFrame, start: str, end: str, last: int | None = None) -> DataFrame:
    """Quarterly validation folds over labelled dates; training must be realised before the fold starts."""
    inside = F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    rows = (data.where(F.col("label").isNotNull() & inside).groupBy(c.quarter_name(F.col("d")).alias("name"))
            .agg(F.min("d").alias("train_cutoff"), F.min("d").alias("prediction_start"), F.max("d").alias("prediction_end")))
    if last is not None:
        rows = (rows.withColumn("_k", F.row_number().over(Window.orderBy(F.col("prediction_start").desc())))
                .where(F.col("_k") <= last).drop("_k"))
    return rows


def purged_split(data: DataFrame, embargo_days: int, share: float = 0.80) -> DataFrame:
    """Add ``part``: fit, embargo or validation by date, with fit rows purged if realised after validation starts."""
    days = data.select("d").distinct()
    gap = embargo_observations(days, embargo_days).first()["observations"]
    placed = days.select("d", (F.row_number().over(Window.orderBy("d")) - 1).alias("pos"),
                         F.count("d").over(Window.partitionBy()).alias("n"))
    start = F.greatest(F.lit(gap + 1), F.least(F.col("n") - 1, F.floor(F.col("n") * share)))
    part = F.when(F.col("pos") >= start, "validation").when(F.col("pos") < start - gap, "fit").otherwise("embargo")
    first = F.min(F.when(F.col("pos") >= start, F.col("d"))).over(Window.partitionBy())
    parts = placed.select("d", part.alias("part"), first.alias("validation_start"))
    rows = data.join(calendar_broadcast(parts), "d")
    late = (F.col("part") == "fit") & (F.col("label_exit_date") >= F.col("validation_start"))
    return rows.withColumn("part", F.when(late, "purged").otherwise(F.col("part")))


def leakage_report(table: DataFrame, prediction_dates: DataFrame, splits: DataFrame, start: str) -> DataFrame:
    """Per split: latest training date and exit, first prediction date, and whether nothing looks ahead."""
    train = (in_training(table, splits, start)
             .groupBy("name").agg(F.max("label_exit_date").alias("max_train_label_exit"), F.max("d").alias("max_train_factor_date"),
                                  F.sum("rows").cast("bigint").alias("train_rows")))
    test = (prediction_rows(prediction_dates.select("d").distinct(), splits)
            .groupBy("name").agg(F.min("d").alias("min_prediction_date"), F.max("d").alias("max_prediction_date")))
    rows = splits.join(train, "name", "left").join(test, "name", "left")
    ok = ((F.col("max_train_label_exit") <= F.col("train_cutoff")) & (F.col("max_train_factor_date") < F.col("min_prediction_date"))
          & (F.col("min_prediction_date") >= F.col("prediction_start")) & (F.col("max_prediction_date") <= F.col("prediction_end")))
    return rows.select("name", "train_cutoff", "max_train_label_exit", "max_train_factor_date", "train_rows",
                       "min_prediction_date", F.coalesce(ok, F.lit(False)).alias("passed"))


def label_audit(labels: DataFrame, prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Recompute every label from the prices at its own dates; check the order of the dates and the empty tail."""
    at_entry = prices.select(F.col("d").alias("label_entry_date"), "symbol", F.col("price").alias("_a"))
    at_exit = prices.select(F.col("d").alias("label_exit_date"), "symbol", F.col("price").alias("_b"))
    known = labels.where("label IS NOT NULL").join(at_entry, ["label_entry_date", "symbol"], "left").join(
        at_exit, ["label_exit_date", "symbol"], "left")
    gap = F.abs(F.col("label") - (F.col("_b") / F.col("_a") - 1))
    last = labels.groupBy("d").agg(F.count("label").alias("known")).agg(F.max_by("known", "d").alias("tail_labels"))
    facts = known.agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(~(gap <= 1e-8), 1)).alias("wrong"),
                      F.count(F.when(F.col("label_entry_date") >= F.col("label_exit_date"), 1)).alias("out_of_order"),
                      F.count(F.when(F.col("d") >= F.col("label_entry_date"), 1)).alias("entered_early"))
    rows = facts.unpivot([], ["checked", "wrong", "out_of_order", "entered_early"], "item", "value")
    return rows.unionByName(last.unpivot([], ["tail_labels"], "item", "value"))


def age_weighted(rows: DataFrame, cutoff) -> DataFrame:
    return rows.withColumn("sample_weight", c.age_weight(F.datediff(F.lit(cutoff).cast("date"), F.col("d"))))
