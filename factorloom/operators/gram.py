"""Moment matrices by aggregation, and the small solves that follow them.

Arrow batches are reduced to one block of sums per group by matrix products inside the task (``block_sums``); blocks are
arrays, added up element by element, so neither the schema nor the plan grows with the number of columns. Solves run on
the driver for a known number of splits, or in tasks for one system per date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def pair_columns(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i:]]


HELD = 4_000_000  # numbers a task gathers before it passes its blocks on


def block_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], build: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(keys, block): the sum over a group's rows of ``build``, which maps a rows x columns matrix (missing is NaN) to a
    vector and must be additive over rows."""
    keys, columns = list(keys), list(columns)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            rows = [(*key, block.tolist()) for key, block in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "block"])

        for batch in batches:
            values = batch[columns].to_numpy(dtype=float, na_value=np.nan)
            for key, at in batch.groupby(keys, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(x.item() if hasattr(x, "item") else x for x in key)
                block = build(values[at])
                held[key] = held[key] + block if key in held else block
                if len(held) * len(block) > HELD:
                    yield out()
        if held:
            yield out()

    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns if c not in keys])
    return added(rows.mapInPandas(run, f"{kinds}, block array<double>"), keys)


def added(df: DataFrame, keys: Sequence[str], how: Callable[[Column], Column] = F.sum, block: str = "block") -> DataFrame:
    """(keys, block): the arrays of a group added up (or averaged) place by place."""
    single = df.select(*keys, F.posexplode(block).alias("_place", "_value")).groupBy(*keys, "_place").agg(how(F.col("_value")).alias("_value"))
    whole = F.array_sort(F.collect_list(F.struct("_place", "_value")))
    return single.groupBy(*keys).agg(F.transform(whole, lambda x: x["_value"]).alias(block))


def second_moments(values: np.ndarray) -> np.ndarray:
    """The number of rows, then the upper triangle of X'X by rows; a missing value counts as 0."""
    x = np.nan_to_num(values, nan=0.0)
    return np.concatenate([[len(x)], (x.T @ x)[np.triu_indices(x.shape[1])]])


def date_moments(standardised: DataFrame, columns: Sequence[str], keys: Sequence[str], least: int) -> DataFrame:
    """(keys, n, moment): X'X/n of each group with more than ``least`` rows."""
    blocks = block_sums(standardised, keys, columns, second_moments)
    n = F.get("block", F.lit(0))
    return blocks.where(n > least).select(*keys, n.cast("long").alias("n"),
                                          F.transform(F.slice("block", 2, F.size("block") - 1), lambda x: x / n).alias("moment"))


def mean_second_moments(standardised: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                        date: str = "d", least: int | None = None) -> DataFrame:
    """(by, a, b, moment, dates): X'X/n per date, averaged over dates with more rows than columns (or than ``least``)."""
    per_date = date_moments(standardised, columns, [*by, date], len(columns) if least is None else least)
    pairs = pair_columns(columns)
    name = lambda side: F.get(F.array(*[F.lit(p[side]) for p in pairs]), F.col("_place"))
    places = per_date.select(*by, F.posexplode("moment").alias("_place", "_value")).groupBy(*by, "_place").agg(
        F.avg("_value").alias("moment"), F.count(F.lit(1)).alias("dates"))
    return places.select(*by, name(0).alias("a"), name(1).alias("b"), "moment", "dates")


def moment_matrix(rows: list, columns: Sequence[str]) -> np.ndarray:
    """Symmetric k*k matrix from (a, b, moment) rows."""
    place = {c: i for i, c in enumerate(columns)}
    out = np.zeros((len(columns), len(columns)))
    for row in rows:
        out[place[row["a"]], place[row["b"]]] = out[place[row["b"]], place[row["a"]]] = row["moment"]
    return out


def normal_sums(columns: Sequence[str], label: str, weight: Column | None = None) -> list[Column]:
    """Aggregates of the weighted normal equations with an intercept named ``one``."""
    w = F.lit(1.0) if weight is None else weight
    names = [*columns, "one"]
    value = {**{c: F.col(c) for c in columns}, "one": F.lit(1.0)}
    gram = [F.sum(value[a] * value[b] * w).alias(f"g_{i}") for i, (a, b) in enumerate(pair_columns(names))]
    rhs = [F.sum(value[a] * F.col(label) * w).alias(f"r_{i}") for i, a in enumerate(names)]
    return [*gram, *rhs, F.sum(w).alias("weight"), F.count(F.lit(1)).alias("rows")]


def normal_system(row, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(X'WX, X'Wy) of one aggregated row; the intercept is last."""
    size = k + 1
    gram = np.zeros((size, size))
    position = 0
    for i in range(size):
        for j in range(i, size):
            gram[i, j] = gram[j, i] = row[f"g_{position}"]
            position += 1
    return gram, np.array([row[f"r_{i}"] for i in range(size)], dtype=float)


def solve_ridge(gram: np.ndarray, rhs: np.ndarray, alpha: float) -> np.ndarray:
    """Least squares with an L2 penalty on all but the intercept; singular systems take the shortest solution."""
    penalty = alpha * np.eye(len(rhs))
    penalty[-1, -1] = 0.0
    return np.linalg.lstsq(gram + penalty, rhs, rcond=None)[0]


def linear_score(columns: Sequence[str], coefficients: Sequence[float], intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for name, weight in zip(columns, coefficients):
        out = out + F.col(name) * F.lit(float(weight))
    return out


def solve_elastic(gram: np.ndarray, rhs: np.ndarray, alpha: float, l1_ratio: float, sweeps: int = 5000,
                  tolerance: float = 1e-10) -> np.ndarray:
    """Minimise b'Gb/2 - r'b + alpha*l1_ratio*|b|_1 + alpha*(1-l1_ratio)*|b|^2/2 one coordinate at a time.

    ``gram`` and ``rhs`` are means over rows of centred columns.
    """
    b = np.zeros(len(rhs))
    soft, ridge = alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(sweeps):
        biggest = 0.0
        for j in range(len(b)):
            if gram[j, j] + ridge <= 0:
                continue
            pull = rhs[j] - gram[j] @ b + gram[j, j] * b[j]
            new = np.sign(pull) * max(abs(pull) - soft, 0.0) / (gram[j, j] + ridge)
            biggest, b[j] = max(biggest, abs(new - b[j])), new
        if biggest < tolerance:
            break
    return b
