"""Frames several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factorloom.operators import align
from factorloom.session import materialise
from factorloom.sources.derived import Panels

FACTORS = ["f_disc", "f_qty", "f_tax", "f_ret"]


def kept(df: DataFrame) -> DataFrame:
    """Write a calendar-sized result (one row per date and style or model) that feeds several branches."""
    return materialise(df)


def data(p: Panels) -> DataFrame:
    """Factor panel with next-period labels."""
    fx = p.fx()
    return align.dataset(fx, align.labels(p.px(), fx, p.sessions()))


def predictions(p: Panels) -> DataFrame:
    """Two scored models in long form: one by quantity, one by discount (with gaps).

    The labelled panel is written once, as metrics read it along several branches.
    """
    rows = materialise(data(p))
    models = F.explode(F.array(F.struct(F.lit("qty").alias("model"), F.col("f_qty").alias("prediction")),
                               F.struct(F.lit("disc").alias("model"), F.col("f_disc").alias("prediction"))))
    return rows.select("d", "symbol", "label", "label_exit_date", models.alias("m")).select(
        "m.model", "d", "symbol", "label", "label_exit_date", "m.prediction")
