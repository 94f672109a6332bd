"""Tree and logistic models from Spark ML."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from factorloom.functions.columns import finite

# Search ranges (low, high, log scale) and the seed.
SEED = 42
SEARCH = {"stepSize": (0.01, 0.05, True), "subsamplingRate": (0.6, 0.95, False)}
SEARCH_DEPTH = (2, 5)
SEARCH_LEAF = (10, 150)
SEARCH_BINS = (128, 256, 512)


def assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Null, NaN and infinite inputs become 0, then one vector column."""
    clean = rows.withColumns({f: F.coalesce(finite(F.col(f).cast("double")), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(clean)


def fit_boosted(train: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None,
                trees: int = 10, depth: int = 3, **params):
    """Boosted regression trees with squared loss."""
    rows = assembled(train.where(finite(F.col(label)).isNotNull()), features)
    model = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=SEED,
                         **{"stepSize": 0.1, "subsamplingRate": 0.75, **params})
    if weight:
        model = model.setWeightCol(weight)
    return model.fit(rows.select("features", label, *([weight] if weight else [])))


def predict(model, rows: DataFrame, features: Sequence[str], name: str = "prediction") -> DataFrame:
    """Score ``rows`` and keep their own columns."""
    kept = rows.select("*", F.struct(*features).alias("_given"))
    scored = model.setPredictionCol(name).transform(assembled(kept, features)).drop("features")
    return scored.withColumns({f: F.col(f"_given.{f}") for f in features}).drop("_given")


def importance_rows(spark, fitted, features: Sequence[str], **tags) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, fitted.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").withColumns(
        {k: F.lit(v) for k, v in tags.items()})


def candidates(count: int, seed: int = SEED) -> list[dict]:
    """Seeded random draws from the search space; the first draw is the default."""
    draw = random.Random(seed)
    out: list[dict] = [{"stepSize": 0.03, "subsamplingRate": 0.75, "depth": 3, "minInstancesPerNode": 10, "maxBins": 256}]
    for _ in range(count - 1):
        low, high, _log = SEARCH["stepSize"]
        out.append({"stepSize": low * (high / low) ** draw.random(),
                    "subsamplingRate": draw.uniform(*SEARCH["subsamplingRate"][:2]), "depth": draw.randint(*SEARCH_DEPTH),
                    "minInstancesPerNode": draw.randint(*SEARCH_LEAF), "maxBins": draw.choice(SEARCH_BINS)})
    return out


def fit_classifier(train: DataFrame, features: Sequence[str], classes: Sequence[str], kind: str, label: str = "best_style",
                   weight: str = "sample_weight", trees: int = 10):
    """Multinomial logistic or random forest over a stated class list (index = place in the list)."""
    index = F.create_map(*[x for i, name in enumerate(classes) for x in (F.lit(name), F.lit(float(i)))])
    rows = assembled(train, features).withColumn("_y", index[F.col(label)])
    if kind == "logistic":
        model = LogisticRegression(featuresCol="features", labelCol="_y", weightCol=weight, maxIter=50, regParam=0.01,
                                   family="multinomial")
    else:
        model = RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol=weight, numTrees=trees, maxDepth=3, seed=SEED)
    return model.fit(rows.select("features", "_y", weight))


def class_weights(model, rows: DataFrame, features: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """(d, style, w): class probabilities as style weights; a class unseen in training gets 0."""
    scored = model.transform(assembled(rows, features)).withColumn("_p", vector_to_array("probability"))
    legs = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)).alias("w"))
                               for i, s in enumerate(classes)]))
    return scored.select("d", legs.alias("leg")).select("d", "leg.style", "leg.w")


