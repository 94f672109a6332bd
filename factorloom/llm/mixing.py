"""Mixing to target weights with soft memberships.

A classifier fitted on labelled documents gives every document a posterior over domains, so a document adds to several
domains. Non-negative rates r (how often to take a document) are fitted so that the expected tokens of each domain,
sum(r * tokens * posterior), match weight * all tokens, by projected gradient descent on the least squares of the k
misfits, weighted by the inverse of the posteriors' second moments; in that weighting a step of one never overshoots, and
the first step is already exact where no rate meets zero. All rates start at one, so they stay near it.

An iteration is one aggregate of k sums over all documents; what reaches the driver, and what goes back, is k numbers. A
document's rate follows from its posterior and those numbers, so no table of rates is rewritten and nothing is joined.

The classifier is fitted on ``sample_rows`` labelled documents at most (those of least hash); everything else covers all
rows. Tokens are words without white space. Null text has no words: its rate is set, and weighs nothing. Repeated rows
are documents of their own; of several labels of a document the first by name counts; labels of unknown domains are left
out. Without two labelled domains the posterior is the labels' share of each domain (alike for all, if none is labelled).
Weights need not sum to one. If the targets can't be met, the rates are those of least misfit.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import packed, text_of, unpacked
from factorloom.session import materialise

SAMPLE_ROWS, FEATURES = 20_000, 4096
MOST_STEPS, CLOSE = 40, 1e-6


def tokens(text: str) -> Column:
    return F.filter(F.split(text_of(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


class Mixer:
    """Posteriors by ``domains`` and the steps that lead to the rates."""

    def __init__(self, domains: list[str], model: PipelineModel | None, shares: list[float]):
        self.domains, self.model, self.shares, self.steps = domains, model, shares, []
        self.misfit: list[float] = []

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with n_tokens and posterior."""
        out = docs.withColumn("words_", tokens(text)).withColumn("n_tokens", F.size("words_").cast("long"))
        if self.model is None:
            return out.withColumn("posterior", F.array(*map(F.lit, self.shares))).drop("words_")
        out = self.model.transform(out).withColumn("posterior", vector_to_array("probability_"))
        return out.drop("words_", "features_", "raw_", "probability_", "prediction_")

    def rate(self) -> Column:
        """The rate of a scored row after all steps."""
        if not self.steps:
            return F.lit(1.0)
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in self.steps])
        return F.aggregate(steps, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - sum(
            (F.col("posterior")[k] * s[k] for k in range(1, len(self.domains))), F.col("posterior")[0] * s[0])))

    def totals(self, scored: DataFrame, rate: Column) -> np.ndarray:
        row = scored.agg(*[F.coalesce(F.sum(rate * F.col("n_tokens") * F.col("posterior")[k]), F.lit(0.0)) for k in range(len(self.domains))])
        return np.array(row.first(), dtype=float)

    def fit(self, scored: DataFrame, weights: dict[str, float]) -> None:
        k = len(self.domains)
        moments = scored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("double"), *[
            F.coalesce(F.sum(F.col("n_tokens") * F.col("posterior")[i] * F.col("posterior")[j]), F.lit(0.0))
            for i in range(k) for j in range(i, k)]).first()
        whole = moments[0]
        if not whole:
            return
        gram, cells = np.zeros((k, k)), iter(moments[1:])
        for i in range(k):
            for j in range(i, k):
                gram[i, j] = gram[j, i] = next(cells) / whole
        inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
        target = np.array([weights.get(d, 0.0) for d in self.domains])
        while len(self.steps) < MOST_STEPS:
            misfit = self.totals(scored, self.rate()) / whole - target
            self.misfit.append(float(np.abs(misfit).max()))
            if self.misfit[-1] < CLOSE or len(self.misfit) > 3 and self.misfit[-1] > self.misfit[-4] * (1 - 1e-4):
                return
            self.steps.append((inverse @ misfit).tolist())


def mixer(docs: DataFrame, labels: DataFrame, domains: list[str], sample_rows: int = SAMPLE_ROWS, features: int = FEATURES,
          text: str = "text") -> Mixer:
    """A classifier of ``domains`` from ``labels`` (doc_id, domain)."""
    named = labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("double") - 1
    sample = (named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
              .select(F.col("doc_id").alias("label_id"), number.alias("label_")))
    hashing = HashingTF(numFeatures=features, binary=True, inputCol="words_", outputCol="features_")
    words = docs.select("doc_id", tokens(text).alias("words_")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    rows = materialise(hashing.transform(words).select("label_", "features_"))
    seen = {r["label_"]: r["count"] for r in rows.groupBy("label_").count().collect()}
    shares = [seen.get(float(k), 0) + 1 for k in range(len(domains))]
    shares = [float(x) / sum(shares) for x in shares]
    if len(seen) < 2:
        return Mixer(domains, None, shares)
    # a domain without labelled documents keeps a column by way of one empty document
    blank = rows.sparkSession.createDataFrame([(float(k), []) for k in range(len(domains)) if float(k) not in seen], "label_ double, words_ array<string>")
    full = rows if len(seen) == len(domains) else rows.unionByName(hashing.transform(blank).select("label_", "features_"))
    model = LogisticRegression(featuresCol="features_", labelCol="label_", rawPredictionCol="raw_", probabilityCol="probability_",
                               predictionCol="prediction_", family="multinomial", regParam=0.003, maxIter=40, tol=1e-5).fit(full)
    return Mixer(domains, PipelineModel([hashing, model]), shares)


def with_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], keep_text: bool = True, **settings) -> DataFrame:
    """``docs`` with n_tokens, posterior (by name of domain) and rate."""
    made = mixer(docs, labels, sorted(weights), **settings)
    scored = made.score(packed(docs), "row_.text")
    if keep_text:
        made.fit(materialise(scored.select("n_tokens", "posterior")), weights)
        return unpacked(scored.withColumn("rate", made.rate()), docs, "n_tokens", "posterior", "rate")
    held = materialise(unpacked(scored, docs.drop("text"), "n_tokens", "posterior"))
    made.fit(held, weights)
    return held.withColumn("rate", made.rate())
