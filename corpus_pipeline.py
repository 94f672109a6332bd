"""A corpus pipeline of five stages on the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet in the shared folder and
read again as the next stage's ``docs``. All but the last return the columns of ``documents`` (further columns of the
input go along): quality rules drop what they reject, the n-gram join leaves one document of each group, documents that
hold a benchmark item go, personal data are replaced by their kinds, and mixing adds n_tokens, posterior and rate.

Null texts count as empty and fail the quality rules; an empty table passes through all stages as an empty table; repeated
rows are judged each until the join leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import decontaminate, mixing, ngram_join, pii, quality_rules
from factorloom.llm.common import table
from factorloom.llm.queries import WEIGHTS, domains
from factorloom.session import materialise


def aside(docs: DataFrame, *taken: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that bear a name an operator adds renamed, and the way back."""
    back = {}
    for c in (c for c in taken if c in docs.columns):
        free = c + "_"
        while free in (*docs.columns, *taken, *back):
            free += "_"
        back[free] = c
    return docs.withColumnsRenamed({old: new for new, old in back.items()}), back


def restored(df: DataFrame, docs: DataFrame, back: dict[str, str], *added: str) -> DataFrame:
    return df.drop(*added).withColumnsRenamed(back).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    added = ("counts", "base_failed", "failed_rules", "kept")
    own, back = aside(docs, *added)
    return restored(quality_rules.judge(own, table(spark, sf_dir, "labels")).where("kept"), docs, back, *added)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, back = aside(docs, "leaks")
    found = decontaminate.with_leaks(own, table(spark, sf_dir, "benchmark"))
    return restored(found.where(F.size("leaks") == 0), docs, back, "leaks")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only texts with a finding change; n_chars follows the text."""
    own, back = aside(docs, "base", "spans")
    found, hit = pii.find(own), F.size("spans") > 0
    found = found.withColumn("text", F.when(hit, pii.redacted("text", "spans")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return restored(found, docs, back, "base", "spans")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.with_rates(docs, domains(spark, sf_dir), WEIGHTS)


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("decontamination", benchmark), ("pii", personal_data),
          ("mixing", mix)]

# The stages fit classifiers, search with edits and join by hashes, which SQL can't say; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
