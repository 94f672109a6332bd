"""Quality rules with risk-controlled thresholds.

Signals of a text are rates for which more is worse. Labelled documents are parted in two by a hash of doc_id. On the
chosen part a ladder of cutoffs is laid per stratum: step k holds, for every rule, the strictest cutoff that rejects at
most ``LADDER[k]`` of the good documents, if it rejects bad ones worth more than ``price`` times the good ones (else the cutoff
of the step before). Steps are nested, so a document has one place on the ladder: the first step at which any rule rejects
it. The held-out part certifies steps from the loosest on: while the exact binomial (Clopper-Pearson) upper bound of the
false rejections of all rules together lies within ``risk``. The first step that is not certified ends the sequence, so the
steps need no correction among themselves; the confidence is shared out over the strata (Bonferroni). Of the certified
steps the one that rejects the most labelled bad documents, less ``price`` times the good ones, is used; a stratum with too
few labels has none, and there only the base rules reject.

Counts per (stratum, rule, bin) and (stratum, step) are summed over all labelled documents before anything is shuffled.
Null text has no words; a null stratum is the stratum ''. Repeated documents are judged each; a label counts
once per (doc_id, label) pair and per copy of its document. Labels that are null are left out. An empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import WORD, packed, text_of, unpacked
from factorloom.session import materialise

SYMBOLS, CAPITALS, MARKS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?|"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
RULES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
         "capitals": ("n_capitals", "word_chars"), "marks": ("n_marks", "n_words")}
BINS = 100  # cutoffs are hundredths; a rate of 1 or more has the last bin
BROADCAST_ROWS = 100_000
LADDER = tuple(k / 400 for k in range(41))  # shares of good documents, 0 to a tenth


def measure(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    raw = text.encode()
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        again = Counter(windows)
        if len(again) < len(windows):
            reach = 0  # first position that no counted window covers
            for i, w in enumerate(windows):
                if again[w] > 1:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    return (len(words), sum(map(len, words)), without(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines),
            without(CAPITALS), without(MARKS))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``counts``."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(x) for x in texts], columns=COUNTS, dtype="int64")

    return docs.withColumn("counts", counts(text_of(text)))


def base_failed(counts: str = "counts") -> Column:
    c = F.col(counts)
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def bin_of(rule: str, counts: str = "counts") -> Column:
    above, below = (F.col(counts)[c] for c in RULES[rule])
    return F.when(below > 0, F.least(F.expr(f"{BINS}L * {counts}.{RULES[rule][0]} div {counts}.{RULES[rule][1]}"), F.lit(BINS))).otherwise(
        F.lit(0)).cast("int")


def tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) at rate p; k below n * p, so that terms fall from k down."""
    if k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return total


def ladder(bins: pd.DataFrame, price: float) -> list[list[int]]:
    """Per step, a cutoff for every rule: bins above it are rejected; BINS rejects nothing."""
    steps = [[BINS] * len(RULES) for _ in LADDER]
    for rule, rows in bins.groupby("rule"):
        good, bad = [0] * (BINS + 1), [0] * (BINS + 1)
        for b, g, w in zip(rows["bin"], rows["good"], rows["bad"]):
            good[b], bad[b] = int(g), int(w)
        n, cutoff, above_good, above_bad, last = sum(good), BINS, 0, 0, BINS
        for step, share in enumerate(LADDER):
            while cutoff > 0 and above_good + good[cutoff] <= share * n:
                above_good += good[cutoff]
                above_bad += bad[cutoff]
                cutoff -= 1
            if n and above_bad > price * above_good:
                last = cutoff
            steps[step][rule] = last
    return steps


def certified(places: pd.DataFrame, risk: float, confidence: float, price: float) -> int:
    """The step to use, from good and bad documents per first rejecting step; -1 for none."""
    good, bad = [0] * (len(LADDER) + 1), [0] * (len(LADDER) + 1)
    for s, g, w in zip(places["step"], places["good"], places["bad"]):
        good[s], bad[s] = int(g), int(w)
    n, best, found = sum(good), 0.0, -1
    rejected_good = rejected_bad = 0
    for step in range(len(LADDER)):
        rejected_good += good[step]
        rejected_bad += bad[step]
        if rejected_good >= risk * n or tail(rejected_good, n, risk) > confidence:
            break
        if rejected_bad - price * rejected_good > best:
            best, found = rejected_bad - price * rejected_good, step
    return found


def fit(counted: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, confidence: float = 0.05,
        price: float = 5.0) -> DataFrame:
    """One row per stratum with a cutoff in force: stratum, and a column per rule with its cutoff in hundredths."""
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("good")).where(
        "label_id IS NOT NULL AND good IN (0, 1)").distinct()
    rows = counted.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                          F.array(*[bin_of(r) for r in RULES]).alias("bins"), base_failed().alias("failed"))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)) == 1
    rows = materialise(rows.where("NOT failed").join(marked, F.col("doc_id") == F.col("label_id")).select(
        "stratum", "bins", "good", held_out.alias("held_out")))
    sums = [F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")]
    bins = (rows.where("NOT held_out").select("stratum", "good", F.posexplode("bins").alias("rule", "bin"))
            .groupBy("stratum", "rule", "bin").agg(*sums))

    def lay(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stratum": group["stratum"].iloc[:1], "ladder": [ladder(group, price)]})

    ladders = materialise(bins.groupBy("stratum").applyInPandas(lay, "stratum string, ladder array<array<int>>"))
    rejects = "exists(zip_with(bins, cuts, (b, c) -> b > c), x -> x)"
    places = (rows.where("held_out").join(ladders, "stratum")
              .withColumn("step", F.expr(f"size(filter(ladder, cuts -> NOT {rejects}))"))
              .groupBy("stratum", "step").agg(*sums))
    every = Window.partitionBy(F.lit(0))  # over one row per stratum
    strata = ladders.select("stratum", "ladder", F.count(F.lit(1)).over(every).alias("strata"))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        step = certified(group, risk, confidence / int(group["strata"].iloc[0]), price)
        return pd.DataFrame({"stratum": group["stratum"].iloc[:1], "step": [step]})

    picked = places.join(strata.select("stratum", "strata"), "stratum").groupBy("stratum").applyInPandas(pick, "stratum string, step int")
    cuts = picked.where("step >= 0").join(ladders, "stratum").select("stratum", F.element_at("ladder", F.col("step") + 1).alias("cuts"))
    return cuts.select("stratum", *[F.col("cuts")[i].alias(f"cut_{r}") for i, r in enumerate(RULES)])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, confidence: float = 0.05,
          price: float = 5.0, with_text: bool = True) -> DataFrame:
    """``docs`` with ``counts``, ``base_failed``, ``failed_rules`` and ``kept``; without its text, if it is not wanted, and
    then each text is measured once."""
    counted = with_counts(packed(docs), "row_.text")
    if not with_text:
        docs = docs.drop("text")
        counted = materialise(counted.select(F.struct(*[F.col(f"row_.`{c}`") for c in docs.columns]).alias("row_"), "counts"))
    fitted = counted.select(F.col("row_.doc_id").alias("doc_id"), F.col(f"row_.{stratum}").alias("stratum_"), "counts")
    cutoffs = fit(fitted, labels, "stratum_", risk, confidence, price).withColumnRenamed("stratum", "cut_stratum")
    held = docs.sparkSession.createDataFrame(
        cutoffs.limit(BROADCAST_ROWS + 1).toArrow(), cutoffs.schema)  # a row per language; beyond the bound it is joined as it is
    cutoffs = F.broadcast(held) if held.count() <= BROADCAST_ROWS else cutoffs
    key = F.coalesce(F.col(f"row_.{stratum}").cast("string"), F.lit(""))
    joined = counted.join(cutoffs, key == F.col("cut_stratum"), "left")
    failed = F.filter(F.array(*[F.when(bin_of(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    judged = (joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
              .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))
    return unpacked(judged, docs, "counts", "base_failed", "failed_rules", "kept")
