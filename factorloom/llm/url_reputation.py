"""URL filter by rules and an empirical-Bayes reputation of hosts.

A page's outcome is bad if it is labelled so. Counts of labelled pages per host shrink through beta-binomial priors: a
suffix towards all pages, a registered domain towards its suffix, a host towards its domain. The strength of each prior
comes from the spread of the rates around their parent's (analysis of variance within parents). What a group adds to its
parent is left out of its own prior, and a prior weighs no more pages than it was made from, so no label counts twice. A
host is blocked if its odds of bad pages exceed ``odds`` times the overall ones with probability 1 - ``doubt`` at least: the
posterior's beta distribution function, by its continued fraction. Hosts without labels are judged by their prior.

Pages are aggregated per host before anything else, and the hosts' table is joined back on the host, a join that Spark
splits where one host has many pages; the hosts' table is written once, and three rows of totals reach the driver. Rules go before reputation: the longest that
fits (then the first by name) gives the verdict.

A null url, or one without ``://``, has host '' and path '', and '' is a host like any other. Without labels nothing is
known and every page is allowed. Repeated pages are judged each; of several labels of a page the worst counts.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.session import materialise

MOST, LEAST = 1e4, 1.0  # pages that a prior may be worth
# Second-level names under which a country's registry sells domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def levels(hosts: DataFrame) -> DataFrame:
    """``hosts`` with the registered domain and suffix of column host, user and port aside; an address is its own domain."""
    bare = F.regexp_replace(F.regexp_replace("host", r"^[^@]*@", ""), r":[0-9]*$", "")
    deep = F.array_contains(F.array(*map(F.lit, SECOND_LEVEL)), F.element_at("labels", -2)) & (F.length(F.element_at("labels", -1)) == 2)
    keep = F.when((F.size("labels") > 2) & deep, 2).otherwise(1)
    return (hosts.withColumn("bare", bare).withColumn("labels", F.split("bare", r"\."))
            .withColumn("address", F.col("bare").rlike(r"^(\[.*\]|[0-9.]+)?$") | (F.size("labels") < 2)).withColumn("keep", keep)
            .withColumn("domain", F.when(F.col("address"), F.col("bare")).otherwise(
                F.array_join(F.expr("slice(labels, -least(keep + 1, size(labels)), keep + 1)"), ".")))
            .withColumn("suffix", F.when(F.col("address"), "").otherwise(F.array_join(F.expr("slice(labels, -keep, keep)"), ".")))
            .drop("bare", "labels", "address", "keep"))


def spread(level: str, groups: DataFrame, *parent: str) -> DataFrame:
    """One row: the sums that tell how much bad rates of ``groups`` differ within their parents."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    parents = groups.where("n > 0").groupBy(*parent).agg(
        F.sum(n).alias("n"), F.sum(bad).alias("bad"), F.sum(n * n).alias("nn"), F.sum(bad * bad / n).alias("bb"),
        F.count(F.lit(1)).alias("k"))
    return parents.agg(
        F.lit(level).alias("level"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("bb") - F.col("bad") * F.col("bad") / F.col("n")).alias("between"),
        F.sum(F.col("n") - F.col("nn") / F.col("n")).alias("room"), F.sum(F.col("k") - 1).alias("free"),
        F.sum(F.col("bad") - F.col("bb")).alias("inside"), F.sum(F.col("n") - F.col("k")).alias("pages"))


def strength(row) -> float:
    """A prior's strength in pages, from the ratio of mean squares between and inside groups."""
    if not row["free"] or not row["pages"]:
        return MOST
    between, inside = row["between"] / row["free"], row["inside"] / row["pages"]
    whole = between + (row["room"] / row["free"] - 1) * inside
    likeness = (between - inside) / whole if whole > 0 else 0.0
    return MOST if likeness <= 0 else min(MOST, max(LEAST, (1 - likeness) / likeness))


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, and down again; x above 0."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7)
    down = F.ln(x)
    for i in range(1, 8):
        down = down + F.ln(x + i)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - down


def with_below(df: DataFrame, a: str, b: str, limit: float, name: str) -> DataFrame:
    """``df`` with the probability that a beta(a, b) value lies at or below ``limit`` (strictly inside 0 and 1).

    The continued fraction is taken from its far end; its terms needed grow with the root of the larger parameter.
    """
    flip = F.lit(limit) >= (F.col(a) + 1) / (F.col(a) + F.col(b) + 2)
    out = (df.withColumn("p_", F.when(flip, F.col(b)).otherwise(F.col(a))).withColumn("q_", F.when(flip, F.col(a)).otherwise(F.col(b)))
           .withColumn("x_", F.when(flip, F.lit(1 - limit)).otherwise(F.lit(limit)))
           .withColumn("last_", (F.lit(30) + 4 * F.sqrt(F.greatest("p_", "q_"))).cast("int")))
    fraction = F.expr("""aggregate(sequence(last_, 0, -1), 1D, (t, m) ->
        1 - (p_ + m) * (p_ + q_ + m) * x_ / ((p_ + 2 * m) * (p_ + 2 * m + 1))
            / (1 + (m + 1) * (q_ - m - 1) * x_ / ((p_ + 2 * m + 1) * (p_ + 2 * m + 2)) / t))""")
    p, q, x = F.col("p_"), F.col("q_"), F.col("x_")
    front = F.exp(p * F.ln(x) + q * F.ln(1 - x) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
    low = front / fraction
    return out.withColumn(name, F.when(flip, 1 - low).otherwise(low)).drop("p_", "q_", "x_", "last_")


def reputation(pages: DataFrame, outcomes: DataFrame, odds: float, doubt: float) -> DataFrame:
    """One row per host of ``pages`` (page_id, host): host, blocked. ``outcomes``: page_id, bad (0 or 1)."""
    marks = outcomes.groupBy(F.col("page_id").alias("label_id")).agg(F.max("bad").alias("bad"))
    hosts = materialise(levels(pages.join(marks, F.col("page_id") == F.col("label_id"), "left")
                               .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rows = {r["level"]: r for r in spread("host", hosts, "domain", "suffix").unionByName(spread("domain", domains, "suffix"))
            .unionByName(spread("suffix", suffixes)).collect()}
    by_host, by_domain, by_suffix = (strength(rows[k]) for k in ("host", "domain", "suffix"))
    n = rows["suffix"]["n"] or 0.0
    overall = rows["suffix"]["bad"] / n if n else 0.0
    limit = overall * odds / (1 - overall + overall * odds)
    if not 0 < limit < 1:  # nothing is bad, or everything
        return hosts.select("host", F.lit(False).alias("blocked"))

    def prior(rate, weight, n, bad, cap):
        """What a parent says without the group's own pages: rate and weight."""
        pages_ = n + weight
        return (bad + weight * rate) / pages_, F.least(F.lit(cap), pages_)

    total = lambda name, one: F.col(f"{name}_{one}").cast("double")
    named = lambda df, name: df.withColumnsRenamed({"n": f"{name}_n", "bad": f"{name}_bad"})
    joined = named(hosts, "host").join(named(domains, "domain"), ["domain", "suffix"]).join(named(suffixes, "suffix"), "suffix")
    rate, weight = prior(F.lit(overall), F.lit(min(by_suffix, max(n, LEAST))), total("suffix", "n") - total("domain", "n"),
                         total("suffix", "bad") - total("domain", "bad"), by_domain)
    joined = joined.withColumn("rate_", rate).withColumn("weight_", weight)
    rate, weight = prior(F.col("rate_"), F.col("weight_"), total("domain", "n") - total("host", "n"),
                         total("domain", "bad") - total("host", "bad"), by_host)
    joined = joined.withColumn("host_rate_", rate).withColumn("host_weight_", weight)
    joined = (joined.withColumn("a_", total("host", "bad") + F.col("host_weight_") * F.col("host_rate_"))
              .withColumn("b_", total("host", "n") - total("host", "bad") + F.col("host_weight_") * (1 - F.col("host_rate_")))
              .withColumn("sound_", (F.col("a_") > 0) & (F.col("b_") > 0)))
    inside = with_below(joined.withColumn("in_a_", F.when(F.col("sound_"), F.col("a_")).otherwise(1.0))
                        .withColumn("in_b_", F.when(F.col("sound_"), F.col("b_")).otherwise(1.0)), "in_a_", "in_b_", limit, "below_")
    blocked = F.when(F.col("a_") <= 0, False).when(F.col("b_") <= 0, True).otherwise(F.col("below_") <= doubt)
    return inside.select("host", blocked.alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], odds: float = 2.0, doubt: float = 0.1,
          url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict per page. ``rules``: (host/path, allow or block)."""
    parted = pages.select("page_id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = reputation(parted, outcomes, odds, doubt).withColumnRenamed("host", "known_host")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("blocked"), "block").otherwise("allow")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=True)[::-1]:
        at, _, path = name.partition("/")
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return parted.join(known, F.col("host") == F.col("known_host"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
