"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import (chat_format, decontaminate, hard_negatives, license_scan, line_dedup, merkle, mixing, ngram_join, pii,
                            quality_rules, substring_dedup, token_counts, url_reputation)
from factorloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn
    return add


@query()
def op1_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.duplicates(table(spark, folder, "documents").select("doc_id", "text"))


PROBE = r"\### Assistant: </turn> ok"


@query(r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
               UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, 14 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:'))
                 + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS size FROM turns),
placed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(stop) FILTER (role = 'assistant'), 0) AS bigint) AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM placed GROUP BY conv_id""")
def op2_prefix_target(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.render(turns.unionByName(probe)))


@query()
def op3_edit_matching(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.with_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query()
def op4_risk_controlled(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents").select("doc_id", "text", "lang"), table(spark, folder, "labels"),
                                 with_text=False)
    return judged.select("doc_id", *[F.col(f"counts.{c}").alias(c) for c in quality_rules.COUNTS[:5]], "base_failed", "kept",
                         F.array_join("failed_rules", ",").alias("failed_rules"))


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query(r"""
WITH parted AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
          WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM parted LEFT JOIN marks ON page_id = doc_id GROUP BY host),
cut AS (SELECT *, regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', '') AS bare FROM counted),
labelled AS (SELECT *, string_split(bare, '.') AS l, regexp_matches(bare, '^(\[.*\]|[0-9.]+)?$') OR len(string_split(bare, '.')) < 2 AS address FROM cut),
kept AS (SELECT *, CASE WHEN len(l) > 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND length(l[-1]) = 2 THEN 2 ELSE 1 END AS k FROM labelled),
hosts AS (SELECT host, n, bad, CASE WHEN address THEN bare ELSE array_to_string(l[greatest(len(l) - k, 1):], '.') END AS domain,
                 CASE WHEN address THEN '' ELSE array_to_string(l[len(l) - k + 1:], '.') END AS suffix FROM kept),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
every AS (SELECT 's' AS level, '' AS parent, n, bad FROM suffixes UNION ALL SELECT 'd', suffix, n, bad FROM domains
          UNION ALL SELECT 'h', domain || '/' || suffix, n, bad FROM hosts),
parents AS (SELECT level, CAST(sum(n) AS double) AS n, CAST(sum(bad) AS double) AS bad, CAST(sum(n * n) AS double) AS nn,
                   sum(CAST(bad AS double) * bad / n) AS bb, count(*) AS k FROM every WHERE n > 0 GROUP BY level, parent),
sums AS (SELECT level, sum(n) AS n, sum(bad) AS bad, sum(bb - bad * bad / n) AS between_, sum(n - nn / n) AS room, sum(k - 1) AS free,
                sum(bad - bb) AS inside, sum(n - k) AS pages FROM parents GROUP BY level),
likes AS (SELECT *, CASE WHEN free > 0 AND pages > 0 AND between_ / free + (room / free - 1) * inside / pages > 0
                         THEN (between_ / free - inside / pages) / (between_ / free + (room / free - 1) * inside / pages) ELSE 0 END AS r FROM sums),
priors AS (SELECT max(CASE WHEN level = 's' THEN bad / n END) AS p, max(n) AS all_n, max(CASE WHEN level = 's' THEN w END) AS s,
                  max(CASE WHEN level = 'd' THEN w END) AS d, max(CASE WHEN level = 'h' THEN w END) AS h
           FROM (SELECT level, n, bad, CASE WHEN r <= 0 THEN 1e4 ELSE least(1e4, greatest(1.0, (1 - r) / r)) END AS w FROM likes)),
limits AS (SELECT *, p * 2.0 / (1 - p + p * 2.0) AS x, least(s, greatest(all_n, 1.0)) AS ws FROM priors),
first AS (SELECT host, hosts.n, hosts.bad, domains.n AS dn, domains.bad AS db, x, h, suffixes.n - domains.n + ws AS sp,
                 (suffixes.bad - domains.bad + ws * p) / (suffixes.n - domains.n + ws) AS rate, d
          FROM hosts JOIN domains USING (domain, suffix) JOIN suffixes USING (suffix), limits),
second AS (SELECT *, dn - n + least(d, sp) AS dp, (db - bad + least(d, sp) * rate) / (dn - n + least(d, sp)) AS host_rate FROM first),
beta AS (SELECT host, x, bad + least(h, dp) * host_rate AS a, n - bad + least(h, dp) * (1 - host_rate) AS b FROM second),
turned AS (SELECT *, x >= (a + 1) / (a + b + 2) AS flip, a > 0 AND b > 0 AND x > 0 AND x < 1 AS sound FROM beta),
sides AS (SELECT *, CASE WHEN NOT sound THEN 1 WHEN flip THEN b ELSE a END AS p, CASE WHEN NOT sound THEN 1 WHEN flip THEN a ELSE b END AS q,
                 CASE WHEN NOT sound THEN 0.5 WHEN flip THEN 1 - x ELSE x END AS y FROM turned),
terms AS (SELECT sides.*, m FROM sides, LATERAL (SELECT unnest(range(CAST(floor(30 + 4 * sqrt(greatest(p, q))) AS bigint) + 1)) AS m)),
fractions AS (SELECT host, any_value(a) AS a, any_value(b) AS b, any_value(x) AS x, any_value(flip) AS flip, any_value(sound) AS sound,
                     any_value(p) AS p, any_value(q) AS q, any_value(y) AS y,
                     list({'u': (p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
                           'v': (m + 1) * (q - m - 1) * y / ((p + 2 * m + 1) * (p + 2 * m + 2)), 't': 1.0::double} ORDER BY m DESC) AS l
              FROM terms GROUP BY host),
below AS (SELECT *, exp(p * ln(y) + q * ln(1 - y) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p
                 / list_reduce(list_prepend({'u': 0.0::double, 'v': 0.0::double, 't': 1.0::double}, l),
                               lambda g, f: {'u': 0.0::double, 'v': 0.0::double, 't': 1 - f.u / (1 + f.v / g.t)}).t AS low FROM fractions),
blocked AS (SELECT host, CASE WHEN x <= 0 OR x >= 1 OR a <= 0 THEN false WHEN b <= 0 THEN true
                              ELSE (CASE WHEN flip THEN 1 - low ELSE low END) <= 0.1 END AS blocked FROM below),
ruled AS (SELECT page_id, parted.host, path, blocked, CASE
    WHEN (parted.host = 'example.org' OR parted.host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (parted.host = 'example.org' OR parted.host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (parted.host = 'com' OR parted.host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (parted.host = 'com' OR parted.host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (parted.host = 'org' OR parted.host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parted LEFT JOIN blocked ON parted.host = blocked.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN blocked THEN 'block' ELSE 'allow' END AS verdict FROM ruled""")
def op5_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = table(spark, folder, "labels").where("quality IS NOT NULL OR toxic IS NOT NULL").select(
        F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return url_reputation.judge(table(spark, folder, "pages"), outcomes, URL_RULES)


@query()
def op6_contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


@query()
def op7_forest_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents").select("doc_id", "text"))


WEIGHTS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}


def domains(spark: SparkSession, folder: str) -> DataFrame:
    """The domain that the labels put a document in."""
    return table(spark, folder, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
                                                 .when(F.col("quality") == 0, "poor").alias("domain"))


@query()
def op8_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.with_rates(table(spark, folder, "documents").select("doc_id", "text"), domains(spark, folder), WEIGHTS, keep_text=False)
    return mixed.select("doc_id", "n_tokens", *[F.round(F.col("posterior")[k], 9).alias(f"p_{d}") for k, d in enumerate(sorted(WEIGHTS))],
                        "rate")


@query()
def op9_merge_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents").select("doc_id", "text"),
                                        public_tokenizers.path("piece_bpe_32k.model"), 4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query()
def op10_notice_search(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"found.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels",
                                                           "labels", "score", "notices")])


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@query(r"""
WITH RECURSIVE
-- fixed values: the sixteen entries of the CRC-32 table by half bytes
crc(t) AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
                   3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]),
own AS (SELECT row_number() OVER () AS row_no, * FROM documents),
checked AS (SELECT *, CASE WHEN doc_id IS NULL THEN NULL ELSE xor(CAST(4294967295 AS bigint), list_reduce(
    list_prepend(CAST(4294967295 AS bigint), flatten(list_transform(string_split(CAST(doc_id AS varchar), ''),
                 lambda c: [CAST(ord(c) AS bigint) & 15, CAST(ord(c) AS bigint) >> 4]))),
    lambda s, x: xor(CAST(t[CAST((xor(s, x) & 15) + 1 AS int)] AS bigint), s >> 4))) END AS crc32 FROM own, crc),
parts AS (SELECT *, coalesce(octet_length(encode(CAST(doc_id AS varchar))) || ':' || doc_id, '-')
       || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
       || coalesce(octet_length(encode(CAST(n_chars AS varchar))) || ':' || n_chars, '-') AS head,
       CASE WHEN crc32 % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM checked),
leaves AS (SELECT row_no, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                  sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS claim FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS place,
                  count(*) OVER (PARTITION BY source) AS n FROM leaves),
low AS (SELECT 0 AS level, source, place, n, leaf AS h FROM placed
        UNION ALL SELECT level + 1, source, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM low
        WHERE n > 1 GROUP BY level, source, place // 3, n),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS level, place, n, subroot AS h FROM subs
         UNION ALL SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM high
         WHERE n > 1 GROUP BY level, place // 3, n),
nodes AS (SELECT level, coalesce('s' || source, '') AS tree, place, n, h FROM low UNION ALL SELECT 1000 + level, 'top', place, n, h FROM high),
runs AS (SELECT level, tree, place // 3 AS run, string_agg(h, '' ORDER BY place) FILTER (place % 3 < 1) AS a,
                string_agg(h, '' ORDER BY place) FILTER (place % 3 = 1) AS b, string_agg(h, '' ORDER BY place) FILTER (place % 3 = 2) AS c
         FROM nodes WHERE n > 1 GROUP BY level, tree, place // 3),
ways AS (SELECT row_no, level, tree, place, place AS pos, n, claim AS h, '' AS proof, placed.source AS src FROM placed
         JOIN (SELECT DISTINCT level, tree FROM nodes WHERE level = 0) z ON z.tree = coalesce('s' || placed.source, '')
         UNION ALL
         SELECT row_no, ways.level + 1, ways.tree, ways.place // 3, ways.place // 3, (n + 2) // 3,
                sha256(CASE ways.place % 3 WHEN 0 THEN h || coalesce(b, '') || coalesce(c, '') WHEN 1 THEN a || h || coalesce(c, '') ELSE a || b || h END),
                proof || CASE ways.place % 3 WHEN 0 THEN coalesce(b, '') || coalesce(c, '') WHEN 1 THEN a || coalesce(c, '') ELSE a || b END, src
         FROM ways JOIN runs ON runs.level = ways.level AND runs.tree = ways.tree AND run = ways.place // 3 WHERE n > 1),
grown AS (SELECT row_no, 1000 AS level, subs.place, subs.n, h, proof, subroot FROM ways JOIN subs ON subs.source IS NOT DISTINCT FROM src WHERE ways.n = 1
          UNION ALL
          SELECT row_no, grown.level + 1, grown.place // 3, (n + 2) // 3,
                 sha256(CASE grown.place % 3 WHEN 0 THEN h || coalesce(b, '') || coalesce(c, '') WHEN 1 THEN a || h || coalesce(c, '') ELSE a || b || h END),
                 proof || CASE grown.place % 3 WHEN 0 THEN coalesce(b, '') || coalesce(c, '') WHEN 1 THEN a || coalesce(c, '') ELSE a || b END, subroot
          FROM grown JOIN runs ON runs.level = grown.level AND runs.tree = 'top' AND run = grown.place // 3 WHERE n > 1),
whole AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM placed JOIN grown USING (row_no), whole WHERE grown.n = 1""")
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(*LEAF_FIELDS)
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    head = [F.col(c) for c in LEAF_FIELDS[:-1]]
    leaves = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), F.col("doc_id").cast("string").alias("id"),
                         merkle.digest_of(*head, F.col("text")).alias("leaf"), merkle.digest_of(*head, other).alias("claim"))
    found = merkle.proofs(merkle.build(leaves))
    return found.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query(r"""
WITH valid AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS double)) AS bigint)) AS v FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT a.id AS anchor, a.label AS label, b.id AS id, b.label AS other,
                  CAST(list_sum(list_transform(generate_series(1, len(a.v)), lambda k: a.v[k] * b.v[k])) AS bigint) AS score
           FROM valid a JOIN valid b ON a.id % 50 = 0 AND a.id <> b.id),
pos AS (SELECT anchor, label, id, score FROM scored WHERE label = other
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS int) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON n.anchor = p.anchor AND n.other <> p.label AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) <= 3""")
def op12_zone_mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    return hard_negatives.mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector")), F.col("id") % 50 == 0)


@query(r"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT row_no, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT row_no, doc_id, line, pos, coalesce(doc_id <> first, false) AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id""")
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_repeated(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))
