"""Personal data by bootstrapped contextual extraction, in Spark functions only.

Seeds are the spans that fixed forms find (email, ip, card, phone), each one instance, with blanks or without digits too,
and long hexadecimal values, the usual written form of keys. Identifier-like tokens (six characters or more, with a digit)
that meet no span are the other instances. An occurrence's patterns are the word before it, the two words before it, and
the same behind it; digits are written as 9, and marks that adjoin a span are no word (marks that stand alone, as in
``token = "…"``, are). On the graph of patterns and instances, a pattern's score is the summed score of the occurrences of
its instances over all places in the corpus where its words stand, ``doubt`` places added: any word that follows "of" speaks
against "of". An instance's score is 1 for a seed, else the best of its supported patterns. A pattern is supported if the
scores of its different instances add up to ``support``, so instances found in one round support patterns in the next;
this is repeated ``rounds`` times. Supported patterns that reach ``sure`` tag the instances they stand beside as ``context``
spans; hexadecimal values are tagged in the same way only.

Offsets are code points, end exclusive. Null text counts as empty. Neighbouring words are whole, however long; the second
word is looked for up to the end of the neighbouring match. The graph holds each (pattern, instance) once, summed before it
is shuffled, so a common pattern, instance or copied document adds little; patterns with fewer than ``support`` different
instances can never be supported and are left out. Words are counted for the patterns that remain, by a 64-bit hash. Graph and
scores are written to the shared folder. Found spans are joined to documents by doc_id and text hash, so repeated rows and
ids are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import packed, text_of, unpacked
from factorloom.session import materialise

KINDS = ("email", "ip", "card", "phone")
SPACE = r"\x20\x09-\x0D"
LOCAL = "A-Za-z0-9._%+-"
# The same matches as the plain forms, without retrying inside a run: a match starts at its run's start or where the last ended.
FORMS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOKEN = rf"(?<![^{SPACE}])[^0-9{SPACE}]*+[0-9][^{SPACE}]*+"
SPANS = "array<struct<kind:string,start:int,end:int>>"
MARKS = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
# marks that adjoin a match, then up to two words; read backwards for what stands before a match
NEAR = rf"^(?:[{MARKS}]++(?=[{SPACE}]|$))?[{SPACE}]*+([^{SPACE}]*+)(?:[{SPACE}]++([^{SPACE}]++))?"
LITERAL = NEAR.replace("\\", "\\\\")
BESIDE = f"'left', regexp_extract(reverse(concat(x.p, x.g)), '{LITERAL}', 0), 'right', regexp_extract(concat(x.h, x.q), '{LITERAL}', 0)"
KEY = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"
PIECE = 256  # matches whose structs are appended one by one; pieces of them are joined, so a text costs no square


def located(found: str, gaps: str, fields: str, kind: str) -> Column:
    """Structs of ``fields`` (SQL over match m, its place at, the gaps g before and h behind and the matches p and q beyond
    them) for the matches in column ``found``, whose surroundings are in ``gaps``."""
    matches = f"""zip_with({found}, sequence(1, size({found})), (m, i) -> struct(m, element_at({gaps}, i) AS g,
      element_at({gaps}, i + 1) AS h, coalesce(get({found}, i - 2), '') AS p, coalesce(get({found}, i), '') AS q))"""
    piece = f"""aggregate(slice(all_, c * {PIECE} + 1, {PIECE}), named_struct('at', done.at, 'out', cast(array() AS {kind})),
      (acc, x) -> named_struct('at', acc.at + length(x.g) + length(x.m), 'out', concat(acc.out, array({fields}))))"""
    return F.expr(f"""
      flatten(element_at(transform(array({matches}), all_ ->
        aggregate(sequence(0, (size(all_) - 1) div {PIECE}), named_struct('at', 0, 'out', cast(array() AS array<{kind}>)),
          (done, c) -> element_at(transform(array({piece}), r -> named_struct('at', r.at, 'out', concat(done.out, array(r.out)))), 1),
          done -> done.out)), 1))""")


def valid(kind: str) -> str:
    digits = "regexp_replace(x.match, '[^0-9]', '')"
    if kind == "ip":
        return "forall(split(x.match, '[.]'), p -> length(ltrim('0', p)) < 4 AND cast(concat('0', right(ltrim('0', p), 3)) AS int) <= 255)"
    if kind == "card":
        luhn = ("aggregate(sequence(1, length(reverse(d))), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN cast(substr(reverse(d), i, 1) AS int) "
                "ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substr(reverse(d), i, 1) AS int) + 1) END) % 10 = 0")
        return f"length({digits}) BETWEEN 16 AND 19 AND exists(array({digits}), d -> {luhn})"
    if kind == "phone":
        return f"length({digits}) BETWEEN 8 AND 15"
    return "true"


def with_base(docs: DataFrame, text: str = "text", seeds: bool = False) -> DataFrame:
    """``docs`` with ``base``: the spans of the fixed forms by kind, then start; with ``seeds_``, the same with each one's
    match and what stands beside it, if they are asked for."""
    out = docs.withColumn("body_", text_of(text)).withColumn("digits_", F.col("body_").rlike("[0-9]"))
    names = []
    for kind, form in FORMS.items():
        found, gaps = f"found_{kind}_", f"gaps_{kind}_"
        may = F.contains(F.col("body_"), F.lit(NEEDS[kind])) if kind == "email" else F.col("digits_") & F.contains(F.col("body_"), F.lit(NEEDS[kind]))
        out = out.withColumn(found, F.when(may, F.regexp_extract_all("body_", F.lit(form), F.lit(0))).otherwise(F.array().cast("array<string>")))
        out = out.withColumn(gaps, F.when(F.size(found) > 0, F.split("body_", form, -1)).otherwise(F.array().cast("array<string>")))
        fields = f"named_struct('kind', '{kind}', 'start', acc.at + length(x.g), 'end', acc.at + length(x.g) + length(x.m), 'match', x.m"
        fields += f", {BESIDE})" if seeds else ")"
        held = "kind:string,start:int,end:int,match:string" + (",left:string,right:string" if seeds else "")
        all_ = located(found, gaps, fields, f"array<struct<{held}>>")
        out = out.withColumn(f"spans_{kind}_", F.when(F.size(found) > 0, all_))
        names += [found, gaps, f"spans_{kind}_"]
    good = [F.expr(f"filter(coalesce(spans_{k}_, array()), x -> {valid(k)})") for k in KINDS]
    if seeds:
        out = out.withColumn("seeds_", F.concat(*good))
    kept = [F.transform(x, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).cast(SPANS) for x in good]
    return out.withColumn("base", F.concat(*kept)).drop("digits_", "body_", *names)


def masked(text: Column) -> Column:
    return F.translate(F.lower(text), "0123456789", "9" * 10)


def occurrences(based: DataFrame, text: str = "text") -> DataFrame:
    """Base spans and identifier-like tokens that meet none: doc_id, text_hash, instance, start, end, the words before,
    before2, after and after2, seed (a base span), known (a seed's score)."""
    body = text_of(text)
    texts = (based.select("doc_id", F.xxhash64(body).alias("text_hash"), body.alias("body_"), "base", "seeds_")
             .where(F.col("body_").rlike("[0-9]") | (F.size("seeds_") > 0))
             .withColumn("found_", F.regexp_extract_all("body_", F.lit(TOKEN), F.lit(0)))
             .withColumn("gaps_", F.split("body_", TOKEN, -1)))
    held = "array<struct<m:string,start:int,left:string,right:string>>"
    fields = f"named_struct('m', x.m, 'start', acc.at + length(x.g), {BESIDE})"
    tokens = F.when(F.size("found_") > 0, located("found_", "gaps_", fields, held)).otherwise(F.array().cast(held))
    seen = "named_struct('instance', t.{}, 'start', t.start, 'left', t.left, 'right', t.right, 'seed', {})"
    seeds = F.expr(f"transform(seeds_, t -> {seen.format('match', 'true')})")
    others = F.transform(tokens, lambda t: F.struct(t["m"].alias("instance"), t["start"].alias("start"), t["left"].alias("left"),
                                                    t["right"].alias("right"), F.lit(False).alias("seed")))
    core = F.when(F.col("t.seed"), F.col("t.instance")).otherwise(F.regexp_extract("t.instance", r"[A-Za-z0-9+](?:.*[A-Za-z0-9])?", 0))
    placed = (texts.select("doc_id", "text_hash", "base", F.explode(F.concat(seeds, others)).alias("t")).withColumn("instance", core)
              .where("t.seed OR length(instance) >= 6")
              .withColumn("start", F.expr("t.start + locate(instance, t.instance) - 1"))
              .withColumn("end", F.col("start") + F.length("instance"))
              .where("t.seed OR NOT exists(base, b -> b.start < end AND start < b.end)"))
    word = lambda c, k: masked(F.regexp_extract(c, NEAR, k))
    return placed.select(
        "doc_id", "text_hash", "instance", "start", "end", F.reverse(word("t.left", 1)).alias("before"),
        F.reverse(word("t.left", 2)).alias("before2"), word("t.right", 1).alias("after"), word("t.right", 2).alias("after2"),
        F.col("t.seed").alias("seed"), (F.col("t.seed") | F.col("instance").rlike(KEY)).cast("double").alias("known"))


def patterns_of() -> Column:
    """One row per pattern of an occurrence: the side and its one or two words."""
    one = lambda side, c: F.when(F.length(c) > 0, F.concat(F.lit(side), c))
    two = lambda side, a, b: F.when((F.length(a) > 0) & (F.length(b) > 0), F.concat(F.lit(side), a, F.lit(" "), b))
    return F.explode(F.array_compact(F.array(one("<", "before"), two("<", "before2", "before"), one(">", "after"), two(">", "after", "after2"))))


def places(texts: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """words (a hash), total: how often the words of ``patterns`` stand one after another in all texts."""
    wanted = patterns.select(F.xxhash64(F.substring("pattern", 2, 2147483647)).alias("words")).distinct()
    words = texts.select(F.filter(F.split(masked(text_of(text)), rf"[{SPACE}]+"), lambda w: w != "").alias("w"))
    one = F.transform("w", lambda w: F.xxhash64(w))
    two = F.expr("zip_with(w, slice(w, 2, size(w)), (a, b) -> CASE WHEN b IS NOT NULL THEN xxhash64(concat(a, ' ', b)) END)")
    return (words.where(F.size("w") > 0).select(F.explode(F.concat(one, two)).alias("words")).join(wanted, "words", "left_semi")
            .groupBy("words").agg(F.count(F.lit(1)).alias("total")))


def sure_patterns(found: DataFrame, texts: DataFrame, rounds: int, sure: float, support: float, doubt: float,
                  text: str = "text") -> DataFrame:
    """Patterns to trust: column pattern. ``texts``: where words are counted."""
    edges = materialise(found.select("instance", "known", patterns_of().alias("pattern"))
                        .groupBy("pattern", "instance").agg(F.max("known").alias("known"), F.count(F.lit(1)).alias("n")))
    common = materialise(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).where(F.col("kinds") >= support))
    words = F.xxhash64(F.substring("pattern", 2, 2147483647))
    totals = common.withColumn("words", words).join(places(texts, common, text), "words", "left").select(
        "pattern", F.greatest("n", F.coalesce("total", F.lit(0))).alias("total"))
    edges = materialise(edges.join(totals, "pattern"))
    scores = edges.groupBy("instance").agg(F.max("known").alias("score"))
    for last in [False] * rounds + [True]:
        patterns = materialise(edges.join(scores, "instance").groupBy("pattern").agg(
            (F.sum(F.col("score") * F.col("n")) / (F.max("total") + F.lit(doubt))).alias("pattern_score"),
            F.sum("score").alias("weight")).where(F.col("weight") >= support))
        if last:
            return patterns.where(F.col("pattern_score") >= sure).select("pattern")
        scores = materialise(edges.join(patterns, "pattern", "left").groupBy("instance").agg(
            F.greatest(F.max("known"), F.coalesce(F.max("pattern_score"), F.lit(0.0))).alias("score")))


def context_spans(based: DataFrame, text: str = "text", rounds: int = 4, sure: float = 0.8, support: float = 5,
                  doubt: float = 1.0) -> DataFrame:
    """doc_id, text_hash, found: the spans that trusted patterns tag beside the base ones."""
    seen = materialise(occurrences(based, text))
    patterns = sure_patterns(seen, based, rounds, sure, support, doubt, text)
    open_ = seen.where("NOT seed").select("doc_id", "text_hash", "start", "end", patterns_of().alias("pattern"))
    span = F.struct(F.lit("context").alias("kind"), "start", "end")
    return (open_.join(patterns, "pattern", "left_semi").groupBy("doc_id", "text_hash")
            .agg(F.array_sort(F.collect_set(span)).cast(SPANS).alias("found")))


def find(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (all, by kind as listed, context last, then start)."""
    based = with_base(packed(docs), f"row_.{text}", seeds=True)
    more = context_spans(based.select("row_.doc_id", F.col(f"row_.{text}").alias("text"), "base", "seeds_"), **settings).withColumnsRenamed(
        {"doc_id": "found_id", "text_hash": "found_hash"})
    same = F.col("row_.doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash_") == F.col("found_hash"))
    # a text without a digit has no identifier, so only the others are dealt out to meet the found spans
    digits = text_of(f"row_.{text}").rlike("[0-9]")
    based = based.drop("seeds_")
    met = (based.where(digits).withColumn("text_hash_", F.xxhash64(text_of(f"row_.{text}"))).join(more, same, "left")
           .withColumn("spans", F.concat("base", F.coalesce("found", F.array().cast(SPANS)))))
    return unpacked(met, docs, "base", "spans").unionByName(unpacked(based.where(~digits).withColumn("spans", F.col("base")), docs, "base", "spans"))


def written(spans: str) -> Column:
    return F.array_join(F.expr(f"transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end))"), ",")


def redacted(text: str, spans: str) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans by the first's."""
    return F.expr(f"""
      aggregate(
        array_sort(transform({spans}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))),
        named_struct('at', 0, 'out', ''),
        (acc, x) -> named_struct('at', greatest(acc.at, x.end), 'out', CASE WHEN x.start < acc.at THEN acc.out
            ELSE concat(acc.out, substr({text}, acc.at + 1, x.start - acc.at), '<', upper(x.kind), '>') END),
        acc -> concat(acc.out, substr({text}, acc.at + 1)))""")
