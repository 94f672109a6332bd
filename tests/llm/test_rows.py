"""Operators that work row by row or per conversation, against plain versions."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from factorloom.llm import chat_format, license_scan, pii, quality_rules, token_counts, url_reputation

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "x" * 3000, "word " * 2000, "é日😀 ▁▁ <s></s>\x00 tail", "\u200b\ufeff \u00a0z\x1cq"]


def made(spark, texts, **extra):
    rows = [(i, t, *[v for v in extra.values()]) for i, t in enumerate(texts)]
    kinds = "".join(f", {c} string" for c in extra)
    return spark.createDataFrame(rows, f"doc_id long, text string{kinds}")


def test_token_counts_equal_the_library(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(" ▁ab\néß日😀.,thein²01") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.count_tokens(made(spark, texts, n_tokens="clash"), MODEL, 100).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        want = len(library.encode(text or ""))
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (want, len((text or "").encode()), want > 100)
    assert token_counts.count_tokens(made(spark, []), MODEL, 1).count() == 0


def test_merge_order_is_rank_then_left():
    merger = token_counts.counter(MODEL)
    for word in ("aaaaaaa", "▁▁▁▁▁x", "thethethe", "", "日"):
        assert merger.count(word) == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(word))


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_examples_round_trip(spark):
    nasty = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "s\\"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (1, 3, "user", None), (1, 4, "assistant", "###### \\\\# é😀\n"),
            (2, 0, "user", "only"), (3, 0, "assistant", ""), (None, None, None, "x"), (4, 1, "a: b\\", "</turn>\n### user: "),
            (4, 1, "assistant", "tie b"), (4, 1, "assistant", "tie a"), (4, 1, "assistant", "tie a")]
    rendered = chat_format.render(conversations(spark, rows))
    got = {r.conv_id: r for r in chat_format.digest(rendered).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv])
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = [x for _, r, x in own if r == "assistant"]
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len("".join(loss)), hashlib.sha256("".join(loss).encode()).hexdigest())
        assert row.n_examples == len(loss)
    flat = chat_format.flat_examples(rendered).collect()
    assert sum(len(r.context + r.reply) for r in flat) == sum(r.formatted_chars for r in got.values())
    by = {(r.conv_id, r.target): r for r in flat}
    for ref in chat_format.examples(rendered).collect():
        example = by[ref.conv_id, ref.target]
        stream = example.context + example.reply
        assert (len(stream), len(example.context)) == (ref.length, ref.context_end)
        role, body = chat_format.read_piece(example.reply)
        assert role == "assistant" and len(example.context) + body == ref.loss_start
        assert stream[ref.loss_end:] == chat_format.CLOSE
    assert chat_format.digest(chat_format.render(conversations(spark, []))).count() == 0


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_quality_counts():
    rng = random.Random(3)
    for text in [t for t in ODD if t is not None] + ["".join(rng.choice("ab \n#\t") for _ in range(rng.randint(0, 120))) for _ in range(400)]:
        assert quality_rules.measure(text)[:5] == plain_counts(text)


def test_binomial_tail_is_exact():
    from math import comb
    for n, k, p in ((10, 0, 0.3), (25, 4, 0.2), (40, 40, 0.5), (60, 3, 0.05)):
        assert quality_rules.tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_quality_cutoffs_hold_their_risk(spark):
    rng = random.Random(1)
    good = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(80)) + (" #" if rng.random() < 0.3 else "") for _ in range(900)]
    bad = [" ".join(f"w{rng.randint(0, 9999)}###" for _ in range(80)) for _ in range(100)]
    texts = good + bad + [None, "", "short"]
    docs = made(spark, texts, kept="clash", cut_stratum="clash").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    labels = spark.createDataFrame([(i, int(i < 900), 0) for i in range(1000)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels, risk=0.1).collect()}
    assert len(got) == len(texts) and got[0].cut_stratum == "clash"
    assert sum(not got[i].kept for i in range(900)) <= 90
    assert not any(got[i].kept for i in range(900, 1003))
    few = {r.doc_id: r for r in quality_rules.judge(docs, labels.where("doc_id < 20 OR doc_id > 990"), risk=0.1).collect()}
    assert all(few[i].kept for i in range(1000))  # too few labels certify nothing
    assert quality_rules.judge(docs.where("false"), labels).count() == 0
    assert quality_rules.judge(docs, labels.where("false")).where("kept").count() == 1000


def test_fixed_sequence_stops_at_the_first_failure():
    import pandas as pd
    places = pd.DataFrame({"step": [0, 3, 9, 41], "good": [0, 10, 60, 930], "bad": [40, 20, 30, 10]})
    assert quality_rules.certified(places, 0.05, 0.01, 1.0) == 3  # step 9 would reject 70 of 1000
    assert quality_rules.certified(places, 0.05, 0.01, 5.0) == 0
    assert quality_rules.certified(places, 0.0005, 0.01, 5.0) == -1
    bins = pd.DataFrame({"rule": [0] * 3 + [2], "bin": [0, 10, 50, 7], "good": [960, 40, 0, 1000], "bad": [0, 5, 95, 0]})
    steps = quality_rules.ladder(bins, 1.0)
    assert steps[0] == [10, 100, 100, 100, 100] and steps[16] == [0, 100, 100, 100, 100]
    assert all(x >= y for one, two in zip(steps, steps[1:]) for x, y in zip(one, two))


def test_kept_equals_a_plain_version(spark):
    import pandas as pd
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 9999)}{'#' * (rng.random() < (0.5 if i % 4 == 0 else 0.001))}" for _ in range(rng.randint(45, 80))) for i in range(900)]
    docs = made(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").otherwise("de"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(850)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert got == {r.doc_id: r.kept for r in quality_rules.judge(docs, labels, with_text=False).collect()}
    halves = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)).alias("h")).collect()}
    count = [dict(zip(quality_rules.COUNTS, quality_rules.measure(t))) for t in texts]
    bins = [[min(100, 100 * c[a] // c[b]) if c[b] else 0 for a, b in quality_rules.RULES.values()] for c in count]
    failed = [c["n_words"] < 50 or 2 * c["n_repeat_words"] > c["n_words"] for c in count]
    want, acted = {}, 0
    for rest in ({0}, {1, 2}):
        mine = [i for i in range(900) if i % 3 in rest]
        labelled = [i for i in mine if i < 850 and not failed[i]]
        chosen, held = ([i for i in labelled if halves[i] == h] for h in (0, 1))
        steps, last = [], [100] * 5
        n = sum(i % 4 > 0 for i in chosen)
        for share in quality_rules.LADDER:
            cuts = []
            for r in range(5):
                good = lambda c: sum(bins[i][r] > c and i % 4 > 0 for i in chosen)  # noqa: E731, B023
                cut = min(c for c in range(101) if good(c) <= share * n)
                bad = sum(bins[i][r] > cut and i % 4 == 0 for i in chosen)
                cuts.append(cut if bad > 5 * good(cut) else last[r])
            steps.append(cuts)
            last = cuts
        rejects = lambda i, cuts: any(b > c for b, c in zip(bins[i], cuts))
        best, use, n = 0, [100] * 5, sum(i % 4 > 0 for i in held)
        for cuts in steps:
            g, w = (sum(rejects(i, cuts) for i in held if (i % 4 > 0) == x) for x in (True, False))
            if g >= 0.05 * n or quality_rules.tail(g, n, 0.05) > 0.05 / 2:
                break
            if w - 5 * g > best:
                best, use = w - 5 * g, cuts
        acted += use != [100] * 5
        want |= {i: not failed[i] and not rejects(i, use) for i in mine}
    assert got == want and acted == 2


def test_notices_with_errors(spark):
    texts = ["Licenced undr the GNU Genral Public License, version 3!", "Released UNDER the MIT License. under the mit license", "under the mit licenses",
             "Apache License, Version 2.0; CC-BY-NC", *ODD]
    got = {r.doc_id: r.found for r in license_scan.scan(made(spark, texts, found="clash")).collect()}
    assert (got[0].labels, got[0].base_labels, got[0].notices[0].edits) == ("gpl-3", "", 3) and 0.9 < got[0].score < 1
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 5, "mit")
    assert (got[2].n_base, got[2].first_word) == (0, None)
    assert (got[3].n_base, got[3].base_labels, got[3].first_word, got[3].last_word) == (2, "apache-2,cc-by-nc", 0, 5)
    assert all(got[i].n_base == 0 and got[i].score == 0 for i in range(4, len(texts)))
    assert got[4].n_words == 0 and license_scan.scan(made(spark, [])).count() == 0


def test_seeds_lose_no_notice():
    finder, rng = license_scan.finder(tuple(license_scan.NOTICES.items()), license_scan.ERROR_RATE), random.Random(2)
    for notice, label in license_scan.NOTICES.items():
        for _ in range(6):
            text = list(notice)
            for _ in range(int(len(notice) * license_scan.ERROR_RATE) // 2):
                at = rng.randrange(len(text))
                text[at:at + 1] = rng.choice([[], ["q"], [text[at], "z"]])
            assert label in {x[0] for x in finder.find("some words " + "".join(text) + " more words")}


def test_repeated_notices_are_all_found(spark):
    notice = "licensed under the apache license version 2 0"
    worse = notice.replace("apache", "apoche").replace("version", "versoin")
    texts = [" ".join([notice] * 3000), " ".join([worse] * 1500), f"{worse} {notice.replace('apache', 'apoche')} {notice} {worse}"]
    got = {r.doc_id: [x.edits for x in r.found.notices if x.label == "apache-2"] for r in license_scan.scan(made(spark, texts)).collect()}
    assert got == {0: [0] * 3000, 1: [3] * 1500, 2: [3, 1, 0, 3]}


def test_many_places_of_a_phrase_and_base_columns(spark):
    import time
    rng, words = random.Random(4), "under the mit license apache version 2 cc by nc x CC, é".split()
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(600)] + ["cc by nc " * 60000]
    began = time.time()
    many = license_scan.scan_text(texts[-1], tuple(license_scan.BASE.items()), tuple(license_scan.NOTICES.items()), license_scan.ERROR_RATE)
    assert many[:4] == (180000, 60000, 0, 179997) and time.time() - began < 5
    for text in texts[:-1]:
        plain = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        places = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(plain)) if plain[i:i + len(p.split())] == p.split()]
        got = license_scan.scan_text(text, tuple(license_scan.BASE.items()), tuple(license_scan.NOTICES.items()), license_scan.ERROR_RATE)
        assert got[:5] == (len(plain), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
                           ",".join(sorted({x for _, x in places})))


def test_bad_hosts_with_enough_labels_are_blocked(spark):
    pages, outcomes, n = [], [], 0
    for host, all_, bad in [("a.big.com", 200, 20), ("b.big.com", 150, 15), ("spam.big.com", 20, 18), ("new.big.com", 2, 2), ("none.big.com", 0, 0),
                            *[(f"h{i}.d{i % 7}.net", 30, 3 + i % 3) for i in range(30)], *[(f"x{i}.farm.org", 25, 24) for i in range(6)], ("y.farm.org", 0, 0)]:
        for k in range(all_ + 1):  # the last page has no label
            pages.append((n, f"http://{host}/{k}"))
            if k < all_:
                outcomes.append((n, int(k < bad)))
            n += 1
    got = {r.host: r.verdict for r in url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"),
                                                           spark.createDataFrame(outcomes, "page_id long, bad int"), []).distinct().collect()}
    blocked = {h for h, v in got.items() if v == "block"}
    assert blocked >= {"spam.big.com", *[f"x{i}.farm.org" for i in range(6)]}
    assert not blocked & {"a.big.com", "b.big.com", "new.big.com", "none.big.com", *[f"h{i}.d{i % 7}.net" for i in range(30)]}


def test_beta_probabilities(spark):
    from math import comb
    cases = [(a, b) for a in (1, 2, 7, 40) for b in (1, 3, 25, 400)] + [(3000, 2000)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in cases], "a double, b double")
    for limit in (0.07, 0.5, 0.61):
        got = {(r.a, r.b): r.low for r in url_reputation.with_below(df, "a", "b", limit, "low").collect()}
        for a, b in cases[:-1]:
            n = a + b - 1
            assert got[(a, b)] == pytest.approx(sum(comb(n, i) * limit ** i * (1 - limit) ** (n - i) for i in range(a, n + 1)), rel=1e-9, abs=1e-15)
        assert got[(3000, 2000)] == pytest.approx({0.07: 0.0, 0.5: 0.0, 0.61: 0.9262}[limit], abs=2e-3)


def test_urls_rules_and_reputation(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    urls = ["http://A.Example.ORG/es/x?q", "https://example.org/en/12", "https://example.org", "x://y.org/#f", "http://notexample.org/es/",
            "http://a.com/fr/1", "http://com/de/", "no scheme", None, "", "http://u@h.co.uk:80/p", "http://[::1]:8/p", "http://1.2.3.4/",
            "a://b://c/d", "http://bad.net/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(100 + i, f"http://{'bad' if i % 2 else 'good'}.net/{i}", "x") for i in range(400)],
                                  "page_id long, url string, rule string")
    outcomes = spark.createDataFrame([(100 + i, i % 2) for i in range(400)] + [(101, 0)], "page_id long, bad int")
    got = {r.page_id: r for r in url_reputation.judge(pages, outcomes, rules).collect()}
    assert [got[i].rule for i in range(7)] == ["example.org/es/", "example.org/en/1", None, "org/", "org/", "com/fr/", "com/de/"]
    assert [(got[i].host, got[i].path) for i in (0, 2, 7, 8, 10, 13)] == [("a.example.org", "/es/x"), ("example.org", ""), ("", ""), ("", ""), ("u@h.co.uk:80", "/p"), ("b:", "//c/d")]
    assert got[14].verdict == "block" and got[100].verdict == "allow" and got[8].verdict == "allow"
    levels = {r.host: (r.domain, r.suffix) for r in url_reputation.levels(pages.select(url_reputation.host_of(F.col("url")).alias("host")).distinct()).collect()}
    assert levels["u@h.co.uk:80"] == ("h.co.uk", "co.uk") and levels["1.2.3.4"] == ("1.2.3.4", "") and levels["a.example.org"] == ("example.org", "org")
    assert url_reputation.judge(pages.where("false"), outcomes, rules).count() == 0
    assert {r.verdict for r in url_reputation.judge(pages, outcomes.where("false"), []).collect()} == {"allow"}


def luhn(digits):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_forms(spark):
    rng = random.Random(3)
    texts = ODD + ["a@b.c@d.e", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.0255", "4111 1111 1111 1111 4111-1111-1111-1111",
                   "é😀 a@b.co +1 (988) 555-2485 . +12", "99999999999999999999.1.1.1", "%@a.b..c", "+1 2\n3", "9" * 20000, "a" * 20000 + "@b.c"]
    texts += ["".join(rng.choice("a@.1+ -(4_é2") for _ in range(50)) for _ in range(800)]
    got = {r.doc_id: r.base for r in pii.with_base(made(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert [tuple(s) for s in got[i]] == plain_spans(text or ""), text


def test_pii_seeds_are_whole_spans_with_their_words(spark):
    texts = ["Write to <jane.doe@example.com>, please", "call +1 (988) 555-2485 now", "card 4111 1111 1111 1111 ok",
             "room 12 abc123def 7b end", "a@b.co c@d.eu"]
    seen = pii.occurrences(pii.with_base(made(spark, texts), seeds=True)).collect()
    got = {(r.doc_id, r.instance, r.before, r.after, r.seed) for r in seen}
    assert got == {(0, "jane.doe@example.com", "to", "please", True), (1, "+1 (988) 555-2485", "call", "now", True),
                   (2, "4111 1111 1111 1111", "card", "ok", True), (3, "abc123def", "99", "9b", False),
                   (4, "a@b.co", "", "c@d.eu", True), (4, "c@d.eu", "a@b.co", "", True)}
    assert all(texts[r.doc_id][r.start:r.end] == r.instance for r in seen)
    seeds = {"mail": [f"mail {a}{b}@example.com end" for a in "abc" for b in "xyz"],
             "ring": [f"ring +1 988 555 {i}485 end" for i in range(1, 9)],
             "paid": [f"paid {x} end" for x in ("4111 1111 1111 1111", "4242 4242 4242 4242", "4012 8888 8888 1881", "5555 5555 5555 4444",
                                                "5105 1051 0510 5100", "4000 0566 5566 5556")]}
    for word, known in seeds.items():
        found = pii.find(made(spark, [*known, f"{word} hidden77handle end"])).where(f"doc_id = {len(known)}").first()
        assert [tuple(x) for x in found.spans] == [("context", 5, 19)], word


def test_pii_patterns_find_unseen_identifiers(spark):
    texts = [f"please mail user{i}x@mail{i}.org today" for i in range(30)] + [f"the word {i}abcdef stands" for i in range(30)]
    texts += ["please mail hidden77handle today", None, "", "please mail hidden77handle today"]
    docs = made(spark, texts, spans="clash", base="clash", body_="kept")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(got) == len(texts) and got[0].body_ == "kept"
    for i in (60, 63):
        assert [tuple(s) for s in got[i].spans] == [("context", 12, 26)]
    assert all([s.kind for s in got[i].spans] == ["email"] for i in range(30)) and not any(got[i].spans for i in range(30, 60))
    texts = pii.find(docs.where("doc_id IN (0, 60, 61)")).select("doc_id", pii.redacted("text", "spans").alias("t"))
    assert texts.where("doc_id = 0").first().t == "please mail <EMAIL> today"
    assert pii.find(made(spark, [])).count() == 0


def test_pii_patterns_are_learnt_from_discovered_instances(spark):
    seeds = [f"mail user{i}x@mail{i}.org today" for i in range(20)]
    # the same unknown names stand after "mail" and after "login : name"; other names only after the latter
    both = [t for i in range(8) for t in (f"mail handle{i}77 today", f"login : handle{i}77 end")]
    only = [f"login : hidden{i}99 end" for i in range(2)]
    stop = [f"of {w}" for w in ("123456789", "x@y.org", *["word"] * 30)]
    texts = seeds + both + only + stop
    got = {r.doc_id: r for r in pii.find(made(spark, texts)).collect()}
    spans = lambda i: [texts[i][s.start:s.end] for s in got[i].spans if s.kind == "context"]
    at = len(seeds) + len(both)
    assert [spans(i) for i in (20, at, at + 1)] == [["handle077"], ["hidden099"], ["hidden199"]]
    assert not any(spans(i) for i in range(at + 2, len(texts)))
    one = {r.doc_id: r for r in pii.find(made(spark, texts), rounds=0).collect()}
    assert not one[at].spans[:]


def test_pii_keys_after_key_marks(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'x token = "{key()}" y' for _ in range(8)] + ['z token = "sk-short-17" y', f"commit {key()} of"] + ["of word"] * 9
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans] for r in pii.find(made(spark, texts)).collect()}
    assert all(len(got[i]) == 1 and len(got[i][0]) == 40 for i in range(8)) and got[8] == ["sk-short-17"] and got[9] == []


def test_pii_long_neighbours_and_thousands_of_matches(spark):
    word = "w" * 5000
    texts = [f"{word} a@b.org{' ' * 500}{word}", " ".join(f"id{i:06d}" for i in range(30000)), "9" * 20000]
    seen = pii.occurrences(pii.with_base(made(spark, texts), seeds=True))
    first = seen.where("doc_id = 0").first()
    assert (first.before, first.after) == (word, word)
    rows = seen.where("doc_id = 1").orderBy("start").collect()
    assert len(rows) == 30000 and all(texts[1][r.start:r.end] == r.instance == f"id{i:06d}" for i, r in enumerate(rows))


def test_chat_digest_reads_the_expanded_examples(spark):
    """The examples hold their contexts as text, and the digest fails on texts that are not the expansion's."""
    rows = [(1, k, "assistant" if k % 3 == 1 else "user", f"t{k} \\ </turn>\n### a: <b") for k in range(9)] + [(2, 0, "user", "no reply")]
    rendered = chat_format.render(conversations(spark, rows))
    pieces = {(r.conv_id, r.position): r.piece for r in rendered.collect()}
    written = chat_format.expanded(rendered)
    found = {(r.conv_id, r.position): r for r in written.collect()}
    assert sorted(found) == [(1, 2), (1, 5), (1, 8), (1, 9), (2, 1)]
    for (conv, position), r in found.items():
        assert r.context == "".join(pieces[conv, k] for k in range(1, position)) and r.reply == pieces[conv, position]
        assert r.target == (position if (conv, position) in ((1, 2), (1, 5), (1, 8)) else None)
        if r.target:
            assert chat_format.unescape((r.context + r.reply)[r.loss_start:r.loss_end]) == rows[position - 1][3]
    want = {r.conv_id: r for r in chat_format.read_back(written).collect()}
    assert want[1].n_turns == 9 and want[1].formatted_chars == sum(len(r.context + r.reply) for r in found.values() if r.target)
    at = (F.col("conv_id") == 1) & (F.col("position") == 8)
    for name, broken in (("context", F.replace("context", F.lit("t4"), F.lit("t5"))), ("context", F.lit("")), ("reply", F.replace("reply", F.lit("assistant"), F.lit("user"))),
                         ("loss_start", F.col("loss_start") + 1), ("loss_end", F.col("loss_end") - 1)):
        with pytest.raises(Exception, match="turn|reply"):
            chat_format.read_back(written.withColumn(name, F.when(at, broken).otherwise(F.col(name)))).collect()
