"""Line dedup, Merkle manifest and hard negatives against plain versions."""

import hashlib
import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import hard_negatives, line_dedup, merkle


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


# line dedup

def plain_dedup(rows, min_chars=10):
    last = 1 << 70
    held = {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(last if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < 2 or min(held[key(x)]) == (last if doc_id is None else doc_id)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def dedup_rows():
    rng = random.Random(3)
    common = ["A common footer line", "  a COMMON footer line\t", "short", "ÄÖÜ äöü ß 10", "äöü", "x" * 9, "y" * 10, "\x0b" + "y" * 10]
    rows = [(k, "\n".join(rng.choice(common) if rng.random() < 0.5 else f"own line {rng.randrange(60)} of it" for _ in range(rng.randrange(9))))
            for k in range(80)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (None, "y" * 10 + "\nA common footer line"), (None, "A common footer line"), (5, rows[5][1]),
                   (203, "only here, only here\n" * 4), (204, "\n".join(f"line number {k} of a very long text" for k in range(30_000))),
                   (205, "line number 77 of a very long text\n" * 3 + "é" * 10_000), (206, "É" * 10_000 + "\n" + "é" * 10_000)]


@pytest.mark.parametrize("bits", [1 << 9, 1 << 30])  # full filters make false suspects only
def test_line_dedup_equals_plain(spark, bits):
    rows = dedup_rows()
    docs = table(spark, [(a, b, "k", 7) for a, b in rows], ", kept string, n_lines long").repartition(5)
    got = line_dedup.drop_repeated(docs, max_bits=bits)
    assert got.columns == ["doc_id", "text", "kept", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == plain_dedup(rows)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_repeated(table(spark, [])).collect() == []


def test_filters_lose_no_repeat():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    one, two = line_dedup.Seen(1 << 16, 3), line_dedup.Seen(1 << 16, 3)
    one.add(h[:2500])
    two.add(np.concatenate([h[2000:], h[3900:]]))
    twice = one.twice | two.twice | (one.once & two.once)
    hit = line_dedup.has(twice, line_dedup.places(h, 1 << 16, 3))
    assert hit[2000:2500].all() and hit[3900:].all() and hit[:2000].mean() < 0.1


# Merkle manifest

def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(leaves):
    """Levels of nodes, and for every leaf its siblings from the left, by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 3])) for k in range(0, len(levels[-1]), 3)])
    ways = []
    for k in range(len(leaves)):
        way = []
        for row in levels[:-1]:
            first = k - k % 3
            way.append((row[first:k], row[k + 1:first + 3]))
            k //= 3
        ways.append(way)
    return levels[-1][0], ways


def plain_proofs(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[3]))
    groups = [(g, list(part)) for g, part in groupby(order, key=lambda r: r[0])]
    trees = [plain_tree([r[3] for r in part]) for _, part in groups]
    root, over = plain_tree([t[0] for t in trees])
    out = []
    for (_, part), (subroot, ways), up in zip(groups, trees, over):
        for (_, _, name, leaf, claim), way in zip(part, ways):
            fold = claim
            for left, right in way + up:
                fold = sha("".join([*left, fold, *right]))
            each = [x for left, right in way + up for x in left + right]
            out.append((name, leaf, subroot, root, sha("".join(each)), fold, fold == root, each))
    return sorted(out)


def merkle_rows(n):
    rng = random.Random(n)
    rows = []
    for k in range(n):
        leaf = sha(str(k))
        rows.append((rng.choice([None, "", "a", "b", "é", "hot", "hot", "hot"]), rng.choice([None, k, k, k]), f"r{k}", leaf, sha("x") if k % 5 == 0 else leaf))
    return rows


@pytest.mark.parametrize("n", [1, 2, 3, 10, 300])
@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_equals_plain(spark, n, height):
    if n == 300 and height == 1:
        n = 60
    rows = merkle_rows(n)
    leaves = spark.createDataFrame(rows, "group string, key long, id string, leaf string, claim string")
    got = merkle.proofs(merkle.build(leaves, height), True).collect()
    assert sorted((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified, r.siblings) for r in got) == plain_proofs(rows)


def test_manifest_of_nothing_and_of_equal_rows(spark):
    empty = spark.createDataFrame([], "group string, key long, id string, leaf string, claim string")
    assert merkle.proofs(merkle.build(empty)).collect() == []
    rows = [("s", 4, "r", sha("q"), sha("q"))] * 5
    got = merkle.proofs(merkle.build(spark.createDataFrame(rows, "group string, key long, id string, leaf string, claim string"), 1)).collect()
    assert len(got) == 5 and all(r.verified for r in got)


def test_leaf_digest(spark):
    row = spark.createDataFrame([(7, None, "é", "")], "a long, b string, c string, d string")
    assert row.select(merkle.digest_of(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0] == sha("1:7-2:é0:")


def test_addresses_fill_the_layout():
    for levels in range(1, 8):
        at = np.concatenate([merkle.address(levels, d, np.arange(3 ** d)) for d in range(levels)])
        assert sorted(at.tolist()) == list(range(merkle.size_of(levels)))
    # four levels: the upper two first, then each lower tree of two
    assert merkle.address(4, 2, np.arange(3)).tolist() == [4, 8, 12] and merkle.address(4, 3, np.arange(4)).tolist() == [5, 6, 7, 9]


# hard negatives

def plain_mining(rows, step, positives, negatives):
    single = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            single[i] = min(single.get(i, (label, v)), (label, v))
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in single.items():
        if a % step:
            continue
        scored = sorted(((-product(v, w), i, kind) for i, (kind, w) in single.items() if i != a))
        for s, i, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def mining_rows(n, dims=6):
    rng = np.random.default_rng(n)
    rows = [(k, int(rng.integers(0, 4)), [int(x) for x in rng.integers(-60, 60, dims)]) for k in range(n)]
    rows += [(1000 + k, k % 2, [9] * dims) for k in range(120)]  # one very common vector
    return rows + [(None, 1, [1] * dims), (2000, None, [1] * dims), (2010, 1, None), (2020, 1, [1, None]), (2030, 1, [5]), (2040, 2, []),
                   rows[3], (rows[4][0], rows[4][1], [99] * dims), (-10, 0, [30] * dims)]


@pytest.mark.parametrize("block", [16, 512])
def test_mining_equals_plain(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = mining_rows(400)
    frame = spark.createDataFrame(rows, "id long, label int, vector array<long>").withColumn("score", F.lit("x"))
    got = hard_negatives.mine(frame, F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_mining(rows, 10, 5, 3)


def test_mining_of_nothing_and_of_large_numbers(spark):
    schema = "id long, label int, vector array<long>"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(0, 1, [1])], schema), F.lit(True)).collect() == []
    big = 1 << 30
    rows = [(k, k % 2, [big + k, big - 3 * k, k]) for k in range(8)]
    got = hard_negatives.mine(spark.createDataFrame(rows, schema), F.lit(True), window=lambda p: (p - 10 * big, p + 10 * big)).collect()
    best = {}
    for r in got:
        a, n = rows[r.anchor_id][2], rows[r.negative_id][2]
        assert r.negative_score == sum(x * y for x, y in zip(a, n))
        best.setdefault((r.anchor_id, r.positive_id), []).append(r.negative_id)
    assert len(best) == 24 and all(len(v) == 3 for v in best.values())


def test_bounds_hold():
    rng = np.random.default_rng(5)
    points, anchors = rng.integers(-50, 50, (200, 7)), rng.integers(-50, 50, (30, 7))
    least, most = hard_negatives.bounds(anchors, points.min(axis=0)[None], points.max(axis=0)[None])
    s = hard_negatives.products(anchors, points)
    assert (s.min(axis=1) >= least[:, 0]).all() and (s.max(axis=1) <= most[:, 0]).all()


def test_curve_visits_neighbours():
    for axes, bits in ((2, 3), (3, 2), (4, 1)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
        keys = hard_negatives.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(1 << (axes * bits)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
