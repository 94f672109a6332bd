"""Histogram boosting of many models against a plain version that fits one model on one array."""

from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.operators import boosting as bo

EPOCH = date(1970, 1, 1)


def plain_fit(x, y, w, cuts, p, rounds, squared=False):
    """Scores of every row of ``x`` after each round, grown node by node."""
    base = (w * y).sum() / w.sum()
    f = np.full(len(x), base)
    out = [f.copy()]
    g_of = (lambda z: z) if squared else (lambda z: z / np.sqrt(1 + z * z))
    h_of = (lambda z: np.ones_like(z)) if squared else (lambda z: (1 + z * z) ** -1.5)
    shrink = lambda g: np.sign(g) * max(abs(g) - p.alpha, 0)

    def grow(at, level):
        g, h = (g_of(f - y) * w)[at].sum(), (h_of(f - y) * w)[at].sum()
        step[at] = -p.rate * shrink(g) / (h + p.lam)
        if level == p.depth:
            return
        best = (0.0, None)
        for k, cs in enumerate(cuts):
            for c in cs:
                left = at & (x[:, k] <= c)
                gl, hl = (g_of(f - y) * w)[left].sum(), (h_of(f - y) * w)[left].sum()
                if hl < p.min_child_weight or h - hl < p.min_child_weight:
                    continue
                gain = 0.5 * (shrink(gl) ** 2 / (hl + p.lam) + shrink(g - gl) ** 2 / (h - hl + p.lam) - shrink(g) ** 2 / (h + p.lam)) - p.gamma
                if gain > best[0] + 1e-9:
                    best = (gain, (k, c))
        if best[1]:
            k, c = best[1]
            grow(at & (x[:, k] <= c), level + 1)
            grow(at & (x[:, k] > c), level + 1)

    for _ in range(rounds):
        step = np.zeros(len(x))
        grow(np.ones(len(x), dtype=bool), 0)
        f = f + step
        out.append(f.copy())
    return out


def panel(n=900, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.normal(size=3).round(3)
        y = 0.6 * (a > 0.2) - 0.4 * (b < -0.5) * (a < 0.2) + 0.1 * rng.normal()
        d = date(2020, 1, 1) + timedelta(days=int(rng.integers(0, 300)))
        rows.append((d, f"s{k}", d + timedelta(days=20), float(y), float(a), float(b) if k % 9 else None, float(c)))
    return rows


def day(d):
    return (d - EPOCH).days


def frame(spark, rows):
    return spark.createDataFrame(rows, "d date, symbol string, label_exit_date date, label double, a double, b double, c double").repartition(3)


@pytest.mark.parametrize("squared", [False, True])
def test_models_grow_together_as_alone(spark, squared):
    rows = panel()
    p = [bo.Params(depth=2, rate=0.3, bins=16), bo.Params(depth=3, rate=0.2, alpha=0.5, lam=2.0, gamma=0.05, min_child_weight=9.0, bins=16)]
    cutoffs = [date(2020, 6, 1), date(2020, 9, 1), date(2021, 6, 1)]
    models = [bo.Model(f"{k}{j}", day(date(2020, 1, 10)), 1 << 20, day(c), params=q, squared=squared, reference=day(c) if k else None)
              for k, c in enumerate(cutoffs) for j, q in enumerate(p)]
    booster = bo.Booster(frame(spark, rows), ["a", "b", "c"], models)
    booster.advance(6)
    forests = booster.advance(4, [m.name for m in models if m.name.endswith("1")])  # past one writing of the margins
    x = np.array([[r[4], r[5] or 0.0, r[6]] for r in rows])
    for m, forest in zip(models, forests):
        use = np.array([day(r[0]) >= m.start and day(r[2]) < m.realised for r in rows])
        w = np.array([1.0 if m.reference is None else 2 ** (-(m.reference - day(r[0])) / 365.25) for r in rows])[use]
        rounds = 10 if m.name.endswith("1") else 6
        want = plain_fit(x[use], np.array([r[3] for r in rows])[use], w, booster.cuts, m.params, rounds, squared)[-1]
        assert np.abs(forest.raw(x[use]) - want).max() < 1e-5
    named = frame(spark, rows).withColumn("name", F.when(F.col("a") > 0, "00").when(F.col("a") < -1, "none").otherwise("21"))
    got = {r.symbol: r for r in bo.predict(named, forests, ["a", "b", "c"]).collect()}
    assert all(r.name in ("00", "21") for r in got.values()) and len(got) == sum(r[4] >= -1 for r in rows)
    by = {f.name: f for f in forests}
    for k, r in enumerate(rows):
        if r[1] in got:
            assert abs(got[r[1]].prediction - by[got[r[1]].name].raw(x[k:k + 1])[0]) < 1e-12
    booster.close()


def test_held_loss_stops_and_samples_repeat(spark):
    rows = panel(600, 5)
    last = date(2021, 6, 1)
    m = bo.Model("x", 0, day(date(2020, 8, 1)), day(last), hold=(day(date(2020, 8, 25)), day(last), day(last)),
                 params=bo.Params(depth=3, rate=0.9, subsample=0.7, colsample=0.7, bins=32))
    runs = []
    for _ in range(2):
        booster = bo.Booster(frame(spark, rows), ["a", "b", "c"], [m])
        runs.append(booster.advance(40, patience=5)[0])
        booster.close()
    a, b = runs
    assert a.losses == b.losses and a.stopped and len(a.trees) < 40
    assert a.best_rounds() == int(np.argmin(a.losses[1:])) + 1
    x = np.array([[r[4], r[5] or 0.0, r[6]] for r in rows])
    held = np.array([day(r[0]) >= day(date(2020, 8, 25)) for r in rows])
    y = np.array([r[3] for r in rows])
    for t in (0, 3):
        f = bo.truncated(a, t).raw(x)
        assert abs((np.sqrt(1 + (f - y) ** 2) - 1)[held].mean() - a.losses[t]) < 1e-6
    assert abs(a.importance(3).sum() - 1) < 1e-9 and a.importance(3).argmax() == 0


def test_draws_cover_all_parameters():
    first = bo.Params()
    draws = bo.drawn(20, first)
    assert draws[0] == first and draws == bo.drawn(20, first)
    for name in ("depth", "rate", "min_child_weight", "gamma", "alpha", "lam", "subsample", "colsample", "bins"):
        assert len({getattr(p, name) for p in draws}) > 2


def test_empty_training(spark):
    booster = bo.Booster(frame(spark, panel(30)), ["a", "b", "c"], [bo.Model("none", 0, 1, 1)])
    assert booster.advance(2)[0].raw(np.zeros((2, 3))).tolist() == [0.0, 0.0]
    booster.close()


def walked(tree, bins):
    """The node of each row (rows x features), one row and level at a time."""
    out = []
    for row in bins:
        node = 0
        while tree.feature[node] >= 0:
            node = 2 * node + 1 + int(row[tree.feature[node]] > tree.cut[node])
        out.append(node)
    return np.array(out)


@pytest.mark.parametrize("depth", range(7))
def test_rows_take_their_way_through_a_tree(depth):
    rng = np.random.default_rng(depth)
    for share in (0.5, 0.8, 1.0):
        tree = bo.Tree.empty(depth)
        inner = (1 << depth) - 1
        for j in range(inner):
            if (j == 0 or tree.feature[(j - 1) // 2] >= 0) and rng.random() < share:
                tree.feature[j], tree.cut[j] = rng.integers(0, 3), rng.integers(0, 512)
        bins = rng.integers(0, 513, (3, 400)).astype(np.uint16)
        assert (tree.place(bins) == walked(tree, bins.T)).all()
    assert tree.place(bins[:, :0]).tolist() == []


def test_trees_are_looked_up_together():
    rng = np.random.default_rng(9)
    trees = []
    for depth in [0, 1, 2, 3, 3, 5] * 4:
        tree = bo.Tree.empty(depth)
        for j in range((1 << depth) - 1):
            if (j == 0 or tree.feature[(j - 1) // 2] >= 0) and rng.random() < 0.9:
                tree.feature[j], tree.cut[j] = rng.integers(0, 3), rng.integers(0, 512)
        tree.value[:] = rng.normal(size=len(tree.value))
        trees.append(tree)
    bins = rng.integers(0, 513, (3, 400)).astype(np.uint16)
    out, want = np.ones(400), np.ones(400)
    bo.Route(trees).add(out, bins)
    for tree in trees:
        want += tree.value[walked(tree, bins.T)]
    assert (out == want).all()


def test_rows_that_lie_together_are_not_copied():
    n = 100
    columns = {"kind": np.zeros(n, np.int32), "day": np.arange(n, dtype=np.int32), "exit": np.arange(10, n + 10, dtype=np.int32), "label": np.ones(n),
               "weight": np.ones(n), "uid": np.arange(n), "bins": np.zeros((2, n), np.uint16), "of": np.zeros(0, np.int32), "margin": np.zeros(0)}
    block = bo.Block(pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns.values()], list(columns)), 0, 2)
    for start, until, realised, want in ((0, 200, 200, slice(0, 100)), (0, 200, 50, slice(0, 40)), (20, 30, 200, slice(20, 30)), (300, 400, 500, slice(0, 0))):
        assert block.training(bo.Model("m", start, until, realised))[0] == want
    assert block.training(bo.Model("m", 0, 200, 200, kind=1))[1].tolist() == []


def test_margins_are_held_for_the_models_that_use_a_block_only(spark):
    """What a task reads of a block does not grow with models that have no row in it."""
    rows = sorted(panel(), key=lambda r: r[2])
    cutoffs = [day(date(2020, 2, 1)) + 10 * k for k in range(20)]
    models = [bo.Model(str(c), 0, 1 << 20, c, params=bo.Params(depth=2, bins=16)) for c in cutoffs]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        booster = bo.Booster(frame(spark, rows).coalesce(1), ["a", "b", "c"], models)
        assert booster.blocks.agg(F.sum(F.length("margin"))).first()[0] == 0
        booster.advance(bo.KEEP)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    blocks = booster.blocks.select(F.expr("length(day) div 4").alias("rows"), F.expr("length(of) div 4").alias("used"), F.length("margin").alias("bytes")).collect()
    assert len(blocks) == 18 and all(b.bytes == 8 * b.rows * b.used for b in blocks)
    used = [sum(day(r[2]) < c for c in cutoffs) for r in rows]
    assert sum(b.used for b in blocks) <= 18 + sum(used) / 50 and min(b.used for b in blocks) == 0
    after = booster.advance(2)  # grown on the written margins
    x, y = np.array([[r[4], r[5] or 0.0, r[6]] for r in rows]), np.array([r[3] for r in rows])
    for m, forest in list(zip(models, after))[::6]:
        use = np.array([day(r[2]) < m.realised for r in rows])
        if use.any():
            want = plain_fit(x[use], y[use], np.ones(use.sum()), booster.cuts, m.params, bo.KEEP + 2)[-1]
            assert np.abs(forest.raw(x[use]) - want).max() < 1e-5
    booster.close()
