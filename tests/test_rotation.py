"""Rotation over all quarters: choices, residual models and forecasts against plain versions, and nothing looks ahead."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import boosting, cross_section as xs, ic, pca, rotation, timing, walkforward as wf

FEATURES = ["a", "b", "c", "e"]
STYLES = ["style_1", "style_2", "style_3"]


def months(n, start=date(2020, 1, 1)):
    return [date(start.year + (start.month - 1 + k) // 12, (start.month - 1 + k) % 12 + 1, 1) for k in range(n)]


@pytest.mark.parametrize("gap,embargo", [(1, 20), (7, 20), (30, 20), (30, 0)])
@pytest.mark.parametrize("n", [2, 3, 11, 40])
def test_chronological_split_is_the_purged_split(spark, gap, embargo, n):
    ds = [date(2020, 1, 1) + timedelta(days=gap * k) for k in range(n)]
    rows = spark.createDataFrame([(d, d + timedelta(days=2 * gap)) for d in ds], "d date, label_exit_date date")
    parts = {r.d: r.part for r in wf.purged_split(rows, embargo).collect()}
    cut = rotation.chronological(ds, embargo)
    fit = [d for d in ds if parts[d] in ("fit", "purged")]
    held = [d for d in ds if parts[d] == "validation"]
    if cut is None:
        assert not fit or not held
    else:
        assert [d for d in ds if d < cut[0]] == fit and [d for d in ds if d >= cut[1]] == held
        assert {d for d in fit if d + timedelta(days=2 * gap) >= cut[1]} == {d for d in ds if parts[d] == "purged"}


def test_selection_takes_the_first_quarter_with_room():
    ds = months(24)
    known = [(d, ds[k + 2] if k + 2 < len(ds) else None) for k, d in enumerate(ds)]
    quarters = rotation.quarters_of(ds)
    q, end, start = rotation.selection(quarters, known, 20, 4)
    assert q.name == "2020Q3" and end <= start < q.first
    assert rotation.selection(quarters[:2], known, 20, 4) is None and rotation.selection(quarters, [], 20, 4) is None
    assert [x.name for x in quarters][:2] == ["2020Q1", "2020Q2"] and quarters[0].last == date(2020, 3, 1)


def panel(spark):
    rng = np.random.default_rng(3)
    ds = months(15)
    rows = []
    for k, d in enumerate(ds):
        for i in range(14):
            x = rng.normal(size=4)
            y = float(x @ [0.3, -0.2, 0.5, 0.1] + rng.normal()) if k < 13 else None
            rows.append((d, f"s{i:02d}", ds[k + 2] if k < 13 else None, y, *[float(v) for v in x], i % 3 > 0))
    df = spark.createDataFrame(rows, "d date, symbol string, label_exit_date date, label double, a double, b double, c double, e double, member boolean")
    return xs.standardise(df, FEATURES)


def test_residual_models_equal_those_of_rows(spark):
    z = panel(spark).cache()
    rng = np.random.default_rng(8)
    loadings = {q: rng.normal(size=(4, 2)) for q in ("2020Q4", "2021Q1")}
    found = {q: pca.Components(m, np.array([0.6, 0.3])) for q, m in loadings.items()}
    rows = z.withColumn("pool", F.lit("all")).unionByName(z.where("member").withColumn("pool", F.lit("core")))
    sums = rotation.date_sums(rows, FEATURES)
    ds = months(15)
    known = {p: [(d, ds[k + 2] if k < 13 else None) for k, d in enumerate(ds)] for p in ("all", "core")}
    spans = {p: rotation.quarters_of(ds) for p in known}
    specs, held = rotation.residual_specs(spark, spans, known, found, 20)
    fits = rotation.residual_fits(sums, specs).cache()
    got = {(r.pool, r.quarter, r.part): r for r in fits.collect()}
    assert set(got) == {(p, q, x) for p in known for q in found for x in ("all", "fit")}
    checks = {(r.pool, r.quarter): r for r in rotation.residual_validation(rows, sums, fits, held, FEATURES).collect()}
    for pool in known:
        for q in found:
            cutoff = next(x.first for x in spans[pool] if x.name == q)
            own = rows.where((F.col("pool") == pool) & (F.col("label_exit_date") < F.lit(cutoff)))
            shown = own.join(pca.project(z, found[q], FEATURES), ["d", "symbol"])
            target, _ = pca.residual_target(shown, found[q].names)
            train = wf.age_weighted(target, cutoff)
            want = pca.residual_ridge(train, loadings[q], FEATURES, weight="sample_weight")
            r = got[pool, q, "all"]
            np.testing.assert_allclose(r.weights, want.weights, atol=1e-8)
            assert abs(r.intercept - want.intercept) < 1e-8 and r.rows == want.rows and r.last_exit < cutoff
            split = wf.purged_split(train, 20)
            part = pca.residual_ridge(split.where("part = 'fit'"), loadings[q], FEATURES, weight="sample_weight")
            np.testing.assert_allclose(got[pool, q, "fit"].weights, part.weights, atol=1e-8)
            score = pca.gram.linear_score(FEATURES, part.weights, part.intercept)
            daily = ic.daily_ic(split.where("part = 'validation'").withColumn("prediction", score), ("d",), "prediction", "residual_label")
            assert abs(checks[pool, q].rank_ic - daily.agg(F.avg("rank_ic")).first()[0]) < 1e-9


def test_softmax_meets_its_optimality_condition():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = np.argmax(x @ rng.normal(size=(3, 4)) + rng.gumbel(size=(300, 4)), axis=1)
    w = rng.uniform(0.5, 2, 300)
    b = rotation.softmax_fit(x, y, w, 4)
    x1 = np.column_stack([x, np.ones(300)])
    p = np.exp(x1 @ b.T)
    p /= p.sum(axis=1, keepdims=True)
    slope = ((p - np.eye(4)[y]) * (w / w.sum())[:, None]).T @ x1 + np.column_stack([0.01 * b[:, :3], 1e-8 * b[:, 3]])
    assert np.abs(slope).max() < 1e-8


def timing_table(spark, spoil_after=None):
    rng = np.random.default_rng(12)
    ds, rows = months(33), []
    for k, d in enumerate(ds):
        row = {"d": d, "label_exit_date": ds[k + 2] if k + 2 < 33 else None, "benchmark_volatility": float(rng.uniform()), "benchmark_return": float(rng.normal())}
        row |= {f"label_exit_date_{h}": ds[k + lag] if k + lag < 33 else None for h, lag in ((5, 2), (20, 4))}
        for s in STYLES:
            row |= {f"{s}_{m}": float(rng.normal()) for m in timing.MEASURES}
        for h in timing.HORIZONS:
            for s in STYLES:
                y = 0.5 * row[f"{s}_momentum_{h}"] + 0.2 * float(rng.normal())
                late = spoil_after and row[f"label_exit_date_{h}"] and row[f"label_exit_date_{h}"] >= spoil_after
                row[f"target_{s}_{h}"] = (50.0 if late else y) if row[f"label_exit_date_{h}"] else None
        targets = [row[f"target_{s}_5"] for s in STYLES]
        known = row["label_exit_date"] is not None
        row["best_style"] = STYLES[int(np.argmax(targets))] if known else None
        row["winner_margin"] = float(sorted(targets)[-1] - sorted(targets)[-2]) if known else None
        rows.append(row)
    kinds = {"d": "date", "best_style": "string"} | {c: "date" for c in rows[0] if c.startswith("label_exit")}
    return spark.createDataFrame(pd.DataFrame(rows).astype(object).where(lambda x: x.notna(), None).values.tolist(),
                                 ", ".join(f"{c} {kinds.get(c, 'double')}" for c in rows[0])).cache()


def test_forecasts_of_all_quarters_look_only_back(spark):
    params = boosting.Params(depth=2, rate=0.3, bins=16)
    spoiled = date(2021, 10, 1)
    out = []
    for t in (timing_table(spark), timing_table(spark, spoiled)):
        tables = {"all": t, "core": t.where("d >= '2020-02-01'")}
        forecasts, choices, notes = rotation.dual_horizon(tables, STYLES, params, 6, 3)
        out.append(({(r.pool, r.d, r.style): (r.forecast_5, r.forecast_20) for r in forecasts.collect()}, choices, {(r.pool, r.horizon, r.quarter): r for r in notes.collect()}))
    (first, choices, notes), (second, again, _) = out
    assert choices.keys() == {(p, h) for p in ("all", "core") for h in timing.HORIZONS} and all(1 <= c.trees <= 6 for c in choices.values())
    assert choices == again
    before = {k: v for k, v in first.items() if k[1] < spoiled}
    assert before and all(second[k] == v for k, v in before.items()) and any(second[k] != v for k, v in first.items())
    for p in ("all", "core"):
        start = max(next(q.first for q in rotation.quarters_of(months(33)) if q.name == choices[p, h].quarter) for h in timing.HORIZONS)
        assert {d for pool, d, _ in first if pool == p} == {d for d in months(33) if d >= start}
        for h in timing.HORIZONS:
            mine = [n for (pool, horizon, _), n in notes.items() if (pool, horizon) == (p, h)]
            assert len(mine) == 11 and {n.trees for n in mine if n.trees} == {choices[p, h].trees}
            assert sum(n.reason == "chosen here" for n in mine) == 1 and any("too few" in n.reason for n in mine)


def test_timers_give_weights_that_sum_to_one_and_look_only_back(spark):
    spoiled = date(2021, 10, 1)
    results = []
    for t in (timing_table(spark), timing_table(spark, spoiled)):
        if results:  # the winners follow the spoiled targets only from there on
            t = t.withColumn("best_style", F.when(F.col("label_exit_date") >= F.lit(spoiled), F.lit("style_1")).otherwise(F.col("best_style")))
        tables, spans = {"all": t}, {"all": [q for q in rotation.quarters_of(months(33)) if q.first >= date(2020, 10, 1)]}
        quarters = spark.createDataFrame([("all", q.name, q.first, q.last) for q in spans["all"]], "pool string, quarter string, first date, last date")
        logistic = {(r.d, r.style): r.w for r in rotation.logistic_weights(tables, STYLES, quarters).collect()}
        wins, returns = rotation.tree_timers(tables, STYLES, spans, boosting.Params(depth=2, rate=0.3, bins=16), 3)
        results.append((logistic, {(r.d, r.style): r.x for r in wins.collect()}, {(r.d, r.style): r.x for r in returns.collect()}))
    days = {d for d in months(33) if d >= date(2020, 10, 1)}
    for a, b in zip(*results):
        assert {d for d, _ in a} == days and len(a) == 3 * len(days)
        assert all(b[k] == v for k, v in a.items() if k[0] < spoiled) and any(b[k] != v for k, v in a.items())
    for d in days:
        assert abs(sum(results[0][0][d, s] for s in STYLES) - 1) < 1e-9
