import numpy as np
import pandas as pd
from conftest import day
from pyspark.sql import functions as F

from factorloom.operators import cross_section as xs, gram, models, pca, walkforward as wf

FEATURES = ["a", "b", "e"]


def panel(spark, days=40, names=12, seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(days):
        for s in range(names):
            x = rng.normal(size=3) * (1, 5, 0.1) + (0, 100, 3)
            if gaps and rng.random() < 0.15:
                x[0] = np.nan
            y = float(0.3 * np.nan_to_num(x[0]) + 0.02 * x[1] + rng.normal())
            rows.append((day(i), f"{s:06d}", *[None if np.isnan(v) else float(v) for v in x], y if i < days - 2 else None,
                         day(i + 2) if i < days - 2 else None))
    return spark.createDataFrame(rows, "d date, symbol string, a double, b double, e double, label double, label_exit_date date")


def splits(spark):
    rows = [("one", day(14), day(15), day(24)), ("two", day(24), day(25), day(39))]
    return spark.createDataFrame(rows, "name string, train_cutoff date, prediction_start date, prediction_end date")


def scaled(train, rows):
    mean, std = train[FEATURES].mean(), train[FEATURES].std(ddof=0)
    return ((rows[FEATURES] - mean) / std).fillna(0).to_numpy()


def test_every_split_from_one_scan_matches_direct_fits(spark):
    df, sp = panel(spark), splits(spark)
    pdf = df.toPandas()
    systems = wf.systems(wf.moments(df, FEATURES), sp, FEATURES, "2000-01-01")
    fits = wf.fit_table(spark, [(s, m, a, 0.0) for s in systems for m, a in (("linear_regression", 0.0), ("ridge", 10.0))])
    got = wf.score(df, sp, fits, FEATURES).toPandas()
    for name, cutoff, first, last in (("one", day(14), day(15), day(24)), ("two", day(24), day(25), day(39))):
        train = pdf[pdf.label.notna() & (pdf.label_exit_date <= cutoff)]
        test = pdf[(pdf.d >= first) & (pdf.d <= last)].sort_values(["d", "symbol"])
        x, t = scaled(train, train), scaled(train, test)
        for model, alpha in (("linear_regression", 0.0), ("ridge", 10.0)):
            beta = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ (train.label - train.label.mean()))
            mine = got[(got.name == name) & (got.model == model)].sort_values(["d", "symbol"]).prediction
            np.testing.assert_allclose(mine, t @ beta + train.label.mean(), atol=1e-8)


def test_fits_in_tasks_equal_those_on_the_driver(spark):
    df, sp = panel(spark), splits(spark)
    table = wf.moments(df, FEATURES)
    each = {"one": [("linear_regression", 0.0, 0.0)], "two": [("ridge", 10.0, 0.0), ("elasticnet", 0.01, 0.8)]}
    got = wf.fits(wf.split_sums(table, sp, "2000-01-01"), FEATURES, lambda name: each[name]).collect()
    want = wf.fit_table(spark, [(s, *c) for s in wf.systems(table, sp, FEATURES, "2000-01-01") for c in each[s.name]]).collect()
    assert len(got) == 3 and sorted(got) == sorted(want)


def test_scaler_example(spark):
    rows = [(day(0), "a", 1.0, 0.0, day(0)), (day(0), "b", 3.0, 1.0, day(0)), (day(0), "c", None, 2.0, day(0)), (day(1), "a", 5.0, None, None), (day(1), "b", None, None, None)]
    df = spark.createDataFrame(rows, "d date, symbol string, alpha double, label double, label_exit_date date")
    sp = spark.createDataFrame([("s", day(0), day(1), day(1))], "name string, train_cutoff date, prediction_start date, prediction_end date")
    systems = wf.systems(wf.moments(df, ["alpha"]), sp, ["alpha"], "2000-01-01")
    fits = wf.fit_table(spark, [(s, "linear_regression", 0.0, 0.0) for s in systems])
    assert [r["alpha"] for r in wf.scaled_rows(df, sp, fits, ["alpha"]).orderBy("symbol").collect()] == [3.0, 0.0]


def test_all_missing_column_is_an_error(spark):
    df = panel(spark).withColumn("a", F.lit(None).cast("double"))
    try:
        wf.systems(wf.moments(df, FEATURES), splits(spark), FEATURES, "2000-01-01")
    except ValueError as exc:
        assert "['a']" in str(exc)
    else:
        raise AssertionError("an empty column passed")


def test_elastic_net_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    x -= x.mean(axis=0)
    y = x @ [1.0, 0.0, -0.5, 0.0, 0.2] + rng.normal(size=200)
    g, r = x.T @ x / 200, x.T @ (y - y.mean()) / 200
    b = gram.solve_elastic(g, r, 0.1, 0.8)
    slope = r - g @ b - 0.1 * 0.2 * b
    assert all(abs(s - 0.08 * np.sign(v)) < 1e-7 if v else abs(s) <= 0.08 + 1e-9 for s, v in zip(slope, b)) and (b == 0).any()


def test_varimax_rotates_orthogonally_and_alignment_recovers_order_and_sign():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 3))
    turned = pca.varimax(base)
    np.testing.assert_allclose(turned @ turned.T, base @ base.T, atol=1e-8)
    assert (turned ** 4).sum() >= (base ** 4).sum() - 1e-9
    ref = pca.Components(np.eye(3), np.ones(3) / 3)
    mixed = pca.Components(np.eye(3)[:, [2, 0, 1]] * [-1, 1, -1], np.array([0.5, 0.3, 0.2]))
    out, match = pca.aligned(mixed, ref)
    np.testing.assert_allclose(out.loadings, np.eye(3), atol=1e-12)
    assert [m[1] for m in match] == [2, 3, 1] and all(abs(m[2] - 1) < 1e-12 for m in match)


def test_components_match_numpy(spark):
    z = xs.standardise(panel(spark, gaps=False), FEATURES)
    pdf = z.toPandas()
    want = np.mean([g[FEATURES].to_numpy().T @ g[FEATURES].to_numpy() / len(g) for _, g in pdf.groupby("d")], axis=0)
    moments = pca.daily_moments(z, FEATURES)
    part = pca.fixed_components(moments, FEATURES, "2024-01-01", "2024-12-31", variance=0.999, least=3)
    np.testing.assert_allclose(part.loadings @ part.loadings.T, want, atol=1e-8)
    rows = gram.mean_second_moments(z, FEATURES).collect()
    np.testing.assert_allclose(gram.moment_matrix(rows, FEATURES), want, atol=1e-10)


def test_rolling_components_use_only_earlier_quarters(spark):
    z = xs.standardise(panel(spark, days=400, names=6, gaps=False), FEATURES)
    found, notes = pca.rolling_components(pca.daily_moments(z, FEATURES), FEATURES, least=2)
    assert [n["quarter"] for n in notes] == ["2024Q3", "2024Q4", "2025Q1"]
    for n in notes:
        year, quarter = int(n["quarter"][:4]), int(n["quarter"][-1])
        assert n["fit_end"] < pd.Timestamp(year, 3 * quarter - 2, 1).date()
    assert {c.loadings.shape for c in found.values()} == {(3, found[max(found)].loadings.shape[1])}


def test_residual_is_orthogonal_to_styles(spark):
    z = xs.standardise(panel(spark, gaps=False), FEATURES)
    out, audit = pca.residual_target(z, ["a", "b"])
    assert audit.agg(F.max("max_abs_style_correlation")).first()[0] < 1e-9
    pdf = out.toPandas()
    g = pdf[pdf.d == pdf.d.min()]
    x = np.column_stack([np.ones(len(g)), g[["a", "b"]]])
    np.testing.assert_allclose(g.residual_label, g.label - x @ np.linalg.lstsq(x, g.label, rcond=None)[0], atol=1e-9)


def test_residual_ridge_matches_projected_rows(spark):
    df = xs.standardise(panel(spark, gaps=False), FEATURES)
    df = df.where("label IS NOT NULL").withColumn("w", F.dayofmonth("d") / 10.0)
    loadings = np.array([[1.0], [0.5], [0.0]])
    fit = pca.residual_ridge(df, loadings, FEATURES, 0.05, "label", "w")
    assert abs(loadings.T @ fit.weights).max() < 1e-9
    pdf = df.toPandas()
    basis, _ = np.linalg.qr(loadings)
    x = np.column_stack([pdf[FEATURES].to_numpy() @ (np.eye(3) - basis @ basis.T), np.ones(len(pdf))])
    w = pdf.w.to_numpy()
    want = np.linalg.solve(x.T @ (x * w[:, None]) / w.sum() + np.diag([0.05, 0.05, 0.05, 0]), x.T @ (w * pdf.label) / w.sum())
    np.testing.assert_allclose([*fit.coefficients, fit.intercept], want, atol=1e-8)


def test_moments_alone_decide_the_split(spark):
    """Labels realised after a cutoff do not change the fit of that split."""
    df = panel(spark)
    spoiled = df.withColumn("label", F.when(F.col("label_exit_date") > F.lit(day(14)), F.col("label") * 100).otherwise(F.col("label")))
    a, b = (wf.systems(wf.moments(x, FEATURES), splits(spark), FEATURES, "2000-01-01")[0] for x in (df, spoiled))
    np.testing.assert_array_equal(a.rhs, b.rhs)


def test_boosted_model_keeps_given_columns(spark):
    df = panel(spark, days=10)
    model = models.fit_boosted(df, FEATURES, trees=2, depth=2)
    out = models.predict(model, df, FEATURES)
    assert out.where("a IS NULL").count() == df.where("a IS NULL").count() and out.where("prediction IS NULL").count() == 0
    assert models.candidates(3) == models.candidates(3)
