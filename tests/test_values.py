from datetime import date

import numpy as np
import pandas as pd
import pytest
from conftest import day
from pyspark.sql import functions as F

from factorloom.functions import columns as c
from factorloom.operators import cross_section as xs, factors, ic, portfolio, quality, selection, style


def scalar(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# 3 in 10,000 with 5 at least, 1 in 100,000 for transfer, and for sales a duty of 10, from 2023-08-28 of 5, in 10,000
@pytest.mark.parametrize("when,side,gross,options,fee", [
    ("2022-03-01", "BUY", 250_000.0, {}, 77.5), ("2021-05-06", "SELL", 40_000.0, {}, 52.4), ("2023-09-01", "SELL", 40_000.0, {}, 32.4),
    ("2022-03-01", "BUY", 2_000.0, {}, 5.02), ("2025-02-03", "SELL", 30_000.0, {"flat_rate": 0.002}, 60.0),
    ("2025-02-03", "SELL", 30_000.0, {"flat_rate": 0.0}, 0.0)])
def test_fee_schedule(spark, when, side, gross, options, fee):
    got = scalar(spark, c.transaction_fee(F.lit(when).cast("date"), F.lit(side), F.lit(gross), **options))
    assert abs(got - fee) < 1e-9


def test_codes_and_dates(spark):
    codes = {"7": "000007", "600000.0": "600000", "12345678": "12345678"}
    assert {k: scalar(spark, c.normal_symbol(F.lit(k))) for k in codes} == codes
    dates = {"20240102": date(2024, 1, 2), "20240102.0": date(2024, 1, 2), "2024-01-02": date(2024, 1, 2), "20241399": None, "x": None}
    assert {k: scalar(spark, c.parse_date(F.lit(k))) for k in dates} == dates


def test_lot_limits_and_price(spark):
    assert scalar(spark, c.lot_shares(F.lit(499.0), F.lit("688001"))) == 400
    assert scalar(spark, c.lot_shares(F.lit(499.0), F.lit("600001"))) == 400 and scalar(spark, c.lot_shares(F.lit(399.9), F.lit("688001"))) == 200
    args = lambda p, prev, s, st, side: c.tradeable(F.lit(p), F.lit(prev), F.lit(s), F.lit(st), side)
    assert not scalar(spark, args(11.0, 10.0, "600000", False, "sell")) and scalar(spark, args(11.0, 10.0, "300000", False, "sell"))
    assert scalar(spark, args(10.5, 10.0, "600000", True, "sell")) and not scalar(spark, args(10.5, 10.0, "600000", True, "buy"))
    assert scalar(spark, c.real_price(F.lit(10.0), F.lit(0.0))) is None
    assert scalar(spark, c.clip(F.lit(None).cast("double"), -1.0, 1.0)) is None


def test_exposure_reacts_to_stress(spark):
    def target(mean, down, dd, off, n=20):
        return scalar(spark, c.qp_exposure(F.lit(mean), F.lit(down), F.lit(dd), F.lit(1.0), F.lit(off), F.lit(n))[2])
    calm, stressed = target(0.002, 0.0, 0.0, False), target(-0.015, 0.00025, -0.3, True)
    assert 0.3 <= stressed < calm <= 1.0 and target(-1.0, 1.0, -0.9, True, 5) == 1.0


def section(spark, values, start=0):
    return spark.createDataFrame([(day(start), f"{i:06d}", v) for i, v in enumerate(values)], "d date, symbol string, alpha double")


def test_standardise_uses_observed_values(spark):
    got = [r["alpha"] for r in xs.standardise(section(spark, [1.0, 3.0, None]), ["alpha"]).orderBy("symbol").collect()]
    assert got == [-1.0, 1.0, 0.0]
    flat = [r["alpha"] for r in xs.zscore(section(spark, [2.0, 2.0]), ["alpha"]).collect()]
    assert flat == [None, None]


def test_infinite_input_fails(spark):
    with pytest.raises(Exception, match="infinite value in alpha"):
        xs.standardise(section(spark, [1.0, float("inf")]), ["alpha"]).collect()


def test_constant_prediction_has_no_ic(spark):
    df = section(spark, [1.0] * 4).withColumn("label", F.col("symbol").cast("double"))
    row = ic.daily_ic(df, ("d",), "alpha").first()
    assert row["rank_ic"] is None and row["pearson_ic"] is None and row["stock_count"] == 4


def test_neutral_scores(spark):
    scores = spark.createDataFrame([(day(t), s, v + t) for t in range(2) for s, v in (("a", 1.0), ("b", 3.0), ("c", 10.0), ("e", 14.0))],
                                   "d date, symbol string, score double")
    groups = spark.createDataFrame([("a", "bank"), ("b", "bank"), ("c", "tech"), ("e", "tech")], "symbol string, industry string")
    out = xs.neutralise(scores, groups)
    audit = xs.neutral_audit(out).collect()
    assert all(abs(r["max_abs_industry_mean"]) < 1e-10 and abs(r["raw_score_std"] - r["optimized_score_std"]) < 1e-10 for r in audit)
    with pytest.raises(Exception, match="no industry for"):
        xs.neutralise(scores, groups.where("symbol <> 'a'")).collect()


def test_tilted_weights_resist_outliers(spark):
    scores = {"p": 3.0, "q": 5.0, "r": -2.0, "s": 4e7}
    df = spark.createDataFrame([(day(4), k, v) for k, v in scores.items()], "d date, symbol string, score double")
    w = {r["symbol"]: r["weight"] for r in selection.weights(df, "tilted").collect()}
    # a fifth in equal parts, the rest by rank over 10
    assert w == pytest.approx({"r": 0.05 + 0.08, "p": 0.05 + 0.16, "q": 0.05 + 0.24, "s": 0.05 + 0.32})


def test_retain_flags(spark):
    votes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "symbol string, sell_votes int").withColumn("d", F.lit(day(0)))
    assert [r["retain"] for r in style.retain_flags(votes).orderBy("symbol").collect()] == [True, True, False]
    given = spark.createDataFrame([("a", True), ("b", None)], "symbol string, retain boolean")
    assert [r["retain"] for r in style.retain_flags(given).orderBy("symbol").collect()] == [True, False]


def test_conflicting_flags_fail(spark):
    df = spark.createDataFrame([(day(0), True), (day(0), False)], "d date, risk_off boolean")
    with pytest.raises(Exception, match="conflicting risk_off"):
        quality.daily_flag(df, "risk_off").collect()


def test_style_return_is_long_short(spark):
    places = [(7 * i) % 30 for i in range(30)]
    kind = "d date, symbol string, style string, x double, label double, label_entry_date date, label_exit_date date"
    rows = [(day(3), f"{i:06d}", s, float(x), way * x / 500, day(4), day(9)) for i, x in enumerate(places) for s, way in (("up", 1), ("down", -1))]
    got = {r.style: r for r in style.style_returns(spark.createDataFrame(rows, kind)).collect()}
    assert got["up"].style_return > 0 and got["down"].style_return == pytest.approx(-got["up"].style_return)
    assert got["up"].style_exit_date == day(9)


def test_timing_uses_realised_returns_only(spark):
    rows = [(day(i), s, (i + 1) * k / 1000, day(i + 1), day(i + 2)) for i in range(12) for s, k in (("a", 1), ("b", -1))]
    schema = "d date, style string, style_return double, style_entry_date date, style_exit_date date"
    dates = spark.createDataFrame([(day(i),) for i in range(12)], "d date")

    def features(table):
        out = style.timing_features(spark.createDataFrame(table, schema), dates, ["a", "b"])
        return {(r["d"], r["style"]): r for r in out.collect()}

    base = features(rows)
    spoiled = features([r if r[4] <= day(8) else (r[0], r[1], 9.9, r[3], r[4]) for r in rows])
    assert all(base[k] == spoiled[k] for k in base if k[0] <= day(8))
    row = base[(day(8), "a")]
    assert row["max_information_date"] == day(8)
    assert abs(row["momentum_5"] - np.mean([3, 4, 5, 6, 7]) / 1000) < 1e-12


def test_gate_modes(spark):
    rows = [(day(i), f"{s}", float(s), day(i + 1), "p") for i in range(25) for s in range(3)]
    predictions = spark.createDataFrame(rows, "d date, symbol string, prediction double, label_exit_date date, pool string")

    def modes(rank_ic, explained):
        daily = spark.createDataFrame([("p", day(i), rank_ic, day(i + 1)) for i in range(25)], "pool string, d date, rank_ic double, label_exit_date date")
        structure = spark.createDataFrame([("p", "2024Q1", explained, 1.0, 0.05)], "pool string, quarter string, explained double, alignment double, validation_ic double")
        gated, audit = style.confidence_gate(predictions, daily, structure, 10)
        return {r["d"]: r for r in audit.collect()}, gated.toPandas()

    good, gated = modes(0.1, 0.9)
    assert {r["mode"] for r in good.values()} == {"normal"} and gated.trade_prediction.notna().all()
    weak, gated = modes(0.1, 0.5)
    assert {r["mode"] for r in weak.values()} == {"hold"} and gated.retain.all() and gated.trade_prediction.isna().all()
    bad, _ = modes(-0.1, 0.9)
    assert bad[day(5)]["mode"] == "normal" and bad[day(15)]["mode"] == "hold" and bad[day(22)]["mode"] == "risk_off_liquidate"


def test_drifting_portfolio_matches_a_loop(spark):
    rng = np.random.default_rng(5)
    days = [d.date() for d in pd.bdate_range("2024-01-01", periods=60)]
    names = [f"{i:06d}" for i in range(12)]
    ret = pd.DataFrame(rng.normal(0, 0.02, (60, 12)), days, names).mask(rng.random((60, 12)) < 0.1)
    score = pd.DataFrame(rng.normal(size=(60, 12)), days, names)
    long = lambda f, n: spark.createDataFrame([(d, s, None if pd.isna(v) else float(v)) for d, r in f.iterrows() for s, v in r.items()], f"d date, symbol string, {n} double")
    targets = portfolio.rebalance_targets(long(score, "score"), "monthly", 5)
    got = portfolio.drifting_portfolio(targets, long(ret, "ret")).orderBy("d").toPandas()
    w, nav, month, want = pd.Series(0.0, names), 1.0, None, []
    for d in days:
        turnover = cost = 0.0
        if d.month != month:
            month = d.month
            top = score.loc[d].nlargest(5)
            goal = pd.Series(0.0, names)
            goal[top.index] = top.rank() / top.rank().sum()
            step = goal - w
            turnover, sells, w = step.abs().sum(), -step.clip(upper=0).sum(), goal
            cost = turnover * 0.0003 + sells * 0.0005
        r = ret.loc[d].fillna(0)
        gross = (w * r).sum()
        nav *= 1 + gross - cost
        want.append((gross, cost, turnover, nav))
        w = w * (1 + r)
        w = w / w.sum()
    np.testing.assert_allclose(got[["gross_return", "cost", "turnover", "nav"]].to_numpy(), np.array(want), atol=1e-12)


def test_overlay_matches_a_loop(spark):
    rng = np.random.default_rng(2)
    rets = rng.normal(0, 0.03, 80)
    df = spark.createDataFrame([("s", day(i), float(r), i % 7 == 0) for i, r in enumerate(rets)], "series string, d date, ret double, risk_off boolean")
    got = portfolio.exposure_overlay(df, "series").orderBy("d").toPandas()
    nav = peak = e = 1.0
    past, want = [], []
    for i, r in enumerate(rets):
        recent = past[-60:]
        if len(recent) >= 10:
            excess = max(1 - nav / peak, 0) / 0.2
            multiplier = 1 + 4 * excess ** 2 + (2 if i % 7 == 0 else 0)
            down = np.mean(np.minimum(recent, 0) ** 2)
            free = (max(np.mean(recent), 0) + 0.0025 * e) / (4 * multiplier * max(down, 1e-12) + 0.0025)
            e = min(max(free, max(0.3, e - 0.1)), min(1.0, e + 0.1))
        past.append(e * r)
        nav *= 1 + e * r
        peak = max(peak, nav)
        want.append((e, nav))
    np.testing.assert_allclose(got[["exposure", "nav"]].to_numpy(), np.array(want), atol=1e-12)


def test_relative_nav_identity(spark):
    values, index = (80.0, 92.0, 69.0, 115.0, 110.4), (50.0, 55.0, 44.0, 60.0, 61.0)
    asset = spark.createDataFrame([(day(i), v, 2) for i, v in enumerate(values)], "d date, asset double, holding_count int")
    bench = spark.createDataFrame([(day(i), v) for i, v in enumerate(index)], "d date, value double")
    nav = portfolio.relative_nav(asset, bench).orderBy("d").toPandas()
    np.testing.assert_allclose(nav.excess, [1, 92 / 80 / (55 / 50), 69 / 80 / (44 / 50), 115 / 80 / (60 / 50), 110.4 / 80 / (61 / 50)])
    figures = {r["side"]: r for r in portfolio.account_performance(asset, bench).collect()}
    assert figures["absolute"]["max_drawdown"] == pytest.approx(-0.25)
    broken = asset.withColumn("asset", F.when(F.col("d") == day(3), float("nan")).otherwise(F.col("asset")))
    with pytest.raises(Exception, match="non-finite account value"):
        portfolio.account_performance(broken, bench).collect()


def test_layers_are_ordered(spark):
    rows = spark.createDataFrame([(day(0), f"{i:06d}", float(i), i / 100) for i in range(20)], "d date, symbol string, f double, ret double")
    out = portfolio.layer_returns(rows, "f", "ret", 10).orderBy("layer").toPandas()
    assert out.layer.tolist() == list(range(1, 11)) and out.ret.is_monotonic_increasing
    spread = portfolio.layer_curves(portfolio.layer_returns(rows, "f", "ret", 10), 10).where("layer = 0").first()
    assert abs(spread["nav"] - 1.18) < 1e-12


def test_no_trade_band_counts_only_when_scaling_binds(spark):
    rows = spark.createDataFrame([(day(0), "a", 0.6, 0.595, 0.0), (day(0), "b", 0.4, 0.1, 0.0), (day(0), "e", 0.0, 0.305, 0.0)],
                                 "d date, symbol string, target double, current double, drawdown double")
    free = {r["symbol"]: r["constrained"] for r in portfolio.constrain(rows, 0.01, 1.0, None).collect()}
    assert free["a"] == 0.6
    bound = {r["symbol"]: r["constrained"] for r in portfolio.constrain(rows, 0.01, 0.3, None).collect()}
    assert bound["a"] == 0.595 and bound["b"] < 0.4


def test_factor_runs(spark):
    def broken(column):
        """Fails while it is built."""
        raise RuntimeError(column)

    own = {**factors.BUILT_IN, "twice": lambda column: factors.Factor("twice", lambda df: F.col(column) * 2, (column,)), "broken": broken}
    names = {r.factor: r.description for r in factors.catalogue(spark, own).collect()}
    assert set(names) == {"column", "ratio", "twice", "broken"} and names["broken"] == "Fails while it is built." and names["twice"] == ""
    specs = [{"name": "twice", "output": "t", "parameters": {"column": "alpha"}}, {"name": "ratio", "output": "flat", "parameters": {"top": "alpha", "bottom": "alpha"}},
             {"name": "twice", "output": "gone", "parameters": {"column": "beta"}}, {"name": "broken", "parameters": {"column": "x"}}, {"name": "nothing"},
             {"name": "column", "output": "wrong", "parameters": {"colour": "red"}}]
    run = factors.run_factors(section(spark, [3.0, 7.0, 8.0]), specs, own)
    assert run.values.columns == ["d", "symbol", "t"] and [r.factor for r in run.coverage.collect()] == ["t"]
    assert set(run.skipped) == {"flat", "gone", "broken", "nothing", "wrong"} and "beta" in run.skipped["gone"]
    with pytest.raises(ValueError):
        factors.score_transform("other")


def test_consistency_checks_can_fail(spark):
    nav = [1.0, 1.02, 0.99, 1.05]
    curve = spark.createDataFrame([(day(i), v, v + 0.01 * i, 0.5 * (i == 1)) for i, v in enumerate(nav)], "d date, nav double, gross_nav double, turnover double")
    account = spark.createDataFrame([(day(i), 200 * v) for i, v in enumerate(nav)], "d date, asset double")
    calendar = spark.createDataFrame([(day(i), i + 1) for i in range(4)], "d date, idx int")
    bench = spark.createDataFrame([(day(i), 10.0 + i) for i in range(4)], "d date, value double")
    got = {r["check"]: r for r in quality.consistency(curve, account, calendar, bench).collect()}
    assert all(r.passed for r in got.values()) and got["max_abs_benchmark_move"].value == pytest.approx(0.1)

    def failing(curve=curve, account=account, calendar=calendar, bench=bench):
        return {r["check"] for r in quality.consistency(curve, account, calendar, bench).collect() if not r.passed}

    assert failing(account=account.withColumn("asset", F.when(F.col("d") == day(2), 1.0).otherwise(F.col("asset")))) == {"curve_matches_account"}
    assert failing(account=account.where(F.col("d") < F.lit(day(3)))) == {"dates_in_one_only"}
    assert "nonfinite_assets" in failing(account=account.withColumn("asset", F.when(F.col("d") == day(3), float("nan")).otherwise(F.col("asset"))))
    assert failing(calendar=calendar.withColumn("idx", F.col("idx") + 1)) == {"first_date_kept", "first_trade_session"}
    assert failing(curve=curve.withColumn("gross_nav", F.lit(1.0))) == {"no_fee_not_below_net"}
    assert failing(bench=bench.limit(0)) == {"max_abs_benchmark_move"}


def test_pooled_rank_correlation_with_gaps(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(80, 5)).round(1)
    x[:20, 0] = x[:20, 1] = np.nan  # the same gaps
    x[10:40, 2] = np.nan
    x[:, 4] = np.nan
    names = ["a", "b", "c", "e", "f"]
    rows = [(k, *[None if np.isnan(v) else float(v) for v in row]) for k, row in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    got = {(r.x, r.y): r for r in ic.pooled_spearman(df, names, ("id",)).collect()}
    frame = pd.DataFrame(x, columns=names)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            both = frame[[a, b]].dropna()
            want = both[a].rank().corr(both[b].rank()) if len(both) else np.nan
            assert got[a, b].n == len(both)
            assert (got[a, b].spearman is None) if np.isnan(want) else abs(got[a, b].spearman - want) < 1e-9
    assert len(got) == 10 and all(r.spearman is None for r in ic.pooled_spearman(df.where("false"), names, ("id",)).collect())
