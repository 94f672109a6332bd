from datetime import date

import pandas as pd
from conftest import day

from factorloom.operators import align, calendar, series, walkforward as wf
from pyspark.sql import functions as F


def prices(spark, table):
    """{symbol: [(date, price), ...]}"""
    return spark.createDataFrame([(d, s, float(p)) for s, rows in table.items() for d, p in rows], "d date, symbol string, price double")


def keys(spark, dates, symbols=("a",)):
    return spark.createDataFrame([(d, s) for d in dates for s in symbols], "d date, symbol string")


def label_rows(spark, px, signal):
    return {r["d"]: r for r in align.labels(px, signal).collect()}


def test_daily_label(spark):
    path = (20, 25, 24, 30, 27, 33)
    px = prices(spark, {"a": [(day(i), p) for i, p in enumerate(path)]})
    got = label_rows(spark, px, keys(spark, [day(i) for i in range(6)]))
    # bought one session later, sold two sessions later
    want = {0: -0.04, 1: 0.25, 2: -0.1, 3: 33 / 27 - 1}
    assert all(abs(got[day(i)]["label"] - v) < 1e-12 for i, v in want.items())
    assert got[day(4)]["label"] is None and got[day(5)]["label"] is None


def test_sparse_signal_label(spark):
    path = (8, 9, 16, 11, 10, 20, 21, 40)
    px = prices(spark, {"a": [(day(i), p) for i, p in enumerate(path)]})
    got = label_rows(spark, px, keys(spark, [day(1), day(4), day(6)]))
    want = {1: (20 / 16 - 1, 2, 5), 4: (40 / 20 - 1, 5, 7)}
    for i, (label, entry, out) in want.items():
        assert abs(got[day(i)]["label"] - label) < 1e-12
        assert (got[day(i)]["label_entry_date"], got[day(i)]["label_exit_date"]) == (day(entry), day(out))
    assert got[day(6)]["label"] is None


def test_signals_between_sessions(spark):
    sess = [date(2023, 2, 24), date(2023, 2, 27), date(2023, 3, 31), date(2023, 4, 3), date(2023, 4, 4)]
    px = prices(spark, {"a": [(d, 50 - i) for i, d in enumerate(sess)]})
    got = label_rows(spark, px, keys(spark, [date(2023, 2, 25), date(2023, 4, 1)]))[date(2023, 2, 25)]
    assert (got["label_entry_date"], got["label_exit_date"]) == (date(2023, 2, 27), date(2023, 4, 3))


def test_no_look_ahead_in_labels(spark):
    base = {"a": [(day(i), 10 + i) for i in range(8)], "b": [(day(i), 20 - i) for i in range(8)]}
    later = {s: [(d, p if d <= day(4) else p * 3) for d, p in rows] for s, rows in base.items()}
    signal = keys(spark, [day(i) for i in range(8)], ("a", "b"))
    known = [sorted((r["d"], r["symbol"], r["label"]) for r in align.labels(prices(spark, t), signal)
                    .where(F.col("label_exit_date") <= F.lit(day(4))).collect()) for t in (base, later)]
    assert known[0] == known[1] and known[0]


def test_holiday_rows_are_dropped(spark):
    table = [{"x": 4.0, "y": 7.0}, {"x": 4.0, "y": 7.0}, {"x": 4.0, "y": 7.5}, {"x": 4.0, "y": 7.5, "z": 1.0}, {"x": 4.0, "y": 7.5, "z": 1.0},
             {"x": 3.9, "y": 7.5, "z": 1.0}]
    px = spark.createDataFrame([(day(i), s, v) for i, row in enumerate(table) for s, v in row.items()], "d date, symbol string, price double")
    assert sorted(r["d"] for r in calendar.changed_sessions(px).collect()) == [day(0), day(2), day(3), day(5)]


def test_rebalance_counts(spark):
    days = [d.date() for d in pd.bdate_range("2024-01-02", periods=24)]
    cal = calendar.sessions(keys(spark, days))
    count = {f: calendar.rebalance_flags(cal, f).where("rebalance").count()
             for f in ("daily", "alternate", "weekly", "monthly", "quarterly")}
    assert count == {"daily": 23, "alternate": 12, "weekly": 5, "monthly": 2, "quarterly": 1}


def test_asof_backward_keeps_last_known(spark):
    cal = calendar.sessions(keys(spark, [date(2024, 1, 5), date(2024, 1, 8)]))
    signals = spark.createDataFrame([(date(2024, 1, 6), "a", 1.0), (date(2024, 1, 7), "a", 2.0), (date(2024, 1, 7), "b", None),
                                     (date(2024, 1, 6), "b", 3.0), (date(2024, 1, 1), "a", 9.0)], "d date, symbol string, v double")
    got = {(r["d"], r["symbol"]): r["v"] for r in align.signals_on_sessions(signals, cal, "v").collect()}
    assert got == {(date(2024, 1, 5), "a"): 2.0, (date(2024, 1, 5), "b"): 3.0}


def test_eligibility_carries_the_last_universe(spark):
    signals = spark.createDataFrame([(day(0), "a", 1.0), (day(0), "b", 2.0), (day(1), "a", None), (day(2), "b", 3.0)],
                                    "d date, symbol string, v double")
    cal = calendar.sessions(keys(spark, [day(0), day(1), day(2)]))
    got = sorted((r["d"], r["symbol"]) for r in align.eligibility(signals, cal, "v").collect())
    assert got == [(day(0), "a"), (day(0), "b"), (day(1), "a"), (day(1), "b"), (day(2), "b")]


def test_industry_never_looks_ahead(spark):
    mapping = spark.createDataFrame([(day(2), "a", "bank"), (day(5), "a", "tech")], "d date, symbol string, industry string")
    got = {r["d"]: r["industry"] for r in align.with_industry(keys(spark, [day(1), day(2), day(4), day(6)]), mapping).collect()}
    assert got == {day(1): None, day(2): "bank", day(4): "bank", day(6): "tech"}


def test_gaps_do_not_shift_offsets(spark):
    px = prices(spark, {"a": [(day(0), 10), (day(2), 12)], "b": [(day(i), 1 + i) for i in range(4)]})
    rows = calendar.with_index(px, calendar.sessions(px)).withColumn("prev", series.at_offset("price", -1))
    got = {(r["d"], r["symbol"]): r["prev"] for r in rows.collect()}
    assert got[(day(2), "a")] is None and got[(day(2), "b")] == 2.0


def test_compounding_survives_total_loss_and_sign_change(spark):
    rets = [0.1, -1.5, -1.2, None, -1.0, 0.3]
    df = spark.createDataFrame([(day(i), "a", r) for i, r in enumerate(rets)], "d date, symbol string, ret double")
    got = [r["nav"] for r in df.select("d", series.compounded(F.col("ret"), series.running(("symbol",), "d")).alias("nav")).orderBy("d").collect()]
    want, nav = [], 1.0
    for r in rets:
        nav *= 1 + (r or 0.0)
        want.append(nav)
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_embargo_and_purged_split(spark):
    days = [d.date() for d in pd.bdate_range("2021-06-01", periods=60)]
    df = spark.createDataFrame([(d, "a", 1.0, d) for d in days], "d date, symbol string, label double, label_exit_date date")
    parts = {r["d"]: r["part"] for r in wf.purged_split(df, 10).collect()}
    assert [days.index(min(d for d, p in parts.items() if p == "validation")), days.index(max(d for d, p in parts.items() if p == "fit"))] == [48, 37]
    quarters = [d.date() for d in pd.date_range("2015-03-31", periods=9, freq="QE")]
    assert calendar.embargo_observations(keys(spark, quarters), 15).first()["observations"] == 1


def test_labels_realised_after_the_validation_start_do_not_train(spark):
    days = [d.date() for d in pd.date_range("2012-01-31", periods=83, freq="ME")]
    rows = [(d, "a", 1.0, days[i + 21]) for i, d in enumerate(days[:-21])]
    df = spark.createDataFrame(rows, "d date, symbol string, label double, label_exit_date date")
    parts = wf.purged_split(df, 20).collect()
    start = min(r["d"] for r in parts if r["part"] == "validation")
    assert all(r["label_exit_date"] < start for r in parts if r["part"] == "fit") and sum(r["part"] == "purged" for r in parts) == 20


def loop_training(rows, splits, start, years=None, strict=False):
    out = set()
    for d, exit_ in rows:
        for name, cutoff, *_ in splits:
            low = start if years is None else date(cutoff.year - years, cutoff.month, cutoff.day) + pd.Timedelta(days=1).to_pytimedelta()
            if exit_ is not None and d >= low and (exit_ < cutoff if strict else exit_ <= cutoff):
                out.add((d, exit_, name))
    return out


def test_rows_meet_splits_as_in_a_loop(spark):
    days = [day(9 * i, date(2019, 1, 1)) for i in range(120)]
    rows = [(d, None if i % 11 == 0 else days[min(i + 1 + i % 4, 119)]) for i, d in enumerate(days)]
    cut = [days[k] for k in (30, 55, 56, 90, 110)]
    spans = [(f"s{k}", c, day(1, c), day(40, c) if k != 1 else day(5, c)) for k, c in enumerate(cut)]
    sp = spark.createDataFrame(spans, "name string, train_cutoff date, prediction_start date, prediction_end date")
    df = spark.createDataFrame([(d, "a", 1.0, e) for d, e in rows], "d date, symbol string, label double, label_exit_date date")
    for strict in (False, True):
        for mode, years in (("expanding", None), ("fixed", 1)):
            got = align.training_rows(df, sp, "2019-03-01", mode, years or 4, strict)
            assert {(r["d"], r["label_exit_date"], r["name"]) for r in got.collect()} == loop_training(rows, spans, date(2019, 3, 1), years, strict)
            assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    got = align.prediction_rows(df, sp)
    first = {d: name for name, _, a, b in spans for d in days if a <= d <= b}
    assert {r["d"]: r["name"] for r in got.collect()} == first
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_refit_periods_skip_dates_without_history(spark):
    cal = keys(spark, [date(2024, 1, 3), date(2024, 1, 4), date(2024, 2, 1), date(2024, 4, 1)])
    rows = calendar.refit_periods(cal, "monthly", "2024-01-01", "2024-12-31").orderBy("prediction_start").collect()
    assert [r["name"] for r in rows] == ["2024-02", "2024-04"]
    assert [r["train_cutoff"] for r in rows] == [date(2024, 1, 4), date(2024, 2, 1)]


def test_folds_never_train_on_unrealised_labels(spark):
    days = [d.date() for d in pd.bdate_range("2022-01-03", "2023-12-20")]
    rows = [(d, "a", 1.0, days[i + 2] if i + 2 < len(days) else None) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "d date, symbol string, label double, label_exit_date date")
    folds = wf.folds(df, "2023-01-01", "2023-12-31")
    assert folds.count() == 4
    late = align.training_rows(df, folds, "2000-01-01", strict=True).where("label_exit_date >= prediction_start").count()
    assert late == 0


def test_repeated_key_fails(spark):
    df = keys(spark, [day(0), day(0)])
    assert align.duplicate_keys(df).count() == 1
    try:
        align.require_unique(df).collect()
    except Exception as exc:  # noqa: BLE001
        assert "repeated key" in str(exc)
    else:
        raise AssertionError("a repeated key passed")
