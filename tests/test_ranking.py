import numpy as np
import pandas as pd
from conftest import day
from pyspark.sql import functions as F

from factorloom.operators import cross_section as xs, ic, ranking, selection
from factorloom.operators.spread import attach


def panel(spark, seed=0):
    """One date holds most rows; values tie often, one value holds a third of the hot date, some are missing."""
    rng = np.random.default_rng(seed)
    rows = []
    for d, n in ((0, 60), (1, 7), (2, 1), (3, 3)):
        for i in range(n):
            v = None if rng.random() < 0.1 else (0.5 if i % 3 == 0 else float(rng.integers(0, 12)))
            rows.append((day(d), f"{i:06d}", v, float(rng.normal())))
    return spark.createDataFrame(rows, "d date, symbol string, v double, w double")


def ranks(df):
    out = ranking.add_rank(df, ("d",), "v").orderBy("d", "symbol").toPandas()
    return out


def expected(df):
    pdf = df.orderBy("d", "symbol").toPandas()
    g = pdf.groupby("d").v
    pdf["first"] = g.rank(method="first")
    pdf["lo"], pdf["hi"], pdf["n"] = g.rank(method="min"), g.rank(method="max"), g.transform("count")
    return pdf


def same(a, b):
    np.testing.assert_array_equal(np.nan_to_num(a.astype(float), nan=-1), np.nan_to_num(b.astype(float), nan=-1))


def check(df):
    got, want = ranks(df), expected(df)
    for column, name in (("rk_pos", "first"), ("rk_lo", "lo"), ("rk_hi", "hi"), ("rk_n", "n")):
        same(got[column].to_numpy(), want[name].to_numpy())


def test_window_ranks_match_pandas(spark):
    check(panel(spark))


def test_sliced_ranks_match_pandas(spark, sliced):
    df = panel(spark)
    assert ranking.needs_slices(df, ("d",)) > 2
    check(df)


def test_descending_and_global_ranks(spark, sliced):
    df = panel(spark)
    pdf = df.toPandas()
    got = ranking.add_rank(df, (), "v", ("symbol", "d"), ascending=False).toPandas()
    want = got.v.rank(method="max", ascending=False)
    same(got.rk_hi.to_numpy(), want.to_numpy())
    assert set(got.rk_n) == {pdf.v.notna().sum()}
    assert sorted(got.rk_pos.dropna()) == list(range(1, int(pdf.v.notna().sum()) + 1))


def test_daily_ic_same_on_both_paths(spark):
    df = panel(spark)
    plain = ic.daily_ic(df, ("d",), "v", "w", slices=0).orderBy("d").toPandas()
    cut = ic.daily_ic(df, ("d",), "v", "w", slices=9).orderBy("d").toPandas()
    pd.testing.assert_frame_equal(plain, cut)
    pdf = df.toPandas().dropna()
    for _, row in plain.iterrows():
        g = pdf[pdf.d == row.d]
        if len(g) > 2:
            assert abs(row.rank_ic - g.v.rank().corr(g.w.rank())) < 1e-12
            assert abs(row.pearson_ic - g.v.corr(g.w)) < 1e-12


def test_sizes_are_measured_on_rows(spark, sliced):
    df = panel(spark)
    assert ranking.largest_group(df, ("d",)) == (60, 71)
    assert ranking.needs_slices(df.where("d <> DATE '2024-01-01' AND symbol < '000004'"), ("d",)) == 0


def test_bucket_is_integer_arithmetic(spark):
    n = 23
    df = spark.createDataFrame([(day(0), f"{i:06d}", float(i)) for i in range(n)], "d date, symbol string, v double")
    got = xs.quantile_bucket(df, "v", 5).orderBy("v").toPandas().bucket.to_numpy()
    # qcut puts rank r at the first edge 1 + k*(n-1)/5 that is not below it
    edges = [1 + k * (n - 1) / 5 for k in range(1, 6)]
    want = [next(k for k, e in enumerate(edges) if r <= e + 1e-9) for r in range(1, n + 1)]
    assert got.tolist() == want
    one = spark.createDataFrame([(day(0), "a", 1.0)], "d date, symbol string, v double")
    assert xs.quantile_bucket(one, "v", 10).first()["bucket"] == 0


def test_group_quantile_matches_numpy_on_both_paths(spark):
    df = panel(spark)
    pdf = df.toPandas().dropna()
    for slices in (0, 7):
        got = {r["d"]: r for r in ranking.group_quantile(df, ("d",), "v", {"hi": 0.9, "lo": 0.1}, slices=slices).collect()}
        for d, g in pdf.groupby("d"):
            assert abs(got[d]["hi"] - np.quantile(g.v, 0.9)) < 1e-9
            assert abs(got[d]["lo"] - np.quantile(g.v, 0.1)) < 1e-9


def test_even_sample_on_both_paths(spark):
    df = spark.createDataFrame([(day(i // 10), f"{i % 10:06d}", i) for i in range(97)], "d date, symbol string, k int")
    want = sorted({int(np.floor(j * 96 / 12)) for j in range(13)})
    for slices in (0, 6):
        assert sorted(r["k"] for r in ranking.even_sample(df, ("d", "symbol"), 13, slices).collect()) == want
    assert ranking.even_sample(df, ("d", "symbol"), 200, 0).count() == 97


def test_top_quantile_on_both_paths(spark):
    df = panel(spark).withColumnRenamed("w", "score")
    a = selection.top_quantile(df, 0.1, slices=0).select("d", "symbol", "rank")
    b = selection.top_quantile(df, 0.1, slices=8).select("d", "symbol", "rank")
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.groupBy("d").count().where("count < 1").count() == 0


def test_attach_gives_the_same_rows_broadcast_or_not(spark):
    df = panel(spark)
    means = df.groupBy("d").agg(F.avg("w").alias("m"))
    small = attach(df, means, ["d"]).select("d", "symbol", "m").collect()
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffled = attach(df, means, ["d"]).select("d", "symbol", "m").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert sorted(small) == sorted(shuffled) and len(small) == 71


ODD = [1.0, float("nan"), 3.0, 2.0, 0.0, -0.0, None, float("inf"), float("-inf"), 3.0]


def odd_panel(spark):
    return spark.createDataFrame([(day(0), f"{i:06d}", v) for i, v in enumerate(ODD)], "d date, symbol string, score double")


def test_both_forms_rank_odd_values_alike(spark):
    df = odd_panel(spark)
    for ascending in (True, False):
        rows = [{r.symbol: (r.rk_pos, r.rk_lo, r.rk_hi, r.rk_n) for r in ranking.add_rank(df, ("d",), "score", ascending=ascending, slices=s).collect()}
                for s in (0, 3)]
        assert rows[0] == rows[1]
        assert rows[0]["000001"][:3] == rows[0]["000006"][:3] == (None,) * 3 and rows[0]["000000"][3] == 8
        assert rows[0]["000004"][1:3] == rows[0]["000005"][1:3]  # both zeros tie
        assert rows[0]["000007"][0] == (8 if ascending else 1)


def test_one_order_for_every_n(spark):
    df = odd_panel(spark)
    best, worst = (["000002", "000009", "000003", "000000", "000004", "000005"],
                   ["000001", "000006", "000008", "000004", "000005", "000000", "000003", "000002", "000009", "000007"])
    for n in (1, 2, 5, 999, 1000, 1001, 5000):
        got = {r.symbol: r["rank"] for r in selection.top_n(df, n).collect()}
        assert got == {s: i + 1 for i, s in enumerate(best[:n])}
        low = {r.symbol: r["rank"] for r in selection.worst_n(df, n).collect()}
        assert low == {s: i + 1 for i, s in enumerate(worst[:n])}


def test_whole_smallest_number_ranks(spark):
    df = spark.createDataFrame([(day(0), "a", -2**63), (day(0), "b", 5)], "d date, symbol string, k long")
    for slices in (0, 2):
        assert {r.symbol: r.rk_pos for r in ranking.add_rank(df, ("d",), "k", ascending=False, slices=slices).collect()} == {"a": 2, "b": 1}


def test_consensus_same_on_both_paths(spark):
    rng = np.random.default_rng(3)
    rows = [(day(0), f"{i:06d}", s, float(rng.normal())) for i in range(40) for s in ("a", "b", "c")]
    df = spark.createDataFrame(rows, "d date, symbol string, style string, x double")
    a, b = (xs.consensus(df, slices=s).orderBy("symbol").toPandas() for s in (0, 10))
    pd.testing.assert_frame_equal(a, b)
    wide = df.toPandas().pivot(index="symbol", columns="style", values="x")
    buy = ((wide >= wide.quantile(0.9)) & (wide > 0)).sum(axis=1)
    sell = ((wide <= wide.quantile(0.1)) & (wide < 0)).sum(axis=1)
    assert a.buy_votes.tolist() == buy.tolist() and a.sell_votes.tolist() == sell.tolist()
