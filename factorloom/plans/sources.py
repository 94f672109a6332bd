"""Section A: readers, each over files written from the tables into the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import quality
from factorloom.plans.inputs import FACTORS
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query
from factorloom.session import scratch_path
from factorloom.sources import readers, writers

FX_ROWS = ", ".join(f"{r(f)} AS {f}" for f in FACTORS)
# the 25 nations are a fixed, narrow axis for the wide files
NATIONS = [str(i) for i in range(25)]


def saved(p, df, name, suffix=".parquet"):
    path = scratch_path(p.spark, name) + suffix
    if suffix == ".csv":
        writers.write_csv(df, path)
    else:
        df.write.parquet(path)
    return path


def integer_date(column="d"):
    return F.date_format(column, "yyyyMMdd").cast("int")


def nation_rows(p):
    nation = p.table("supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("s_nationkey").cast("string").alias("nation"))
    return p.fx().join(nation, "symbol").groupBy("d", "nation").agg(F.sum("f_qty").alias("v"))


def by_nation(rows, value):
    return rows.groupBy("d").agg(*[F.max(F.when(F.col("nation") == n, F.col(value))).alias(n) for n in NATIONS])


NATION_SQL = """SELECT f.d, lpad(CAST(s_nationkey AS VARCHAR),6,'0') AS symbol, sum(f_qty) AS v FROM fx f JOIN supplier ON lpad(CAST(s_suppkey AS VARCHAR),6,'0') = f.symbol GROUP BY 1,2"""


@query("a01_wide_matrix", sql(f"SELECT d, symbol, {r('v')} AS value FROM ({NATION_SQL})", "fx"))
def wide_matrix(p):
    wide = by_nation(nation_rows(p), "v").withColumn("date", F.date_format("d", "yyyyMMdd")).drop("d")
    spoiled = wide.unionByName(wide.withColumn("date", F.concat(F.lit("x"), "date")))
    return readers.read_wide(p.spark, saved(p, spoiled, "wide")).where("value IS NOT NULL")


def factor_file(p):
    fx = p.fx()
    return saved(p, fx.select(F.col("symbol").cast("int").alias("ticker"), integer_date().alias("date"), *FACTORS), "factors")


@query("a02_one_factor", sql(f"SELECT d, symbol, {r('f_disc')} AS f_disc FROM fx", "fx"))
def one_factor(p):
    return readers.read_factor(p.spark, factor_file(p))


@query("a03_external_signal", sql(f"SELECT d, symbol, {r('f_disc*2')} AS signal FROM fx WHERE f_disc IS NOT NULL", "fx"))
def external_signal(p):
    fx = p.fx().select(F.col("symbol").alias("ticker"), integer_date().alias("date"), "f_disc")
    rows = fx.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({"note": F.lit("n"), "score": F.col("f_disc") * F.col("k")})
    ordered = rows.orderBy("ticker", "date", "k").select("date", "ticker", "note", "k", "score")
    return readers.read_signal(p.spark, saved(p, ordered, "signal", ".csv"))


@query("a04_prediction_folder", sql(f"SELECT d, symbol, {r('CASE WHEN f_ret > 0.3::DOUBLE THEN f_qty*10 ELSE f_qty END')} AS signal FROM fx", "fx"))
def prediction_folder(p):
    root = scratch_path(p.spark, "predictions")
    fx = p.fx().select(F.date_format("d", "yyyy-MM-dd").alias("date"), F.col("symbol").alias("ticker"), F.col("f_qty").alias("mean"), "f_ret")
    writers.write_csv(fx.drop("f_ret"), f"{root}/m1")
    writers.write_csv(fx.where("f_ret > 0.3").select("date", "ticker", (F.col("mean") * 10).alias("mean")), f"{root}/m2")
    return readers.read_predictions(p.spark, root)


def close_file(p):
    return saved(p, p.px_day().select(F.col("d").cast("timestamp").alias("TradingDate"), F.col("symbol").cast("int").alias("Stkcd"), "price"), "closes")


@query("a05_closes_from", sql(f"SELECT d, symbol, {r('price')} AS price FROM px_day WHERE d BETWEEN DATE '1996-02-20' AND DATE '1996-06-30'", "px_day"))
def closes_from(p):
    return readers.read_closes(p.spark, close_file(p), "1996-03-01", "1996-06-30")


@query("a06_closes_to", sql(f"SELECT d, symbol, {r('price')} AS price FROM px_day WHERE d BETWEEN DATE '1996-03-01' AND DATE '1996-07-10'", "px_day"))
def closes_to(p):
    return readers.read_closes(p.spark, close_file(p), "1996-03-01", "1996-06-30", 0, readers.LEAD_OUT_DAYS)


@query("a07_feature_panel", sql(f"""SELECT 'parquet' AS source, d, symbol, {r('f_disc')} AS f_disc, {r('f_ret')} AS f_ret FROM fx WHERE d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
    UNION ALL SELECT 'csv', d, symbol, {r('f_disc')}, {r('f_ret')} FROM fx WHERE d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""", "fx"))
def feature_panel(p):
    fx = p.fx().select(F.col("d").alias("TradingDate"), F.col("symbol").alias("Stkcd"), *FACTORS)
    by_csv = readers.read_panel(p.spark, saved(p, fx, "panel", ".csv"), "1996-01-01", "1997-12-31", ["f_disc", "f_ret"],
                                "TradingDate date, Stkcd string, f_disc double, f_qty double, f_tax double, f_ret double")
    by_parquet = readers.read_panel(p.spark, factor_file(p), "1996-01-01", "1997-12-31", ["f_disc", "f_ret"])
    return by_parquet.withColumn("source", F.lit("parquet")).unionByName(by_csv.withColumn("source", F.lit("csv")))


@query("a08_range_load", sql(f"SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date, CAST(symbol AS INT) AS ticker, {r('f_qty')} AS f_qty FROM fx WHERE d >= DATE '1997-06-01'", "fx"))
def range_load(p):
    return readers.load_range(p.spark.read.parquet(factor_file(p)), "1997-06-01", None, ["ticker", "f_qty"])


@query("a09_source_profile", sql("""SELECT 'factors' AS id, 'parquet' AS provider, count(*) AS rows, CAST(6 AS INT) AS columns, 'date' AS date_column, 'ticker' AS symbol_column,
    min(d) AS start, max(d) AS "end", true AS available, '' AS message FROM fx""", "fx"))
def source_profile(p):
    return readers.profile(p.spark.read.parquet(factor_file(p)), "factors")


@query("a10_source_catalogue", sql("""SELECT 'daily_alpha' AS id, true AS available, count(*) AS rows, min(d) AS start FROM fx UNION ALL SELECT 'closes', true, count(*), min(d) FROM px_day
    UNION ALL SELECT 'gone', false, NULL, NULL UNION ALL SELECT 'remote', false, NULL, NULL""", "fx", "px_day"))
def source_catalogue(p):
    catalog = readers.Catalog(p.spark)
    catalog.register("daily_alpha", factor_file(p)).register("closes", close_file(p))
    catalog.register("gone", scratch_path(p.spark, "none") + ".parquet").register("remote", "feed://daily")
    return catalog.profiles().select("id", "available", "rows", "start")


@query("a11_factor_catalogue", sql(" UNION ALL ".join(f"SELECT CAST({i} AS INT) AS ordinal, '{f}' AS name, 'daily' AS source, count({f}) AS \"values\" FROM fx"
                                                      for i, f in enumerate(FACTORS, 1)), "fx"))
def factor_catalogue(p):
    return readers.factor_catalog(p.spark.read.parquet(factor_file(p)), "daily")


@query("a12_available_signals", " UNION ALL ".join([f"SELECT 'factor:{f}' AS key, 'factor: {f}' AS label" for f in FACTORS]
                                                   + ["SELECT 'default_factor', 'default factor (f_disc)'", "SELECT 'ridge', 'model: ridge'", "SELECT 'trees', 'model: trees'"]))
def available_signals(p):
    root = scratch_path(p.spark, "signals")
    rows = p.fx().select(F.col("d").alias("date"), F.col("symbol").alias("ticker"), F.col("f_qty").alias("mean"))
    for model in ("ridge", "trees"):
        writers.write_csv(rows, f"{root}/{model}")
    return readers.available_signals(p.spark, factor_file(p), root)


@query("a13_industry_map", sql("SELECT symbol, CAST(NULL AS DATE) AS d, CAST(industry AS VARCHAR) AS industry FROM industry UNION ALL SELECT symbol, d, CAST(industry AS VARCHAR) FROM industry_dated",
                               "industry", "industry_dated"))
def industry_map(p):
    fixed = p.industry().select(F.col("symbol").cast("int").alias("Code"), F.col("industry").alias("Sector"))
    dated = p.industry_dated().select(F.col("symbol").alias("ticker"), F.col("d").alias("effective_date"), F.concat(F.lit(" "), F.col("industry").cast("string")).alias("industry"))
    a = readers.read_industry(p.spark, saved(p, fixed.unionByName(fixed), "industry", ".csv"))
    return quality.union_all([a, readers.read_industry(p.spark, saved(p, dated, "industry_dated"))])


@query("a14_trading_calendar", """SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE day(o_orderdate) % 5 <> 0""")
def trading_calendar(p):
    day = F.col("o_orderdate").cast("date")
    flag = F.when(F.dayofmonth(day) % 5 == 0, "0").when(F.dayofmonth(day) % 5 == 1, "True").when(F.dayofmonth(day) % 5 == 2, "t").otherwise("1")
    rows = p.table("orders").select(day.alias("calendarDate"), flag.alias("isOpen")).distinct()
    return readers.read_calendar(p.spark, saved(p, rows, "calendar", ".csv"))


@query("a15_benchmark_series", sql(f"SELECT d, {r('value')} AS value FROM benchmark", "benchmark"))
def benchmark_series(p):
    rows = p.benchmark().select(F.date_format("d", "yyyyMMdd").alias("date"), F.lit("idx").alias("code"), "value")
    return readers.read_benchmark(p.spark, saved(p, rows, "benchmark"))


@query("a16_pool_membership", sql(f"SELECT d, symbol, true AS member FROM ({NATION_SQL}) WHERE CAST(v AS BIGINT) % 2 = 0", "fx"))
def pool_membership(p):
    member = nation_rows(p).withColumn("member", F.col("v").cast("bigint") % 2 == 0)
    wide = by_nation(member, "member").withColumn("date", F.date_format("d", "yyyyMMdd")).drop("d")
    return readers.read_pool(p.spark, "A500", {"A500": saved(p, wide, "pool")})


@query("a17_factor_ingest", sql("SELECT count(*) AS rows, CAST(4 AS INT) AS features, min(d) AS start, max(d) AS \"end\" FROM fx", "fx"))
def factor_ingest(p):
    raw = saved(p, p.fx().select(F.col("d").alias("factor_date"), "symbol", *FACTORS, F.col("f_qty").alias("r_shift")), "upload", ".csv")
    return readers.ingest_factors(p.spark, raw, scratch_path(p.spark, "ingested") + ".parquet")


@query("a18_source_detection", sql("""SELECT 'daily_alpha' AS id, 'parquet' AS provider, 'daily' AS frequency, count(*) AS rows FROM fx
    UNION ALL SELECT 'monthly_calc', 'csv', 'monthly', count(*) FROM fx UNION ALL SELECT 'other', 'parquet', 'custom', count(*) FROM px_day""", "fx", "px_day"))
def source_detection(p):
    catalog = readers.Catalog(p.spark)
    catalog.register("daily_alpha", factor_file(p)).register("other", close_file(p))
    catalog.register("monthly_calc", saved(p, p.fx().select(F.col("d").alias("date"), F.col("symbol").alias("ticker"), "f_qty"), "monthly", ".csv"))
    return catalog.profiles().join(catalog.frequencies(), "id").select("id", "provider", "frequency", "rows")
