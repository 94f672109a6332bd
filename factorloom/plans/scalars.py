"""Section C: scalar functions, predicates and row filters."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from factorloom.functions import columns as c
from factorloom.operators import align, calendar, ic, series
from factorloom.plans.inputs import FACTORS, data, predictions
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query

@query("c01_symbol_normalise", """SELECT symbol, count(*) AS n FROM (
    SELECT CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_custkey AS VARCHAR),6,'0')
                ELSE lpad(CAST(o_custkey AS VARCHAR),6,'0') || '77' END AS symbol FROM orders) GROUP BY symbol""")
def symbol_normalise(p):
    key = F.col("o_custkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(key, F.lit(".0"))).otherwise(
        F.concat(F.lpad(key, 6, "0"), F.lit("77")))
    return p.table("orders").select(c.normal_symbol(raw).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("c02_date_parse", """SELECT d, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 4 THEN NULL
    ELSE CAST(o_orderdate AS DATE) END AS d FROM orders) GROUP BY d""")
def date_parse(p):
    day = F.col("o_orderdate").cast("date")
    kind = F.col("o_orderkey") % 5
    raw = (F.when(kind == 0, F.date_format(day, "yyyyMMdd")).when(kind == 1, F.date_format(day, "yyyy-MM-dd"))
           .when(kind == 2, F.concat(F.date_format(day, "yyyyMMdd"), F.lit(".0")))
           .when(kind == 3, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise("n/a"))
    return p.table("orders").select(c.parse_date(raw).alias("d")).groupBy("d").agg(F.count("*").alias("n"))


@query("c03_role_alias", f"""SELECT CAST(o_orderdate AS DATE) AS date, lpad(CAST(o_custkey AS VARCHAR),6,'0') AS symbol,
    {r('sum(o_totalprice)')} AS gross FROM orders GROUP BY 1,2""")
def role_alias(p):
    raw = p.table("orders").select(F.col("o_orderdate").cast("date").alias("TradingDate"),
                                   c.normal_symbol(F.col("o_custkey")).alias("Stkcd"), "o_totalprice")
    return c.with_roles(raw).groupBy("date", "symbol").agg(F.sum("o_totalprice").alias("gross"))


@query("c04_feature_columns", sql("""SELECT 'f_disc' AS feature, 1 AS position, count(f_disc) AS valid FROM fx
    UNION ALL SELECT 'f_qty', 2, count(f_qty) FROM fx UNION ALL SELECT 'f_tax', 3, count(f_tax) FROM fx
    UNION ALL SELECT 'f_ret', 4, count(f_ret) FROM fx""", "fx"))
def feature_columns(p):
    panel = p.fx().select(F.col("d").alias("factor_date"), "symbol", *FACTORS, F.col("f_tax").alias("r_shift"),
                          F.col("symbol").alias("note"))
    features = c.reject_lookahead(c.feature_columns(panel))
    position = F.create_map(*[x for i, f in enumerate(features, 1) for x in (F.lit(f), F.lit(i))])
    return ic.coverage(panel, features).select(F.col("factor").alias("feature"),
                                               position[F.col("factor")].alias("position"), "valid")


@query("c05_infinite_values", sql(f"""SELECT d, count(*) FILTER (WHERE f_ret = 0) AS infinite_cells,
    count(x) AS kept, {r('avg(x)')} AS mean FROM (SELECT d, f_ret, CASE WHEN f_ret <> 0 THEN f_qty/f_ret END AS x FROM fx)
    GROUP BY d""", "fx"))
def infinite_values(p):
    raw = p.fx().withColumn("x", F.when(F.col("f_ret") == 0, F.lit(float("inf"))).otherwise(F.try_divide("f_qty", "f_ret")))
    clean = c.finite(F.col("x"))
    return raw.groupBy("d").agg(F.count(F.when(c.is_infinite(F.col("x")), 1)).alias("infinite_cells"),
                                F.count(clean).alias("kept"), F.avg(clean).alias("mean"))


@query("c06_real_price", sql(f"SELECT p.d, p.symbol, {r('p.price/a.adj')} AS real FROM px p JOIN adj a "
                             "ON a.d = p.d AND a.symbol = p.symbol", "px", "adj"))
def real_price(p):
    return p.px().join(p.adj(), ["d", "symbol"]).select(
        "d", "symbol", c.real_price(F.col("price"), F.col("adj")).alias("real"))


BOARD = """CASE o_custkey % 10 WHEN 0 THEN '688' WHEN 1 THEN '300' ELSE '600' END
    || lpad(CAST(o_custkey % 1000 AS VARCHAR),3,'0')"""


def board_symbol(key):
    head = F.when(key % 10 == 0, "688").when(key % 10 == 1, "300").otherwise("600")
    return F.concat(head, F.lpad((key % 1000).cast("string"), 3, "0"))


@query("c07_lot_shares", f"""SELECT order_id, symbol, CAST(CASE WHEN symbol LIKE '688%' THEN 200 ELSE 100 END AS INT) AS lot,
    CAST(floor(o_totalprice / 7 / CASE WHEN symbol LIKE '688%' THEN 200 ELSE 100 END)
      * CASE WHEN symbol LIKE '688%' THEN 200 ELSE 100 END AS BIGINT) AS shares
    FROM (SELECT o_orderkey AS order_id, o_totalprice, {BOARD} AS symbol FROM orders)""")
def lot_shares(p):
    rows = p.table("orders").select(F.col("o_orderkey").alias("order_id"), board_symbol(F.col("o_custkey")).alias("symbol"),
                                    (F.col("o_totalprice") / 7).alias("wanted"))
    symbol = F.col("symbol")
    return rows.select("order_id", "symbol", c.lot_size(symbol).alias("lot"),
                       c.lot_shares(F.col("wanted"), symbol).alias("shares"))


FEE_SQL = """greatest(gross*0.0003::DOUBLE, 5) + gross*0.00001::DOUBLE + CASE WHEN side='SELL' THEN
    gross * CASE WHEN d >= DATE '1998-01-01' THEN 0.0005::DOUBLE ELSE 0.001::DOUBLE END ELSE 0 END"""


@query("c08_transaction_fee", sql(f"SELECT order_id, {r(FEE_SQL)} AS fee, {r('gross*0.001::DOUBLE')} AS flat FROM ledger",
                                  "ledger"))
def transaction_fee(p):
    args = (F.col("d"), F.col("side"), F.col("gross"))
    return p.ledger().select("order_id", c.transaction_fee(*args, cutover="1998-01-01").alias("fee"),
                             c.transaction_fee(*args, flat_rate=0.001).alias("flat"))


@query("c09_tradeable", sql("""SELECT d, symbol, prev IS NULL OR NOT (price/prev-1 >= lim-1e-6 OR price/prev-1 <= -lim+1e-6)
      AS can_sell, (prev IS NULL OR NOT (price/prev-1 >= lim-1e-6 OR price/prev-1 <= -lim+1e-6)) AND NOT st AS can_buy
    FROM (SELECT a.d, a.symbol, a.price, b.price AS prev, s.st, CASE WHEN CAST(a.symbol AS INT) % 2 = 0 THEN 0.20 ELSE 0.10 END AS lim
      FROM pxi a LEFT JOIN pxi b ON b.symbol = a.symbol AND b.idx = a.idx-1 JOIN st s ON s.symbol = a.symbol AND s.d = a.d)""",
                            "pxi", "st"))
def tradeable(p):
    rows = calendar.with_index(p.px(), p.sessions()).withColumn("prev", series.at_offset("price", -1))
    board = F.concat(F.when(F.col("symbol").cast("int") % 2 == 0, "300").otherwise("600"), F.substring("symbol", 4, 3))
    args = (F.col("price"), F.col("prev"), board, F.col("st"))
    return rows.join(p.st(), ["d", "symbol"]).select("d", "symbol", c.tradeable(*args, "sell").alias("can_sell"),
                                                     c.tradeable(*args, "buy").alias("can_buy"))


@query("c10_age_weight", sql(f"""SELECT d, symbol, {r("exp(-ln(2)*(datediff('day', d, DATE '1999-01-01')/365.25*252)/252)")} AS w,
    {r("exp(-ln(2)*(datediff('day', d, DATE '1999-01-01')/365.25*252)/252)*(1+greatest(label,0))")} AS w_margin
    FROM data WHERE label IS NOT NULL""", "data"))
def age_weight(p):
    age = F.datediff(F.lit("1999-01-01").cast("date"), F.col("d"))
    w = c.age_weight(age)
    return data(p).where("label IS NOT NULL").select(
        "d", "symbol", w.alias("w"), (w * (1 + F.greatest(F.col("label"), F.lit(0.0)))).alias("w_margin"))


METRICS_SQL = """SELECT model, avg(rank_ic) AS mean_rank_ic, avg(pearson_ic) AS pearson_ic FROM ic GROUP BY model"""
SPREAD_SQL = """SELECT model, avg(label) FILTER (WHERE b = 4) AS top, avg(label) FILTER (WHERE b = 0) AS bottom FROM (
    SELECT *, CASE WHEN n = 1 THEN 0 ELSE greatest(((pos-1)*5 + n-2)//(n-1) - 1, 0) END AS b FROM pairs) GROUP BY model"""


@query("c11_selection_score", sql(f"""SELECT m.model,
    {r('0.4*mean_rank_ic + 0.2*pearson_ic + 0.4*tanh((top-bottom)*5.0)')} AS score FROM m JOIN s ON s.model = m.model""",
                                  "ic", extra={"m": METRICS_SQL, "s": SPREAD_SQL}))
def selection_score(p):
    m = ic.metric_summary(predictions(p), slices=p.slices())
    return m.select("model", c.selection_score(F.col("mean_rank_ic"), F.col("pearson_ic"),
                                               F.col("top_bottom_return")).alias("score"))


@query("c12_period_keys", sql("""SELECT d, CAST(date_trunc('week', d) AS DATE) AS week, CAST(date_trunc('month', d) AS DATE) AS month,
    CAST(date_trunc('quarter', d) AS DATE) AS quarter, (row_number() OVER (ORDER BY d) - 1)//2 AS pair
    FROM (SELECT DISTINCT d FROM px_day)""", "px_day"))
def period_keys(p):
    cal = calendar.sessions(p.px_day())
    d = F.col("d")
    return cal.select("d", c.period_key(d, "weekly").alias("week"), c.period_key(d, "monthly").alias("month"),
                      c.period_key(d, "quarterly").alias("quarter"), F.floor((F.col("idx") - 1) / 2).alias("pair"))


def _embargo_sql(table: str, kind: str) -> str:
    return f"""SELECT '{kind}' AS calendar, {r('median(g)')} AS median_gap,
    CAST(greatest(1, ceil(20/greatest(1, median(g)*252/365.25))) AS INT) AS observations FROM (
    SELECT CAST(d - lag(d) OVER (ORDER BY d) AS DOUBLE) AS g FROM (SELECT DISTINCT d FROM {table}))"""


@query("c13_embargo", sql(_embargo_sql("px_day", "daily") + " UNION ALL " + _embargo_sql("px", "monthly"), "px", "px_day"))
def embargo(p):
    daily = calendar.embargo_observations(p.px_day(), 20).withColumn("calendar", F.lit("daily"))
    return daily.unionByName(calendar.embargo_observations(p.px(), 20).withColumn("calendar", F.lit("monthly")))


@query("c14_qp_exposure", sql(f"""SELECT d, n AS observations, {r('mult')} AS risk_multiplier,
    {r('free')} AS unconstrained_exposure,
    {r('CASE WHEN n < 10 THEN 0.9 ELSE least(greatest(free, 0.8), 1.0) END')} AS target_exposure
    FROM (SELECT *, CASE WHEN n < 10 THEN 0.9::DOUBLE ELSE (greatest(mean,0) + 0.0025*0.9)/(4.0*mult*greatest(down,1e-12)+0.0025) END AS free
    FROM (SELECT *, CASE WHEN n < 10 THEN 1.0::DOUBLE ELSE 1.0 + 4.0*pow(greatest(-dd,0)/0.2,2)
            + CASE WHEN month(d) = 12 THEN 2.0 ELSE 0 END END AS mult
    FROM (SELECT d, count(ret) OVER w AS n, avg(ret) OVER w AS mean, avg(CASE WHEN ret IS NOT NULL THEN pow(least(ret,0),2) END) OVER w AS down,
        value/max(value) OVER (ORDER BY d)-1 AS dd FROM (SELECT *, value/lag(value) OVER (ORDER BY d)-1 AS ret FROM benchmark)
        WINDOW w AS (ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))))""", "benchmark"))
def qp_exposure(p):
    order = Window.orderBy("d")
    recent = order.rowsBetween(-(c.QP_LOOKBACK - 1), 0)
    rets = p.benchmark().withColumn("ret", F.col("value") / F.lag("value").over(order) - 1)
    fall = F.least(F.col("ret"), F.lit(0.0))
    down = F.avg(F.when(F.col("ret").isNotNull(), fall * fall)).over(recent)
    rows = rets.select("d", F.count("ret").over(recent).alias("observations"), F.avg("ret").over(recent).alias("mean"),
                       down.alias("down"), (F.col("value") / F.max("value").over(order) - 1).alias("dd"))
    mult, free, target = c.qp_exposure(F.col("mean"), F.col("down"), F.col("dd"), F.lit(0.9), F.month("d") == 12,
                                       F.col("observations"))
    return rows.select("d", "observations", mult.alias("risk_multiplier"), free.alias("unconstrained_exposure"),
                       target.alias("target_exposure"))


@query("c15_missing_factor_rows", sql("""SELECT count(*) FILTER (WHERE a IS NULL) + count(*) FILTER (WHERE b IS NULL)
      AS original_missing, count(*) FILTER (WHERE a IS NULL AND b IS NULL) AS rows_dropped,
    count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS partial_rows_kept,
    count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS partial_cells_kept
    FROM (SELECT f_disc AS a, CASE WHEN f_ret > 0 THEN f_ret END AS b FROM fx)""", "fx"))
def missing_factor_rows(p):
    rows = p.fx().select(F.col("f_disc").alias("a"), F.when(F.col("f_ret") > 0, F.col("f_ret")).alias("b"))
    gaps = F.col("a").isNull().cast("int") + F.col("b").isNull().cast("int")
    kept = c.any_not_null(["a", "b"])
    return rows.agg(F.sum(gaps).alias("original_missing"), F.count(F.when(~kept, 1)).alias("rows_dropped"),
                    F.count(F.when(kept & (gaps > 0), 1)).alias("partial_rows_kept"),
                    F.sum(F.when(kept, gaps).otherwise(0)).alias("partial_cells_kept"))


@query("c16_duplicate_keys", sql("SELECT d, symbol, count(*) AS copies FROM ledger GROUP BY 1,2 HAVING count(*) > 1", "ledger"))
def duplicate_keys(p):
    return align.duplicate_keys(p.ledger())


HOLIDAY = """SELECT symbol, d, price FROM px UNION ALL
    SELECT symbol, CAST(d + INTERVAL 10 DAY AS DATE), price FROM px WHERE month(d) = 1"""


@query("c17_changed_sessions", sql("SELECT DISTINCT d FROM px", "px"))
def changed_sessions(p):
    # a January copy ten days on stands for a holiday that repeats the last cross-section
    px = p.px().withColumn("price", F.round("price", 6))
    return calendar.changed_sessions(px.unionByName(px.where(F.month("d") == 1).withColumn("d", F.date_add("d", 10))))


@query("c18_range_coverage", sql("""SELECT count(DISTINCT d) AS dates, count(DISTINCT symbol) AS symbols,
    count(DISTINCT d) >= 2 AND count(DISTINCT symbol) >= 20 AS enough FROM px
    WHERE d BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'""", "px"))
def range_coverage(p):
    rows = p.px().where(F.col("d").between(F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date")))
    return align.common_keys([rows], 2, 20)[2]


@query("c19_finite_labels", sql(f"""SELECT d, count(*) AS n, {r('sum(w)')} AS weight FROM (SELECT d, label,
    CASE WHEN f_ret > 0 THEN 1/f_ret END AS w FROM data) WHERE label IS NOT NULL AND w IS NOT NULL GROUP BY d""", "data"))
def finite_labels(p):
    weight = F.when(F.col("f_ret") > 0, 1 / F.col("f_ret")).otherwise(F.lit(float("nan")))
    rows = data(p).withColumn("w", weight)
    usable = c.finite(F.col("label")).isNotNull() & c.finite(F.col("w")).isNotNull()
    return rows.where(usable).groupBy("d").agg(F.count("*").alias("n"), F.sum("w").alias("weight"))
