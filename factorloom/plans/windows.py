"""Section F: ranks, windows and rolling statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import columns as c
from factorloom.operators import calendar, cross_section as xs, ic, portfolio, ranking, series, style
from factorloom.plans.aggregates import METRIC_CTES, STD, STYLE_CTES, style_returns
from factorloom.plans.inputs import FACTORS, data, kept, predictions
from factorloom.plans.joins import LONG, exposures
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query


@query("f01_zscore", sql(f"""SELECT d, symbol, {r('greatest(least((f_disc-avg(f_disc) OVER w)/nullif(stddev_pop(f_disc) OVER w,0),5),-5)')} AS z_disc0,
    {r('CASE WHEN f_ret IS NULL THEN NULL ELSE greatest(least((f_ret-avg(f_ret) OVER w)/nullif(stddev_pop(f_ret) OVER w,0),5),-5) END')} AS z_ret,
    f_disc IS NULL AS gap FROM fx WINDOW w AS (PARTITION BY d)""", "fx").replace(
        "round(greatest(least((f_disc-avg(f_disc)", "round(CASE WHEN f_disc IS NULL THEN NULL ELSE greatest(least((f_disc-avg(f_disc)").replace(
        "OVER w,0),5),-5),8)+0.0 AS z_disc0", "OVER w,0),5),-5) END,8)+0.0 AS z_disc"))
def zscore(p):
    z = xs.zscore(p.fx(), ["f_disc", "f_ret"])
    return z.select("d", "symbol", F.col("f_disc").alias("z_disc"), F.col("f_ret").alias("z_ret"), F.col("f_disc").isNull().alias("gap"))


@query("f02_standardise", sql("SELECT d, symbol, " + ", ".join(f"{r(f)} AS {f}" for f in FACTORS) + " FROM zx", "fx", extra=STD))
def standardise(p):
    return xs.standardise(p.fx(), FACTORS)


@query("f03_average_rank", sql(f"""SELECT d, symbol, {r('a')} AS avg_rank, {r('a/n')} AS pct_rank FROM (SELECT d, symbol,
    rank() OVER (PARTITION BY d ORDER BY f_qty) + (count(*) OVER (PARTITION BY d, f_qty)-1)/2.0::DOUBLE AS a, count(*) OVER (PARTITION BY d) AS n FROM fx)""", "fx"))
def average_rank(p):
    ranked = ranking.add_rank(p.fx(), ("d",), "f_qty", slices=p.slices())
    return ranked.select("d", "symbol", ranking.average().alias("avg_rank"), ranking.percent().alias("pct_rank"))


def _bucket(q: int) -> str:
    return f"CAST(CASE WHEN n = 1 THEN 0 ELSE greatest(((k-1)*{q} + n-2)//(n-1) - 1, 0) END AS INT)"


@query("f04_quantile_buckets", sql(f"""SELECT d, symbol, {_bucket(3)} AS b3, {_bucket(5)} AS b5, {_bucket(10)} AS b10 FROM (
    SELECT d, symbol, row_number() OVER (PARTITION BY d ORDER BY f_ret, symbol) AS k, count(*) OVER (PARTITION BY d) AS n FROM fx)""", "fx"))
def quantile_buckets(p):
    ranked = ranking.add_rank(p.fx(), ("d",), "f_ret", slices=p.slices())
    return ranked.select("d", "symbol", *[ranking.bucket(q).alias(f"b{q}") for q in (3, 5, 10)])


def indexed(p):
    return calendar.with_index(p.px(), p.sessions())


@query("f05_forward_return", sql(f"""SELECT x.d, x.symbol, {r('b.price/a.price-1')} AS forward_5 FROM pxi x
    LEFT JOIN pxi a ON a.symbol = x.symbol AND a.idx = x.idx+1 LEFT JOIN pxi b ON b.symbol = x.symbol AND b.idx = x.idx+6""", "pxi"))
def forward_return(p):
    return indexed(p).select("d", "symbol", series.forward_return(5).alias("forward_5"))


@query("f06_price_change", sql(f"""SELECT x.d, x.symbol, {r('x.price/a.price-1')} AS change_1, {r('x.price/b.price-1')} AS change_12 FROM pxi x
    LEFT JOIN pxi a ON a.symbol = x.symbol AND a.idx = x.idx-1 LEFT JOIN pxi b ON b.symbol = x.symbol AND b.idx = x.idx-12""", "pxi"))
def price_change(p):
    return indexed(p).select("d", "symbol", series.change(1).alias("change_1"), series.change(12).alias("change_12"))


@query("f07_compounded_nav", sql(f"""SELECT d, symbol, {r('exp(sum(ln(1+coalesce(ret,0))) OVER (PARTITION BY symbol ORDER BY d))')} AS nav FROM (
    SELECT x.d, x.symbol, (x.price/a.price-1)/10 AS ret FROM pxi x LEFT JOIN pxi a ON a.symbol = x.symbol AND a.idx = x.idx-1)""", "pxi"))
def compounded_nav(p):
    rets = indexed(p).select("d", "symbol", (series.change(1) / 10).alias("ret"))
    return rets.select("d", "symbol", series.compounded(F.col("ret"), series.running(("symbol",), "d")).alias("nav"))


@query("f08_drawdown", sql(f"""SELECT d, symbol, {r('price/max(price) OVER (PARTITION BY symbol ORDER BY d)-1')} AS drawdown FROM px""", "px"))
def drawdown(p):
    return p.px().select("d", "symbol", series.drawdown(F.col("price"), series.running(("symbol",), "d")).alias("drawdown"))


FEATURES = """SELECT z.d, z.style, avg(style_return) FILTER (WHERE k <= 5) AS momentum_5, avg(style_return) FILTER (WHERE k <= 20) AS momentum_20,
    stddev_pop(style_return) FILTER (WHERE k <= 5) AS volatility_5, max(style_exit_date) AS max_information_date FROM (
      SELECT t.d, t.style, s.style_return, s.style_exit_date, row_number() OVER (PARTITION BY t.d, t.style ORDER BY s.d DESC) AS k
      FROM (SELECT c.d, n.style FROM (SELECT DISTINCT d FROM fx) c, (SELECT DISTINCT style FROM sret) n) t
      LEFT JOIN sret s ON s.style = t.style AND s.style_exit_date <= t.d) z GROUP BY z.d, z.style"""


def timing(p):
    return kept(style.timing_features(style_returns(p), p.sessions(), sorted(FACTORS)))


@query("f09_style_timing_features", sql(f"""SELECT d, style, {r('momentum_5')} AS momentum_5, {r('momentum_20')} AS momentum_20,
    {r('volatility_5')} AS volatility_5, max_information_date FROM ft""", "data", extra={**STYLE_CTES, "ft": FEATURES}))
def style_timing_features(p):
    return timing(p)


BENCH = """SELECT d, stddev_pop(ret) OVER w AS vol, exp(sum(ln(1+ret)) OVER w)-1 AS ret20 FROM (
    SELECT d, value/lag(value) OVER (ORDER BY d)-1 AS ret FROM benchmark) WINDOW w AS (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


@query("f10_benchmark_features", sql(f"SELECT d, {r('vol')} AS benchmark_volatility, {r('ret20')} AS benchmark_return FROM bf", "benchmark", extra={"bf": BENCH}))
def benchmark_features(p):
    return style.benchmark_features(p.benchmark())


def horizon_cte(h: int) -> str:
    return f"""SELECT d, style, target, label_exit_date FROM (SELECT *, count(*) OVER (PARTITION BY d) AS ns, max(ex) OVER (PARTITION BY d) AS label_exit_date FROM (
      SELECT a.d, a.style, count(*) AS n, product(1+b.style_return)-1 AS target, max(b.style_exit_date) AS ex
      FROM si a JOIN si b ON b.style = a.style AND b.k BETWEEN a.k AND a.k+{h - 1} GROUP BY a.d, a.style HAVING count(*) = {h})) WHERE ns = 4"""


SI = "SELECT *, dense_rank() OVER (ORDER BY d) AS k FROM sret"


@query("f11_horizon_labels", sql(f"SELECT d, style, {r('target')} AS target, label_exit_date FROM hl", "data",
                                 extra={**STYLE_CTES, "si": SI, "hl": horizon_cte(5)}))
def horizon_labels(p):
    return style.horizon_labels(style_returns(p), 5, FACTORS)


@query("f12_best_style", sql(f"""SELECT d, max(style) FILTER (WHERE k = 1) AS best_style, {r('max(target) FILTER (WHERE k = 1) - max(target) FILTER (WHERE k = 2)')} AS winner_margin,
    max(label_exit_date) AS label_exit_date FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY target DESC, style) AS k FROM hl) GROUP BY d""", "data",
                             extra={**STYLE_CTES, "si": SI, "hl": horizon_cte(5)}))
def best_style(p):
    return style.winners(style.horizon_labels(style_returns(p), 5, FACTORS))


@query("f13_rank_turnover", sql(f"SELECT model, {r('avg(turnover)')} AS turnover FROM turn GROUP BY model", "pairs",
                                extra={k: METRIC_CTES[k] for k in ("mv", "turn")}))
def rank_turnover(p):
    valid = predictions(p).where("prediction IS NOT NULL AND label IS NOT NULL")
    ranked = ranking.add_rank(valid, ("model", "d"), "prediction", prefix="rp", slices=p.slices())
    return ic.rank_change(ranked, valid, ("model",)).groupBy("model").agg(F.avg("turnover").alias("turnover"))


STATE = """SELECT d, (SELECT avg(CASE WHEN o.vol <= b.vol THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM bf o WHERE o.d <= b.d AND o.vol IS NOT NULL) AS vp,
    abs(coalesce(ret20,0))/greatest(vol*sqrt(20),1e-6) AS ts FROM bf b WHERE vol IS NOT NULL"""


@query("f14_market_state", sql(f"SELECT d, {r('vp')} AS volatility_percentile, {r('ts')} AS trend_strength FROM ms", "benchmark",
                               extra={"bf": BENCH, "ms": STATE}))
def market_state(p):
    return style.market_state(p.benchmark())


IC_HISTORY = "SELECT i.model, i.d, i.rank_ic, (SELECT max(x.label_exit_date) FROM lab x WHERE x.d = i.d) AS ex FROM ic i WHERE rank_ic IS NOT NULL"


def rolling_cte(w: int) -> str:
    return f"""SELECT model, d, avg(rank_ic) AS m, stddev_samp(rank_ic) AS s, count(rank_ic) AS n, max(ex) AS info FROM (
      SELECT c.model, c.d, h.rank_ic, h.ex, row_number() OVER (PARTITION BY c.model, c.d ORDER BY h.d DESC) AS k
      FROM (SELECT DISTINCT model, d FROM pred) c LEFT JOIN hist h ON h.model = c.model AND h.ex < c.d) WHERE k <= {w} GROUP BY model, d"""


def ic_history(p, rows=None):
    rows = predictions(p) if rows is None else rows
    valid = rows.where("prediction IS NOT NULL AND label IS NOT NULL")
    exits = valid.groupBy("model", "d").agg(F.max("label_exit_date").alias("label_exit_date"))
    return kept(ic.daily_ic(valid, ("model", "d"), slices=p.slices()).join(calendar.calendar_broadcast(exits), ["model", "d"]))


@query("f15_rolling_icir", sql(f"""SELECT model, d, {r('m')} AS rolling_ic, {r('CASE WHEN n > 0 THEN coalesce(CASE WHEN s > 1e-12 THEN m/s END, 0) END')} AS rolling_icir,
    n AS observations, info AS information_date, {r('CASE WHEN n >= 10 THEN greatest(coalesce(CASE WHEN s > 1e-12 THEN m/s END, 0), 0) ELSE 0.02 END')} AS strength FROM rl""", "ic",
                               extra={"hist": IC_HISTORY, "rl": rolling_cte(12)}))
def rolling_icir(p):
    rows = predictions(p)
    rolled = style.rolling_reliability(ic_history(p, rows), rows.select("model", "d").distinct(), 12, ("model",))
    return rolled.withColumn("strength", style.reliability("rolling_icir", "observations", 0.02, 12))


@query("f16_restandardised_score", sql(f"""SELECT d, symbol, {r('CASE WHEN s > 1e-12 THEN (x-m)/s ELSE 0 END')} AS score FROM (
    SELECT d, symbol, x, avg(x) OVER (PARTITION BY d) AS m, stddev_pop(x) OVER (PARTITION BY d) AS s FROM (
      SELECT d, symbol, CASE WHEN month(d) = 2 THEN 3.0::DOUBLE ELSE f_qty*f_tax END AS x FROM fx))""", "fx"))
def restandardised_score(p):
    flat = p.fx().select("d", "symbol", F.when(F.month("d") == 2, 3.0).otherwise(F.col("f_qty") * F.col("f_tax")).alias("score"))
    return xs.zscore(flat, ["score"], limit=None, zero_spread="center")


@query("f17_horizon_weights", sql(f"""SELECT d, {r('CASE WHEN a+b > 1e-12 THEN a/(a+b) WHEN fa+fb > 1e-12 THEN fa/(fa+fb) ELSE 1 END')} AS weight_5,
    {r('CASE WHEN a+b > 1e-12 THEN b/(a+b) WHEN fa+fb > 1e-12 THEN fb/(fa+fb) ELSE 1 END')} AS weight_20, a+b <= 1e-12 AS risk_off FROM (
    SELECT q.d, CASE WHEN q.n >= 10 THEN greatest(coalesce(CASE WHEN q.s > 1e-12 THEN q.m/q.s END,0),0) ELSE 0.02 END*qk AS a,
      CASE WHEN t.n >= 10 THEN greatest(coalesce(CASE WHEN t.s > 1e-12 THEN t.m/t.s END,0),0) ELSE 0.01 END*sl AS b, 0.02*qk AS fa, 0.01*sl AS fb
    FROM (SELECT *, 0.5+coalesce(vp,0.5) AS qk, 0.5+least(coalesce(ts,0),1.5) AS sl FROM (SELECT c.d, vp, ts FROM (SELECT DISTINCT d FROM pred) c LEFT JOIN ms ON ms.d = c.d)) k
    JOIN rl q ON q.d = k.d AND q.model = 'qty' JOIN rl t ON t.d = k.d AND t.model = 'disc')""", "ic", "benchmark",
                                  extra={"hist": IC_HISTORY, "rl": rolling_cte(12), "bf": BENCH, "ms": STATE}))
def horizon_weights(p):
    rows = predictions(p)
    rolled = style.rolling_reliability(ic_history(p, rows), rows.select("model", "d").distinct(), 12, ("model",))

    def leg(model, h):
        return rolled.where(F.col("model") == model).select("d", F.col("rolling_icir").alias(f"icir_{h}"), F.col("observations").alias(f"n_{h}"))

    state = style.market_state(p.benchmark())
    joined = leg("qty", 5).join(leg("disc", 20), "d").join(state, "d", "left")
    return style.horizon_weights(joined, 0.02, 0.01, 12)


CONTRIB = """SELECT e.d, e.symbol, e.style, e.x * f.momentum_5 AS x FROM lg e JOIN ft f ON f.d = e.d AND f.style = e.style AND f.momentum_5 IS NOT NULL"""


@query("f18_consensus_votes", sql(f"""SELECT d, symbol, CAST(buy AS BIGINT) AS buy_votes, CAST(sell AS BIGINT) AS sell_votes, buy >= 1 AS buy_eligible,
    {r('CASE WHEN stddev_pop(p) OVER (PARTITION BY d) > 1e-12 THEN (p-avg(p) OVER (PARTITION BY d))/stddev_pop(p) OVER (PARTITION BY d) ELSE p END')} AS prediction FROM (
    SELECT d, symbol, buy, sell, CASE WHEN buy >= 1 THEN bull + 0.05::DOUBLE*buy END AS p FROM (
      SELECT c.d, c.symbol, count(*) FILTER (WHERE x >= u AND x > 0) AS buy, count(*) FILTER (WHERE x <= l AND x < 0) AS sell,
        sum(CASE WHEN x >= u AND x > 0 THEN x ELSE 0 END) AS bull FROM ct c JOIN (
          SELECT d, style, max(x) FILTER (WHERE k-1 = floor(hi)) + coalesce((max(x) FILTER (WHERE k-2 = floor(hi)) - max(x) FILTER (WHERE k-1 = floor(hi)))*max(hi-floor(hi)), 0) AS u,
            max(x) FILTER (WHERE k-1 = floor(lo)) + coalesce((max(x) FILTER (WHERE k-2 = floor(lo)) - max(x) FILTER (WHERE k-1 = floor(lo)))*max(lo-floor(lo)), 0) AS l
          FROM (SELECT *, round((n-1)*0.9::DOUBLE, 9) AS hi, round((n-1)*0.1::DOUBLE, 9) AS lo FROM (SELECT *, row_number() OVER (PARTITION BY d, style ORDER BY x, symbol) AS k,
            count(*) OVER (PARTITION BY d, style) AS n FROM ct)) GROUP BY d, style) k
        ON k.d = c.d AND k.style = c.style GROUP BY c.d, c.symbol))""", "data", extra={**STYLE_CTES, **STD, "lg": LONG, "ft": FEATURES, "ct": CONTRIB}))
def consensus_votes(p):
    forecast = timing(p).select("d", "style", F.col("momentum_5").alias("w")).where("w IS NOT NULL")
    rows = exposures(p).join(calendar.calendar_broadcast(forecast), ["d", "style"]).select(
        "d", "symbol", "style", (F.col("x") * F.col("w")).alias("x"))
    return xs.consensus(rows, slices=p.slices())


@query("f19_industry_neutral", sql(f"""SELECT d, symbol, {r('c * CASE WHEN stddev_pop(c) OVER (PARTITION BY d) > 1e-12 THEN stddev_pop(f_qty) OVER (PARTITION BY d)/stddev_pop(c) OVER (PARTITION BY d) ELSE 1 END')} AS neutral
    FROM (SELECT f.d, f.symbol, f_qty, f_qty - avg(f_qty) OVER (PARTITION BY f.d, industry) AS c FROM fx f JOIN industry i ON i.symbol = f.symbol)""", "fx", "industry"))
def industry_neutral(p):
    return xs.neutralise(p.fx().select("d", "symbol", "f_qty"), p.industry(), "f_qty").select("d", "symbol", "neutral")


FREQUENCIES = ("daily", "alternate", "weekly", "monthly", "quarterly")


@query("f20_rebalance_flags", sql("""SELECT d, idx > 1 AS daily, idx % 2 = 0 AS alternate, idx = 2 OR (idx > 2 AND wk <> pw) AS weekly,
    idx = 2 OR (idx > 2 AND mo <> pm) AS monthly, idx = 2 OR (idx > 2 AND qu <> pq) AS quarterly FROM (SELECT *, lag(wk) OVER (ORDER BY d) AS pw,
      lag(mo) OVER (ORDER BY d) AS pm, lag(qu) OVER (ORDER BY d) AS pq FROM (SELECT d, row_number() OVER (ORDER BY d) AS idx, date_trunc('week',d) AS wk,
      date_trunc('month',d) AS mo, date_trunc('quarter',d) AS qu FROM (SELECT DISTINCT d FROM px_day)))""", "px_day"))
def rebalance_flags(p):
    cal = calendar.sessions(p.px_day())
    out = cal
    for f in FREQUENCIES:
        out = out.join(calendar.rebalance_flags(cal, f).select("d", F.col("rebalance").alias(f)), "d")
    return out.drop("idx")


@query("f21_confidence_gate", sql(f"""SELECT d, quarter, structural_ok, CAST(fails AS BIGINT) AS structural_failures, n AS available, {r('coalesce(CASE WHEN n >= 6 THEN recent END, 0.01)')} AS confidence, risk_off,
    CASE WHEN risk_off THEN 'risk_off_liquidate' WHEN structural_ok AND coalesce(CASE WHEN n >= 6 THEN recent END, 0.01) > 0 THEN 'normal' ELSE 'hold' END AS mode,
    risk_off OR (structural_ok AND coalesce(CASE WHEN n >= 6 THEN recent END, 0.01) > 0) AS trade_enabled
    FROM (SELECT x.*, fails >= 2 OR (n = 6 AND n_old = 6 AND recent <= 0 AND earlier <= 0) AS risk_off FROM (
      SELECT c.d, q.quarter, q.structural_ok, q.fails, count(rank_ic) FILTER (WHERE k <= 6) AS n, count(rank_ic) FILTER (WHERE k BETWEEN 7 AND 12) AS n_old,
        avg(rank_ic) FILTER (WHERE k <= 6) AS recent, avg(rank_ic) FILTER (WHERE k BETWEEN 7 AND 12) AS earlier FROM (
          SELECT c.d, h.rank_ic, row_number() OVER (PARTITION BY c.d ORDER BY h.d DESC) AS k FROM (SELECT DISTINCT d FROM pred WHERE model = 'qty') c
          LEFT JOIN hist h ON h.model = 'qty' AND h.ex < c.d) c JOIN qs q ON q.quarter = CAST(year(c.d) AS VARCHAR) || 'Q' || quarter(c.d)
      GROUP BY c.d, q.quarter, q.structural_ok, q.fails) x)""", "ic", extra={"hist": IC_HISTORY, "qs": """
        SELECT quarter, structural_ok, CASE WHEN structural_ok THEN 0 ELSE count(*) OVER (PARTITION BY run, structural_ok ORDER BY quarter) END AS fails FROM (
          SELECT *, sum(CASE WHEN structural_ok THEN 1 ELSE 0 END) OVER (ORDER BY quarter) AS run FROM (
            SELECT CAST(year(d) AS VARCHAR) || 'Q' || quarter(d) AS quarter, avg(f_ret) < 0.27::DOUBLE AS structural_ok FROM fx GROUP BY 1))"""}))
def confidence_gate(p):
    rows = predictions(p).where("model = 'qty'").withColumn("pool", F.lit("all"))
    daily = ic_history(p, rows).withColumn("pool", F.lit("all"))
    # the share of returned lines stands in for the explained variance of the quarter's components
    structure = p.fx().groupBy(F.lit("all").alias("pool"), c.quarter_name(F.col("d")).alias("quarter")).agg(
        F.when(F.avg("f_ret") < 0.27, 0.9).otherwise(0.5).alias("explained"), F.lit(1.0).alias("alignment"),
        F.lit(0.01).alias("validation_ic"))
    return style.confidence_gate(rows, daily, structure, 6)[1].drop("pool")


@query("f22_even_sample", sql("""SELECT d, symbol FROM (SELECT d, symbol, row_number() OVER (ORDER BY d, symbol)-1 AS i, count(*) OVER () AS n FROM fx)
    WHERE i IN (SELECT CAST(floor(k*(SELECT count(*)-1 FROM fx)/499.0::DOUBLE) AS BIGINT) FROM range(500) t(k))""", "fx"))
def even_sample(p):
    return ranking.even_sample(p.fx(), ("d", "symbol"), 500).select("d", "symbol")


@query("f23_relative_nav", sql(f"""SELECT d, {r('nav')} AS strategy, {r('b')} AS benchmark, {r('nav/b')} AS excess, {r('(nav/b)/lag(nav/b) OVER (ORDER BY d)-1')} AS excess_return
    FROM (SELECT m.d, m.value/first_value(m.value) OVER (ORDER BY m.d) AS b, a.asset/first_value(a.asset) OVER (ORDER BY m.d) AS nav
      FROM benchmark m JOIN (SELECT d, avg(price*(1+f_tax)) AS asset FROM px JOIN fx USING (d, symbol) GROUP BY d) a ON a.d = m.d)""", "benchmark", "fx"))
def relative_nav(p):
    asset = p.px().join(p.fx(), ["d", "symbol"]).groupBy("d").agg(F.avg(F.col("price") * (1 + F.col("f_tax"))).alias("asset"))
    return portfolio.relative_nav(asset, p.benchmark())


QUARTER_IC = "avg(rank_ic) OVER (PARTITION BY date_trunc('quarter', i.d))"


@query("f24_report_series", sql(f"""SELECT i.d, {r('sum(coalesce(rank_ic,0)) OVER (ORDER BY i.d)')} AS cumulative_ic, {r(QUARTER_IC)} AS quarter_ic,
    q.quarter_return FROM ic i LEFT JOIN (SELECT q, {r('v/lag(v) OVER (ORDER BY q)-1')} AS quarter_return FROM (SELECT date_trunc('quarter', d) AS q, arg_max(value, d) AS v FROM benchmark GROUP BY 1)) q
      ON q.q = date_trunc('quarter', i.d) WHERE model = 'qty'""", "ic", "benchmark"))
def report_series(p):
    rows = predictions(p).where("model = 'qty' AND prediction IS NOT NULL AND label IS NOT NULL")
    return portfolio.report_series(ic.daily_ic(rows, ("d",), slices=p.slices()), p.benchmark())
