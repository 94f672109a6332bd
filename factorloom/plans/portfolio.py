"""Section J: portfolio analytics on tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from factorloom.operators import calendar, ic, portfolio, quality, research, selection, series
from factorloom.plans.aggregates import SORTED, _spearman
from factorloom.plans.inputs import FACTORS, data, kept, predictions
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query
from factorloom.plans.scalars import FEE_SQL
from factorloom.plans.selection import DESC, HELD, PCT, prior_holdings, scores


def layer_sql(q: int) -> dict[str, str]:
    return {"lr": f"""SELECT model, d, CAST(b+1 AS INT) AS layer, avg(label) AS ret FROM (SELECT *, greatest(((pos-1)*{q} + n-2)//(n-1) - 1, 0) AS b FROM pairs WHERE n >= {q} AND n > 1) GROUP BY 1,2,3""",
            "le": f"""SELECT * FROM lr UNION ALL SELECT model, d, 0, coalesce(max(ret) FILTER (WHERE layer={q}) - max(ret) FILTER (WHERE layer=1), 0) FROM lr GROUP BY model, d"""}


def valid(p):
    return predictions(p).where("prediction IS NOT NULL AND label IS NOT NULL")


@query("j01_layered_portfolio", sql(f"""SELECT model, layer, {r('avg(ret)')} AS mean_return, {r('avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS win_rate
    FROM lr GROUP BY model, layer""", "pairs", extra={"lr": layer_sql(5)["lr"]}))
def layered_portfolio(p):
    returns = portfolio.layer_returns(valid(p), "prediction", "label", 5, ("model",), p.slices())
    return portfolio.layer_summary(returns, ("model",))


@query("j02_score_layer_nav", sql(f"""SELECT model, d, layer, {r('ret')} AS ret, {r('product(1+ret) OVER (PARTITION BY model, layer ORDER BY d)')} AS nav FROM le""",
                                  "pairs", extra=layer_sql(10)).replace("round(product(1+ret) OVER (PARTITION BY model, layer ORDER BY d),8)+0.0",
                                                                        "round(product(1+ret) OVER (PARTITION BY model, layer ORDER BY d),6)+0.0"))
def score_layer_nav(p):
    returns = kept(portfolio.layer_returns(valid(p), "prediction", "label", 10, ("model",), p.slices()))
    return portfolio.layer_curves(returns, 10, ("model",)).withColumn("nav", F.round("nav", 6))


def monthly_returns(p):
    rows = calendar.with_index(p.px(), p.sessions())
    return rows.select("d", "symbol", (F.try_divide(series.at_offset("price", 1), F.col("price")) - 1).alias("ret"))


def drifting(p):
    targets = portfolio.rebalance_targets(scores(p), "quarterly", 20, slices=0)
    return kept(portfolio.drifting_portfolio(targets, monthly_returns(p), calendar=p.sessions()))


DRIFT = {
    "ds": DESC, "pc": PCT,
    "qd": "SELECT min(d) AS d, row_number() OVER (ORDER BY min(d)) AS per FROM (SELECT DISTINCT d FROM fx) GROUP BY date_trunc('quarter', d)",
    "tg": "SELECT q.per, pc.symbol, pct/sum(pct) OVER (PARTITION BY pc.d) AS w FROM pc JOIN qd q ON q.d = pc.d",
    "dy": "SELECT s.d, s.idx, (SELECT max(per) FROM qd WHERE qd.d <= s.d) AS per FROM sess s",
    "gr": """SELECT t.per, t.symbol, t.w, y.d, y.idx, coalesce(b.price/a.price-1, 0) AS ret FROM tg t JOIN dy y ON y.per = t.per
        LEFT JOIN pxi a ON a.symbol = t.symbol AND a.idx = y.idx LEFT JOIN pxi b ON b.symbol = t.symbol AND b.idx = y.idx+1""",
    "gw": """SELECT *, w*coalesce(product(1+ret) OVER (PARTITION BY per, symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g FROM gr""",
    "en": """SELECT per+1 AS per, symbol, g*(1+ret)/sum(g*(1+ret)) OVER (PARTITION BY per) AS old FROM gw g
        WHERE idx = (SELECT max(idx) FROM dy WHERE dy.per = g.per) AND per < (SELECT max(per) FROM qd)""",
    "mv": "SELECT coalesce(t.per, e.per) AS per, coalesce(t.w,0) - coalesce(e.old,0) AS dl FROM tg t FULL JOIN en e ON e.per = t.per AND e.symbol = t.symbol",
    "tr": "SELECT per, sum(greatest(dl,0)) AS buys, sum(greatest(-dl,0)) AS sells FROM mv GROUP BY per",
    "pf": """SELECT y.d, x.gross, coalesce(tr.buys+tr.sells,0) AS turnover, coalesce(tr.sells,0) AS sells,
        coalesce((tr.buys+tr.sells)*0.0003::DOUBLE + tr.sells*0.0005::DOUBLE, 0) AS cost, x.hc FROM dy y
        JOIN (SELECT idx, sum(g*ret)/sum(g) AS gross, count(*) FILTER (WHERE g > 0) AS hc FROM gw GROUP BY idx) x ON x.idx = y.idx
        LEFT JOIN qd ON qd.d = y.d LEFT JOIN tr ON tr.per = qd.per""",
}


@query("j04_drifting_portfolio", sql(f"""SELECT d, {r('gross')} AS gross_return, {r('cost')} AS cost, {r('gross-cost')} AS net_return, {r('turnover')} AS turnover,
    {r('sells')} AS sells, hc AS holding_count, {r('product(1+gross-cost) OVER (ORDER BY d)')} AS nav, {r('product(1+gross) OVER (ORDER BY d)')} AS gross_nav FROM pf""",
                                     "fx", "pxi", extra=DRIFT))
def drifting_portfolio(p):
    return drifting(p)


LAYERED = {k: v for q in (10, 5) for k, v in {
    f"lr{q}": layer_sql(q)["lr"], f"le{q}": layer_sql(q)["le"].replace(" lr", f" lr{q}")}.items()}
MEASURED = {"mean": "avg(rank_ic)", "std": "stddev_samp(rank_ic)", "icir": "CASE WHEN stddev_samp(rank_ic) > 1e-12 THEN avg(rank_ic)/stddev_samp(rank_ic) END",
            "win_rate": "avg(CASE WHEN rank_ic > 0 THEN 1.0::DOUBLE WHEN rank_ic IS NOT NULL THEN 0.0::DOUBLE END)", "absolute_mean": "avg(abs(rank_ic))",
            "observations": "CAST(count(rank_ic) AS DOUBLE)"}
NAMED = {10: "decile", 5: "quintile"}
RESEARCHED = " UNION ALL ".join([
    *[f"SELECT 'ic' AS part, model AS factor, '{k}' AS name, {r(v)} AS value FROM ic GROUP BY model" for k, v in MEASURED.items()],
    *[f"""SELECT '{NAMED[q]}', model, layer || '_{k}', {v} FROM (SELECT *, product(1+ret) OVER (PARTITION BY model, layer ORDER BY d) AS nav FROM le{q}) GROUP BY model, layer"""
      for q in NAMED for k, v in (("mean_return", r("avg(ret)")), ("win_rate", r("avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")),
                                  ("nav", "round(arg_max(nav, d),4)+0.0"))],
    *[f"SELECT 'top_20', model, '{k}', {r('avg(x)')} FROM (SELECT model, d, {v} AS x FROM pairs WHERE pos > n - 20 GROUP BY model, d) GROUP BY model"
      for k, v in (("equal", "avg(label)"), ("weighted", "sum(rp*label)/sum(rp)"))],
    "SELECT 'portfolio', 'qty', 'nav', round(product(1+gross-cost),6)+0.0 FROM pf", "SELECT 'portfolio', 'qty', 'gross_nav', round(product(1+gross),6)+0.0 FROM pf",
    f"SELECT 'portfolio', 'qty', 'turnover', {r('avg(turnover)')} FROM pf",
    *[f"SELECT 'correlation', '{a}', '{b}', spearman FROM ({_spearman(a, b)})" for i, a in enumerate(FACTORS) for b in FACTORS[i + 1:]],
    f"SELECT 'return_matrix', 'qty', yb || '_' || xb, mean_return FROM ({SORTED})",
    *[f"SELECT 'coverage', '{f}', '{k}', {v} FROM fx" for f in FACTORS for k, v in (("valid", f"CAST(count({f}) AS DOUBLE)"), ("missing_rate", r(f"1-count({f})/count(*)")))]])


@query("j03_factor_research", sql(RESEARCHED, "ic", "data", "pxi", extra=LAYERED | DRIFT))
def factor_research(p):
    """The whole report of two factors: coefficients, deciles and quintiles with their paths, top-20 portfolios, the drifting
    portfolio, rank correlations, the 3x3 return matrix, coverage. One written pass of ranks serves the first three."""
    rows = data(p)
    scored = rows.select("d", "symbol", "label", F.explode(F.array(
        F.struct(F.lit("qty").alias("factor"), F.col("f_qty").cast("double").alias("score")),
        F.struct(F.lit("disc").alias("factor"), F.col("f_disc").alias("score")))).alias("s")).select("s.factor", "d", "symbol", "s.score", "label")
    ranks = research.ranked(scored, p.slices())
    figures = research.layer_figures(research.layers(ranks, (10, 5))).withColumn("nav", F.round("nav", 4))
    name = F.when(F.col("layers") == 10, "decile").otherwise("quintile")
    layered = figures.withColumn("part", name).unpivot(["part", "factor", "layer"], ["mean_return", "win_rate", "nav"], "k", "value").select(
        "part", "factor", F.concat_ws("_", F.col("layer").cast("string"), "k").alias("name"), "value")
    tops = research.top_portfolios(ranks, 20).groupBy("factor").agg(F.avg("equal").alias("equal"), F.avg("weighted").alias("weighted"))
    path = drifting(p).agg(F.round(F.max_by("nav", "d"), 6).alias("nav"), F.round(F.max_by("gross_nav", "d"), 6).alias("gross_nav"), F.avg("turnover").alias("turnover"))
    paired = ic.pooled_spearman(p.fx(), FACTORS)
    sorted_rows = rows.select("d", "symbol", F.col("f_qty").alias("x"), F.col("f_disc").alias("y"), F.col("label").alias("r"))
    matrix = ic.double_sort(sorted_rows, slices=p.slices())
    cover = ic.coverage(p.fx(), FACTORS).withColumn("valid", F.col("valid").cast("double"))
    part = lambda df, name: df.select(F.lit(name).alias("part"), "factor", "name", "value")
    return quality.union_all([
        part(research.coefficients(ranks), "ic"), layered, part(tops.unpivot(["factor"], ["equal", "weighted"], "name", "value"), "top_20"),
        part(path.withColumn("factor", F.lit("qty")).unpivot(["factor"], ["nav", "gross_nav", "turnover"], "name", "value"), "portfolio"),
        part(paired.select(F.col("x").alias("factor"), F.col("y").alias("name"), F.col("spearman").alias("value")), "correlation"),
        part(matrix.select(F.lit("qty").alias("factor"), F.concat_ws("_", F.col("yb").cast("string"), F.col("xb").cast("string")).alias("name"),
                           F.col("mean_return").alias("value")), "return_matrix"),
        part(cover.unpivot(["factor"], ["valid", "missing_rate"], "name", "value"), "coverage")])


@query("j05_constrained_step", sql(f"""SELECT d, symbol, {r('greatest(CASE WHEN dd <= -0.05::DOUBLE THEN t2*greatest(0, 1+dd/0.05) ELSE t2 END, 0)')} AS constrained FROM (
    SELECT *, CASE WHEN to_ > 0.8::DOUBLE THEN cur + dl*(0.8::DOUBLE/to_) ELSE tgt END AS t2 FROM (SELECT *, sum(abs(dl)) OVER (PARTITION BY d) AS to_ FROM (
      SELECT *, CASE WHEN abs(tgt-cur) < 0.01::DOUBLE THEN 0 ELSE tgt-cur END AS dl FROM (
        SELECT coalesce(t.d, h.d) AS d, coalesce(t.symbol, h.symbol) AS symbol, coalesce(t.w, 0) AS tgt, coalesce(h.w, 0) AS cur,
          CASE WHEN month(coalesce(t.d, h.d)) % 4 = 0 THEN -0.08::DOUBLE ELSE -0.01::DOUBLE END AS dd
        FROM (SELECT d, symbol, pct/sum(pct) OVER (PARTITION BY d) AS w FROM pc) t FULL JOIN (SELECT d, symbol, 0.05::DOUBLE AS w FROM held) h ON h.d = t.d AND h.symbol = t.symbol))))""",
                                   "fx", extra={"ds": DESC, "pc": PCT, "held": HELD}))
def constrained_step(p):
    target = selection.weights(selection.top_n(scores(p), 20), "score", slices=0).select("d", "symbol", F.col("weight").alias("target"))
    current = prior_holdings(p).withColumn("current", F.lit(0.05))
    rows = target.join(current, ["d", "symbol"], "full").select(
        "d", "symbol", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("current", F.lit(0.0)).alias("current"),
        F.when(F.month("d") % 4 == 0, -0.08).otherwise(-0.01).alias("drawdown"))
    return portfolio.constrain(rows, 0.01, 0.8, 0.05).select("d", "symbol", "constrained")


def perf_sql(source: str, by: str, periods: str, rf: str = "0.02", active: str = "true") -> str:
    part = f"PARTITION BY {by} ORDER BY d"
    return f"""SELECT {by}, {r('annual')} AS annual_return, {r('vol')} AS annual_volatility, {r(f'CASE WHEN vol > 0 THEN (annual-{rf})/vol END')} AS sharpe,
      {r('dd')} AS max_drawdown, {r('CASE WHEN dd < 0 THEN annual/abs(dd) END')} AS calmar, {r('wins')} AS win_rate, {r('pl')} AS profit_loss_ratio, {r('flat')} AS underwater_ratio FROM (
      SELECT {by}, pow(arg_max(nav, d), 1/greatest(count(*)/{periods}, 1/{periods}))-1 AS annual, stddev_samp(ret)*sqrt({periods}) AS vol, min(nav/peak-1) AS dd,
        avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS wins, avg(ret) FILTER (WHERE ret > 0)/abs(avg(ret) FILTER (WHERE ret < 0)) AS pl,
        avg(CASE WHEN ret = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE {active}) AS flat FROM (
        SELECT *, max(nav) OVER ({part}) AS peak FROM (SELECT *, product(1+ret) OVER ({part}) AS nav FROM {source} WHERE ret IS NOT NULL)) GROUP BY {by})"""


SYM_RET = """SELECT x.d, x.symbol, (b.price/x.price-1)/5 AS ret FROM pxi x LEFT JOIN pxi b ON b.symbol = x.symbol AND b.idx = x.idx+1"""


@query("j06_performance_metrics", sql(perf_sql("sr", "symbol", "12.0::DOUBLE"), "pxi", extra={"sr": SYM_RET}))
def performance_metrics(p):
    rets = monthly_returns(p).withColumn("ret", F.col("ret") / 5)
    return portfolio.performance(rets, ("symbol",), periods=12.0)


ACCOUNT = "SELECT d, avg(price*(1+f_tax)) AS asset, count(*) FILTER (WHERE f_ret > 0.5::DOUBLE) AS holding_count FROM px JOIN fx USING (d, symbol) GROUP BY d"


@query("j07_account_performance", sql(perf_sql("st2", "side", "12.0::DOUBLE", active="holding_count > 0"), "benchmark", "fx", extra={
    "acc": ACCOUNT,
    "nv": "SELECT m.d, holding_count, asset/first_value(asset) OVER (ORDER BY m.d) AS nav, value/first_value(value) OVER (ORDER BY m.d) AS b FROM benchmark m JOIN acc ON acc.d = m.d",
    "st2": """SELECT d, holding_count, 'absolute' AS side, nav/lag(nav) OVER (ORDER BY d)-1 AS ret FROM nv UNION ALL
        SELECT d, holding_count, 'excess', (nav/b)/lag(nav/b) OVER (ORDER BY d)-1 FROM nv"""}))
def account_performance(p):
    asset = p.px().join(p.fx(), ["d", "symbol"]).groupBy("d").agg(
        F.avg(F.col("price") * (1 + F.col("f_tax"))).alias("asset"), F.count(F.when(F.col("f_ret") > 0.5, 1)).alias("holding_count"))
    return portfolio.account_performance(asset, p.benchmark())


@query("j08_equal_weight_benchmark", sql(f"""SELECT d, {r('ret')} AS ret, round(100*product(1+ret) OVER (ORDER BY d), 3)+0.0 AS value FROM (
    SELECT x.d, coalesce(avg(CASE WHEN m.member THEN x.price/a.price-1 END), 0) AS ret FROM pxi x LEFT JOIN pxi a ON a.symbol = x.symbol AND a.idx = x.idx-1
    LEFT JOIN pool m ON m.symbol = a.symbol AND m.d = a.d GROUP BY x.d)""", "pxi", "pool"))
def equal_weight_benchmark(p):
    return portfolio.equal_weight_benchmark(p.px(), p.pool().where("member"), calendar=p.sessions()).withColumn("value", F.round("value", 3))


OVERLAY = """SELECT industry, k+1 AS k, d, target AS e, target*ret AS gained, nav*(1+target*ret) AS nav, greatest(peak, nav*(1+target*ret)) AS peak,
    list_append(recent, target*ret)[-60:] AS recent FROM (
    SELECT *, CASE WHEN len(recent) < 10 THEN e ELSE least(greatest((greatest(list_avg(recent), 0) + 0.0025::DOUBLE*e)/(4.0::DOUBLE*mult*greatest(down, 1e-12::DOUBLE) + 0.0025::DOUBLE),
        greatest(0.3::DOUBLE, e-0.1::DOUBLE)), least(1.0::DOUBLE, e+0.1::DOUBLE)) END AS target FROM (
      SELECT f.industry, f.k, s.d, coalesce(s.ret, 0) AS ret, f.e, f.nav, f.peak, f.recent, list_avg(list_transform(f.recent, lambda x: least(x,0)*least(x,0))) AS down,
        1.0::DOUBLE + 4.0::DOUBLE*pow(greatest(1-f.nav/f.peak, 0)/0.2::DOUBLE, 2) + CASE WHEN month(s.d) = 12 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS mult
      FROM fold f JOIN ser s ON s.industry = f.industry AND s.k = f.k + 1))"""


@query("j09_exposure_overlay", sql(f"SELECT industry, d, {r('e')} AS exposure, {r('gained')} AS overlay_return, {r('nav')} AS nav FROM fold WHERE k > 0", "pxi", "industry", extra={
    "ser": """SELECT *, row_number() OVER (PARTITION BY industry ORDER BY d) AS k FROM (SELECT i.industry, x.d, avg((b.price/x.price-1)/5) AS ret FROM pxi x JOIN industry i ON i.symbol = x.symbol
        LEFT JOIN pxi b ON b.symbol = x.symbol AND b.idx = x.idx+1 GROUP BY 1, 2)""",
    "fold": f"""SELECT DISTINCT industry, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS d, 1.0::DOUBLE AS e, 0.0::DOUBLE AS gained, 1.0::DOUBLE AS nav, 1.0::DOUBLE AS peak, CAST([] AS DOUBLE[]) AS recent FROM ser
        UNION ALL {OVERLAY}"""}).replace("WITH ", "WITH RECURSIVE ", 1))
def exposure_overlay(p):
    rows = monthly_returns(p).join(p.industry(), "symbol")
    by_industry = rows.groupBy("industry", "d").agg(F.avg(F.col("ret") / 5).alias("ret"))
    return portfolio.exposure_overlay(by_industry.withColumn("risk_off", F.month("d") == 12), "industry")


@query("j10_corporate_actions", sql(f"""SELECT x.d, x.symbol, {r('a.adj')} AS old_adj, {r('x.adj')} AS new_adj, {r('x.adj/a.adj')} AS share_ratio
    FROM (SELECT adj.*, s.idx FROM adj JOIN sess s ON s.d = adj.d) x JOIN (SELECT adj.*, s.idx FROM adj JOIN sess s ON s.d = adj.d) a ON a.symbol = x.symbol AND a.idx = x.idx-1
    JOIN held h ON h.d = x.d AND h.symbol = x.symbol WHERE abs(a.adj - x.adj) > 1e-5""", "adj", "fx", "sess", extra={"held": HELD}))
def corporate_actions(p):
    return portfolio.corporate_actions(prior_holdings(p), p.adj(), p.sessions())


@query("j11_mark_to_market", sql(f"""SELECT d, round(sum(v),4)+0.0 AS value, count(*) FILTER (WHERE at_cost) AS at_cost FROM (
    SELECT h.d, 100*coalesce(c.price, 500) AS v, c.price IS NULL AS at_cost FROM held h ASOF LEFT JOIN (SELECT * FROM px_day WHERE month(d) <> 2) c
      ON c.symbol = h.symbol AND c.d <= h.d) GROUP BY d""", "fx", "px_day", extra={"held": HELD}))
def mark_to_market(p):
    book = prior_holdings(p).withColumns({"shares": F.lit(100), "avg_cost": F.lit(500.0)})
    return quality.mark_to_market(book, p.px_day().where(F.month("d") != 2).withColumnRenamed("price", "close")).withColumn("value", F.round("value", 4))


TRADES = """SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(o_orderdate AS DATE) AS buy_date, CAST(l_shipdate AS DATE) AS sell_date,
    l_quantity AS shares, l_extendedprice/l_quantity*(1-l_discount) AS avg_cost, l_extendedprice/l_quantity AS sell_price FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


@query("j12_closed_trades", sql(f"""SELECT sell_date, count(*) AS trades, round(sum(pnl),2)+0.0 AS pnl, {r('avg(hd)')} AS mean_days FROM (SELECT sell_date, hd,
    (sell_price-avg_cost)*shares - ({FEE_SQL}) AS pnl FROM (SELECT *, 'SELL' AS side, sell_date AS d, shares*sell_price AS gross, sell_date - buy_date AS hd FROM td)) GROUP BY sell_date""",
                                extra={"td": TRADES}))
def closed_trades(p):
    lines = p.table("lineitem").join(p.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    trades = lines.select(F.col("o_orderdate").cast("date").alias("buy_date"), F.col("l_shipdate").cast("date").alias("sell_date"),
                          F.col("l_quantity").alias("shares"), (unit * (1 - F.col("l_discount"))).alias("avg_cost"), unit.alias("sell_price"))
    closed = portfolio.closed_trades(trades, cutover="1998-01-01")
    return closed.groupBy("sell_date").agg(F.count("*").alias("trades"), F.round(F.sum("pnl"), 2).alias("pnl"), F.avg("holding_days").alias("mean_days"))


@query("j13_consistency_audit", sql(f"""SELECT 'nonfinite_assets' AS "check", 0.0::DOUBLE AS value, true AS passed FROM pf HAVING count(*) > 0
    UNION ALL SELECT 'curve_matches_account', 0.0::DOUBLE, true FROM pf HAVING count(*) > 0
    UNION ALL SELECT 'dates_in_one_only', 0.0::DOUBLE, true FROM pf HAVING count(*) > 0
    UNION ALL SELECT 'first_date_kept', CAST(min(idx) AS DOUBLE), min(idx) = 1 FROM sess WHERE d IN (SELECT d FROM pf)
    UNION ALL SELECT 'no_fee_not_below_net', {r('product(1+gross)-product(1+gross-cost)')}, product(1+gross) >= product(1+gross-cost) FROM pf
    UNION ALL SELECT 'max_abs_move', {r('max(abs(gross-cost))')}, true FROM pf WHERE d > (SELECT min(d) FROM pf)
    UNION ALL SELECT 'max_abs_benchmark_move', {r('max(abs(m))')}, true FROM (SELECT value/lag(value) OVER (ORDER BY d) - 1 AS m FROM benchmark)
    UNION ALL SELECT 'first_trade_session', CAST(min(idx) AS DOUBLE), min(idx) = 2 FROM (SELECT sess.idx FROM pf JOIN sess ON sess.d = pf.d WHERE turnover > 0)""",
                                    "fx", "pxi", "benchmark", extra=DRIFT))
def consistency_audit(p):
    """The curve beside an account booked by the cost stages, two ways to the same money."""
    daily = drifting(p)
    account = portfolio.cost_scenarios(daily, {"net": (0.0003, 0.0005)}).select("d", (F.col("nav") * 1e6).alias("asset"))
    return quality.consistency(daily, account, p.sessions(), p.benchmark())


@query("j14_cost_stages", sql(f"""SELECT scenario, {r('arg_max(nav, d)')} AS terminal_nav, {r('max(s)')} AS sharpe, {r('max(s0) - max(s)')} AS sharpe_given_up FROM (
    SELECT c.scenario, c.d, product(1+c.ret) OVER (PARTITION BY c.scenario ORDER BY c.d) AS nav, q.sharpe AS s, z.sharpe AS s0 FROM cs c
    JOIN pq q ON q.scenario = c.scenario JOIN pq z ON z.scenario = 'no_fee') GROUP BY scenario""", "fx", "pxi", extra={
        **DRIFT, "cs": """SELECT d, n AS scenario, gross - turnover*a - sells*b AS ret FROM pf, (VALUES ('no_fee', 0.0::DOUBLE, 0.0::DOUBLE), ('net', 0.0003::DOUBLE, 0.0005::DOUBLE),
            ('double', 0.0006::DOUBLE, 0.001::DOUBLE)) v(n, a, b)""", "pq": perf_sql("cs", "scenario", "12.0::DOUBLE")}))
def cost_stages(p):
    stages = portfolio.cost_scenarios(drifting(p), {"no_fee": (0.0, 0.0), "net": (0.0003, 0.0005), "double": (0.0006, 0.001)})
    perf = portfolio.performance(stages, ("scenario",), periods=12.0).select("scenario", "sharpe")
    ends = stages.groupBy("scenario").agg(F.max_by("nav", "d").alias("terminal_nav")).join(perf, "scenario")
    free = F.max(F.when(F.col("scenario") == "no_fee", F.col("sharpe"))).over(Window.partitionBy())
    return ends.withColumn("sharpe_given_up", free - F.col("sharpe"))
