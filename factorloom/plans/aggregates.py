"""Section E: grouped statistics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from factorloom.functions import columns as c
from factorloom.operators import align, cross_section as xs, gram, ic, quality, style
from factorloom.plans.inputs import FACTORS, data, kept, predictions
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query
from factorloom.plans.scalars import FEE_SQL


@query("e01_sample_counts", sql(f"""SELECT 'date' AS item, CAST(d AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS value FROM fx GROUP BY d
    UNION ALL SELECT 'missing', 'f_disc', {r('1-count(f_disc)/count(*)')} FROM fx
    UNION ALL SELECT 'missing', 'f_qty', {r('1-count(f_qty)/count(*)')} FROM fx
    UNION ALL SELECT 'missing', 'f_tax', {r('1-count(f_tax)/count(*)')} FROM fx
    UNION ALL SELECT 'missing', 'f_ret', {r('1-count(f_ret)/count(*)')} FROM fx""", "fx"))
def sample_counts(p):
    fx = p.fx()
    counts = fx.groupBy("d").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("date").alias("item"), F.col("d").cast("string").alias("name"), "value")
    missing = ic.coverage(fx, FACTORS).select(F.lit("missing").alias("item"), F.col("factor").alias("name"),
                                              F.col("missing_rate").alias("value"))
    return counts.unionByName(missing)


@query("e02_data_quality", sql(f"""SELECT 'factor_rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM fx
    UNION ALL SELECT 'feature_count', 4.0::DOUBLE
    UNION ALL SELECT 'missing_cells', CAST(count(*)*4 - count(f_disc)-count(f_qty)-count(f_tax)-count(f_ret) AS DOUBLE) FROM fx
    UNION ALL SELECT 'duplicate_rows', 0.0::DOUBLE
    UNION ALL SELECT 'common_dates', CAST(count(*) AS DOUBLE) FROM (SELECT d FROM fx INTERSECT SELECT d FROM px)
    UNION ALL SELECT 'common_symbols', CAST(count(*) AS DOUBLE) FROM (SELECT symbol FROM fx INTERSECT SELECT symbol FROM px)
    UNION ALL SELECT 'price_missing_rate', {r('1 - count(*)/(count(DISTINCT d)*count(DISTINCT symbol))')} FROM px""", "fx", "px"))
def data_quality(p):
    return quality.quality_report(p.fx(), FACTORS, p.px())


@query("e03_ic_summary", sql(f"""SELECT h AS horizon, method, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std,
    {r('avg(v)/stddev_samp(v)')} AS icir, {r('avg(CASE WHEN v > 0 THEN 1.0::DOUBLE WHEN v IS NOT NULL THEN 0.0::DOUBLE END)')} AS win_rate,
    {r('avg(abs(v))')} AS absolute_mean, count(v) AS observations
    FROM (SELECT h, 'spearman' AS method, rank_ic AS v FROM hic UNION ALL SELECT h, 'pearson', pearson_ic FROM hic)
    GROUP BY h, method""", "fx", "pxi", extra={}).replace("\nSELECT h AS", ",\nhret AS (SELECT a.symbol, s.d, a.idx-1 AS sig, h.h, b.price/a.price-1 AS ret "
    "FROM pxi a JOIN (VALUES (1),(3),(6)) h(h) ON true JOIN pxi b ON b.symbol=a.symbol AND b.idx=a.idx+h.h JOIN sess s ON s.idx=a.idx-1),\n"
    "zz AS (SELECT d, symbol, greatest(least((f_qty-avg(f_qty) OVER (PARTITION BY d))/stddev_pop(f_qty) OVER (PARTITION BY d),5),-5) AS z FROM fx),\n"
    "hp AS (SELECT h.h, z.d, z.symbol, z.z, h.ret, rank() OVER (PARTITION BY h.h, z.d ORDER BY z.z) + (count(*) OVER (PARTITION BY h.h, z.d, z.z)-1)/2.0 AS ra,"
    " rank() OVER (PARTITION BY h.h, z.d ORDER BY h.ret) + (count(*) OVER (PARTITION BY h.h, z.d, h.ret)-1)/2.0 AS rb FROM zz z JOIN hret h ON h.d=z.d AND h.symbol=z.symbol),\n"
    "hic AS (SELECT h, d, corr(ra,rb) AS rank_ic, corr(z,ret) AS pearson_ic, count(*) AS n FROM hp GROUP BY h, d HAVING count(*) >= 3)\nSELECT h AS"))
def ic_summary(p):
    fx = xs.zscore(p.fx().select("d", "symbol", "f_qty"), ["f_qty"])
    daily = ic.horizon_ic(fx, align.forward_by_signal(fx, p.px(), (1, 3, 6), p.sessions()), "f_qty", p.slices())
    long = daily.select("horizon", "d", F.col("rank_ic").alias("spearman"), F.col("pearson_ic").alias("pearson")).unpivot(
        ["horizon", "d"], ["spearman", "pearson"], "method", "v")
    return ic.ic_statistics(long, ("horizon", "method"), "v")


@query("e04_pool_ic", sql(f"""SELECT {r('avg(rank_ic)')} AS pool_mean_rank_ic, {r('stddev_samp(rank_ic)')} AS pool_rank_ic_std,
    {r('avg(rank_ic)/stddev_samp(rank_ic)')} AS pool_icir, {r('avg(CASE WHEN rank_ic > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS positive_ratio
    FROM (SELECT d, corr(ra, rb) AS rank_ic FROM (SELECT x.d, rank() OVER (PARTITION BY x.d ORDER BY f_qty) + (count(*) OVER (PARTITION BY x.d, f_qty)-1)/2.0 AS ra,
      rank() OVER (PARTITION BY x.d ORDER BY label) + (count(*) OVER (PARTITION BY x.d, label)-1)/2.0 AS rb
      FROM data x JOIN pool USING (d, symbol) WHERE member AND label IS NOT NULL) GROUP BY d)""", "data", "pool"))
def pool_ic(p):
    rows = align.in_pool(data(p), p.pool())
    daily = ic.daily_ic(rows, ("d",), "f_qty", slices=p.slices())
    return ic.ic_statistics(daily.withColumn("one", F.lit(1)), ("one",)).select(
        F.col("mean").alias("pool_mean_rank_ic"), F.col("std").alias("pool_rank_ic_std"), F.col("icir").alias("pool_icir"),
        F.col("win_rate").alias("positive_ratio"))


# percent-rank change between consecutive dates of a model
MOVES = """SELECT model, d, idx, pct, symbol FROM (SELECT model, d, symbol, rp*1.0/n AS pct,
    dense_rank() OVER (PARTITION BY model ORDER BY d) AS idx FROM pairs)"""
TURN = """SELECT b.model, b.d, avg(abs(b.pct-a.pct)) AS turnover FROM mv b JOIN mv a ON a.model=b.model AND a.symbol=b.symbol
    AND a.idx=b.idx-1 GROUP BY b.model, b.d"""
LAYERS = """SELECT *, CASE WHEN n = 1 THEN 0 ELSE greatest(((pos-1)*5 + n-2)//(n-1) - 1, 0) END AS b FROM pairs"""
DAYS = """SELECT i.*, t.turnover, s.ts, s.tn, s.bs, s.bn, CAST(year(i.d) AS VARCHAR) AS y,
    CAST(year(i.d) AS VARCHAR) || 'Q' || quarter(i.d) AS q FROM ic i LEFT JOIN turn t ON t.model=i.model AND t.d=i.d
    JOIN (SELECT model, d, sum(label) FILTER (WHERE b=4) AS ts, count(*) FILTER (WHERE b=4) AS tn,
      sum(label) FILTER (WHERE b=0) AS bs, count(*) FILTER (WHERE b=0) AS bn FROM ly GROUP BY model, d) s ON s.model=i.model AND s.d=i.d"""
METRIC = f"""{r('avg(rank_ic)')} AS mean_rank_ic, {r('avg(pearson_ic)')} AS pearson_ic, {r('stddev_samp(rank_ic)')} AS rank_ic_std,
    {r('avg(rank_ic)/nullif(stddev_samp(rank_ic),0)')} AS icir,
    {r('avg(CASE WHEN rank_ic > 0 THEN 1.0::DOUBLE WHEN rank_ic IS NOT NULL THEN 0.0::DOUBLE END)')} AS rank_ic_positive_ratio,
    {r('avg(rank_ic)/nullif(stddev_samp(rank_ic)/sqrt(count(rank_ic)),0)')} AS rank_ic_t_stat,
    {r('sum(ts)/sum(tn)')} AS top_quantile_return, {r('sum(bs)/sum(bn)')} AS bottom_quantile_return,
    {r('sum(ts)/sum(tn)-sum(bs)/sum(bn)')} AS top_bottom_return, count(rank_ic) AS observation_days,
    CAST(sum(stock_count) AS BIGINT) AS sample_count"""
METRIC_CTES = {"mv": MOVES, "turn": TURN, "ly": LAYERS, "days": DAYS}


@query("e05_metric_summary", sql(f"SELECT model, {METRIC}, {r('avg(turnover)')} AS prediction_turnover FROM days GROUP BY model",
                                 "ic", extra=METRIC_CTES))
def metric_summary(p):
    return ic.metric_summary(predictions(p), slices=p.slices())


@query("e06_daily_ic", sql(f"""SELECT model, d, {r('rank_ic')} AS rank_ic, {r('pearson_ic')} AS pearson_ic, stock_count,
    {r('prediction_std')} AS prediction_std, {r('label_std')} AS label_std FROM ic""", "ic"))
def daily_ic(p):
    rows = predictions(p).where("prediction IS NOT NULL AND label IS NOT NULL")
    return ic.daily_ic(rows, ("model", "d"), slices=p.slices())


def horizon_sql(horizons: str, out: str) -> str:
    return sql(out, "fx", "pxi", extra={
        "hret": f"""SELECT a.symbol, s.d, h.h, b.price/a.price-1 AS ret FROM pxi a JOIN (VALUES {horizons}) h(h) ON true
            JOIN pxi b ON b.symbol=a.symbol AND b.idx=a.idx+h.h JOIN sess s ON s.idx=a.idx-1""",
        "hp": """SELECT h.h, f.d, f.symbol, f.f_tax AS z, h.ret,
            rank() OVER (PARTITION BY h.h, f.d ORDER BY f.f_tax) + (count(*) OVER (PARTITION BY h.h, f.d, f.f_tax)-1)/2.0 AS ra,
            rank() OVER (PARTITION BY h.h, f.d ORDER BY h.ret) + (count(*) OVER (PARTITION BY h.h, f.d, h.ret)-1)/2.0 AS rb
            FROM fx f JOIN hret h ON h.d=f.d AND h.symbol=f.symbol"""})


@query("e07_horizon_ic", horizon_sql("(5),(10),(20),(60)", f"""SELECT k.h AS horizon, s.d, {r('rank_ic')} AS rank_ic,
    {r('pearson_ic')} AS pearson_ic, coalesce(n, 0) AS stock_count FROM sess s JOIN (VALUES (5),(10),(20),(60)) k(h) ON true
    LEFT JOIN (SELECT h, d, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(ra, rb) END AS rank_ic,
      CASE WHEN count(*) >= 3 THEN corr(z, ret) END AS pearson_ic FROM hp GROUP BY h, d) x ON x.h = k.h AND x.d = s.d"""))
def horizon_ic(p):
    fx = p.fx().select("d", "symbol", "f_tax")
    daily = ic.horizon_ic(fx, align.forward_by_signal(fx, p.px(), (5, 10, 20, 60), p.sessions()), "f_tax", p.slices())
    return daily.select("horizon", "d", "rank_ic", "pearson_ic", "stock_count")


def _level(keys: str, level: str, period: str, first: str) -> str:
    return f"""SELECT model, '{level}' AS level, {period} AS period, {METRIC},
        {r(f'avg(CASE WHEN {first} THEN NULL ELSE turnover END)')} AS prediction_turnover
        FROM (SELECT *, row_number() OVER (PARTITION BY model, y ORDER BY d) AS ny, row_number() OVER (PARTITION BY model, q ORDER BY d) AS nq
              FROM days) GROUP BY {keys}"""


@query("e08_layered_metrics", sql(" UNION ALL ".join((_level("model", "full_test", "'all'", "false"),
                                                      _level("model, y", "year", "y", "ny = 1"),
                                                      _level("model, q", "quarter", "q", "nq = 1"))), "ic", extra=METRIC_CTES))
def layered_metrics(p):
    return ic.layered_metrics(predictions(p), p.slices())


def _spearman(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS x, '{b}' AS y, {r('corr(ra, rb)')} AS spearman, count(*) AS n FROM (
        SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a})-1)/2.0 AS ra,
        rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b})-1)/2.0 AS rb FROM fx WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("e09_factor_correlation", sql(" UNION ALL ".join(_spearman(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1:]), "fx"))
def factor_correlation(p):
    return ic.pooled_spearman(p.fx(), FACTORS)


@query("e09_wide_correlation", f"""WITH c AS (SELECT vec_id, unnest(generate_series(1, 64)) AS k, unnest(embedding) AS x FROM embeddings),
    r AS (SELECT vec_id, k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x)-1)/2.0 AS r FROM c)
    SELECT 'c' || a.k AS x, 'c' || b.k AS y, {r('corr(a.r, b.r)')} AS spearman, count(*) AS n FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.k < b.k GROUP BY a.k, b.k""")
def wide_correlation(p):
    """Rank correlations of the 64 columns of ``embeddings``."""
    columns = [F.get("embedding", F.lit(k)).alias(f"c{k + 1}") for k in range(64)]
    return ic.pooled_spearman(p.table("embeddings").select("vec_id", *columns), [f"c{k + 1}" for k in range(64)], ("vec_id",))


@query("e10_factor_coverage", sql(" UNION ALL ".join(
    f"SELECT '{f}' AS factor, count({f}) AS valid, {r(f'1-count({f})/count(*)')} AS missing_rate FROM fx" for f in FACTORS), "fx"))
def factor_coverage(p):
    return ic.coverage(p.fx(), FACTORS)


SORTED = f"""SELECT CAST(yb AS INT) AS yb, CAST(xb AS INT) AS xb, {r('avg(label)')} AS mean_return, count(*) AS n FROM (SELECT label, n,
      greatest(((px-1)*3 + n-2)//nullif(n-1,0) - 1, 0) AS xb, greatest(((py-1)*3 + n-2)//nullif(n-1,0) - 1, 0) AS yb FROM (
      SELECT label, count(*) OVER (PARTITION BY d) AS n, row_number() OVER (PARTITION BY d ORDER BY f_qty, symbol) AS px,
      row_number() OVER (PARTITION BY d ORDER BY f_disc, symbol) AS py FROM data WHERE f_disc IS NOT NULL AND label IS NOT NULL))
    WHERE n >= 30 GROUP BY 1,2"""


@query("e11_double_sort", sql(SORTED, "data"))
def double_sort(p):
    rows = data(p).select("d", "symbol", F.col("f_qty").alias("x"), F.col("f_disc").alias("y"), F.col("label").alias("r"))
    return ic.double_sort(rows, slices=p.slices())


STYLE_ROWS = """SELECT d, symbol, 'f_disc' AS style, f_disc AS x, label, label_entry_date, label_exit_date FROM data
    UNION ALL SELECT d, symbol, 'f_qty', f_qty, label, label_entry_date, label_exit_date FROM data
    UNION ALL SELECT d, symbol, 'f_ret', f_ret, label, label_entry_date, label_exit_date FROM data
    UNION ALL SELECT d, symbol, 'f_tax', f_tax, label, label_entry_date, label_exit_date FROM data"""
STYLE_RETURNS = """SELECT d, style, avg(label) FILTER (WHERE pct >= 0.8::DOUBLE) - avg(label) FILTER (WHERE pct <= 0.2::DOUBLE) AS style_return,
    max(label_entry_date) AS style_entry_date, max(label_exit_date) AS style_exit_date FROM (
      SELECT *, (rank() OVER (PARTITION BY d, style ORDER BY x) + (count(*) OVER (PARTITION BY d, style, x)-1)/2.0::DOUBLE)
        / count(*) OVER (PARTITION BY d, style) AS pct, count(*) OVER (PARTITION BY d, style) AS n
      FROM srows WHERE x IS NOT NULL AND label IS NOT NULL) WHERE n >= 10 GROUP BY d, style"""
STYLE_CTES = {"srows": STYLE_ROWS, "sret": STYLE_RETURNS}


def style_rows(p):
    keep = ["d", "symbol", "label", "label_entry_date", "label_exit_date"]
    return data(p).select(*keep, *FACTORS).unpivot(keep, FACTORS, "style", "x")


def style_returns(p):
    return kept(style.style_returns(style_rows(p), slices=p.slices()))


@query("e12_style_returns", sql(f"""SELECT d, style, {r('style_return')} AS style_return, style_entry_date, style_exit_date FROM sret""",
                                "data", extra=STYLE_CTES))
def style_returns_query(p):
    return style_returns(p)


Z = ", ".join(f"coalesce((f.{f}-s.m_{f})/CASE WHEN s.s_{f} > 1e-12 THEN s.s_{f} ELSE 1 END, 0) AS {f}" for f in FACTORS)
STD = {"fst": "SELECT d, " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FACTORS) + " FROM fx GROUP BY d",
       "zx": f"SELECT f.d, f.symbol, {Z} FROM fx f JOIN fst s ON s.d = f.d"}


@query("e13_second_moments", sql(" UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, {r('avg(m)')} AS moment, count(*) AS dates FROM (SELECT sum({a}*{b})/count(*) AS m FROM zx
    GROUP BY d HAVING count(*) > 4)""" for i, a in enumerate(FACTORS) for b in FACTORS[i:]), "fx", extra=STD))
def second_moments(p):
    return gram.mean_second_moments(xs.standardise(p.fx(), FACTORS), FACTORS)


@query("e13_wide_moments", sql(f"""SELECT printf('v%02d', i) AS a, printf('v%02d', j) AS b, {r('avg(m)')} AS moment, count(*) AS dates FROM (
    SELECT label, i, j, sum(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE)) / count(*) AS m
    FROM embeddings, (SELECT unnest(range(64)) AS i) x, (SELECT unnest(range(64)) AS j) y WHERE i <= j GROUP BY ALL) GROUP BY ALL"""))
def wide_moments(p):
    """Moments of 64 columns, a group per label: the block's form does not change with their number."""
    names = [f"v{k:02d}" for k in range(64)]
    rows = p.table("embeddings").select("label", *[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)])
    return gram.mean_second_moments(rows, names, date="label", least=0)


@query("e14_retain_audit", sql(f"""SELECT d, count(DISTINCT symbol) AS stock_count, count(*) FILTER (WHERE v < 2) AS retained_count,
    {r('avg(v)')} AS average_sell_votes FROM (SELECT d, symbol, CAST(f_qty AS BIGINT) % 4 AS v FROM fx) GROUP BY d""", "fx"))
def retain_audit(p):
    votes = p.fx().select("d", "symbol", (F.col("f_qty").cast("bigint") % 4).alias("sell_votes"))
    return style.retain_audit(style.retain_flags(votes))


@query("e15_component_ic_quarterly", sql(f"""SELECT q AS quarter, style, {r('avg(ic)')} AS mean_rank_ic, {r('stddev_samp(ic)')} AS rank_ic_std,
    {r('avg(ic)/nullif(stddev_samp(ic),0)')} AS icir, {r('avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE WHEN ic IS NOT NULL THEN 0.0::DOUBLE END)')} AS positive_ratio,
    count(ic) AS observation_days, {r('avg(n)')} AS average_stock_count FROM (
    SELECT d, style, CAST(year(d) AS VARCHAR) || 'Q' || quarter(d) AS q, count(ra) AS n,
      CASE WHEN count(ra) > 1 AND stddev_samp(x) FILTER (WHERE ok) > 1e-12 THEN corr(ra, rb) END AS ic FROM (
      SELECT d, style, x, ok, CASE WHEN ok THEN rank() OVER (PARTITION BY d, style, ok ORDER BY x) + (count(*) OVER (PARTITION BY d, style, ok, x)-1)/2.0 END AS ra,
        CASE WHEN ok THEN rank() OVER (PARTITION BY d, style, ok ORDER BY label) + (count(*) OVER (PARTITION BY d, style, ok, label)-1)/2.0 END AS rb
      FROM (SELECT *, x IS NOT NULL AND label IS NOT NULL AS ok FROM srows)) GROUP BY d, style) GROUP BY q, style""", "data", extra={"srows": STYLE_ROWS}))
def component_ic_quarterly(p):
    daily = ic.daily_ic(style_rows(p), ("style", "d"), "x", slices=p.slices())
    return style.quarterly_component_ic(daily)


@query("e16_component_ic_same_names", sql(f"""SELECT d, component, count(*) AS stock_count,
    {r('CASE WHEN count(*) > 1 AND stddev_samp(x) > 1e-12 THEN corr(ra, rb) END')} AS rank_ic FROM (
    SELECT d, component, x, rank() OVER (PARTITION BY d, component ORDER BY x) + (count(*) OVER (PARTITION BY d, component, x)-1)/2.0 AS ra,
      rank() OVER (PARTITION BY d, component ORDER BY label) + (count(*) OVER (PARTITION BY d, component, label)-1)/2.0 AS rb FROM (
      SELECT d, symbol, 'style_timing' AS component, f_qty AS x, label FROM data WHERE f_disc IS NOT NULL UNION ALL
      SELECT d, symbol, 'orthogonal_residual', f_tax, label FROM data WHERE f_disc IS NOT NULL UNION ALL
      SELECT d, symbol, 'final', f_disc, label FROM data WHERE f_disc IS NOT NULL UNION ALL
      SELECT d, symbol, 'orthogonal_residual_all_universe', f_tax, label FROM data) WHERE label IS NOT NULL) GROUP BY d, component""", "data"))
def component_ic_same_names(p):
    rows = data(p).select("d", "symbol", "label", F.col("f_qty").alias("style_timing_score"),
                          F.col("f_tax").alias("residual_prediction_score"), F.col("f_disc").alias("prediction"))
    long = style.component_rows(rows.where("label IS NOT NULL"))
    return ic.daily_ic(long, ("component", "d"), "x", slices=p.slices()).select("d", "component", "stock_count", "rank_ic")


@query("e17_quarterly_icir_join", sql(f"""SELECT t.model, t.quarter, t.samples, {r('q.m')} AS quarter_rank_ic,
    {r('q.m/nullif(q.s,0)')} AS quarter_icir FROM (SELECT model, CAST(year(d) AS VARCHAR) || 'Q' || quarter(d) AS quarter, count(*) AS samples
      FROM pred GROUP BY 1,2) t LEFT JOIN (SELECT model, CAST(year(d) AS VARCHAR) || 'Q' || quarter(d) AS quarter, avg(rank_ic) AS m,
      stddev_samp(rank_ic) AS s FROM ic GROUP BY 1,2) q ON q.model = t.model AND q.quarter = t.quarter""", "ic"))
def quarterly_icir_join(p):
    rows = predictions(p)
    records = rows.groupBy("model", c.quarter_name(F.col("d")).alias("quarter")).agg(F.count("*").alias("samples"))
    daily = ic.daily_ic(rows.where("prediction IS NOT NULL AND label IS NOT NULL"), ("model", "d"), slices=p.slices())
    quarterly = daily.groupBy("model", c.quarter_name(F.col("d")).alias("quarter")).agg(
        F.avg("rank_ic").alias("quarter_rank_ic"), F.stddev_samp("rank_ic").alias("s"))
    return records.join(quarterly, ["model", "quarter"], "left").select(
        "model", "quarter", "samples", "quarter_rank_ic", F.try_divide("quarter_rank_ic", "s").alias("quarter_icir"))


@query("e18_ledger_totals", sql(f"""SELECT round(sum(fee),2)+0.0 AS total_fees, {r('sum(gross)/avg(gross)')} AS turnover,
    CAST(sum(n) AS BIGINT) AS trade_count, round(sum(cash),2)+0.0 AS no_fee_cash, round(sum(cash-fee),2)+0.0 AS net_cash FROM (
    SELECT d, sum(gross) AS gross, count(*) AS n, sum({FEE_SQL}) AS fee, sum(CASE WHEN side='SELL' THEN gross ELSE -gross END) AS cash
    FROM ledger GROUP BY d)""", "ledger"))
def ledger_totals(p):
    row = quality.ledger_totals(p.ledger(), cutover="1998-01-01")
    return row.withColumns({k: F.round(k, 2) for k in ("total_fees", "no_fee_cash", "net_cash")})


@query("e19_pool_coverage", sql(f"""SELECT {r('avg(n)')} AS average_stock_count, {r('avg(n*1.0::DOUBLE/members)')} AS signal_coverage,
    {r('avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE WHEN ic IS NOT NULL THEN 0.0::DOUBLE END)')} AS positive_ratio FROM (
    SELECT d, count(*) AS members, count(*) FILTER (WHERE ok) AS n, CASE WHEN count(*) FILTER (WHERE ok) > 1 THEN corr(ra, rb) END AS ic FROM (
      SELECT d, ok, CASE WHEN ok THEN rank() OVER (PARTITION BY d, ok ORDER BY f_disc) + (count(*) OVER (PARTITION BY d, ok, f_disc)-1)/2.0 END AS ra,
        CASE WHEN ok THEN rank() OVER (PARTITION BY d, ok ORDER BY label) + (count(*) OVER (PARTITION BY d, ok, label)-1)/2.0 END AS rb
      FROM (SELECT x.d, x.symbol, f_disc, label, f_disc IS NOT NULL AND label IS NOT NULL AS ok FROM pool m
            LEFT JOIN data x ON x.d = m.d AND x.symbol = m.symbol WHERE member)) GROUP BY d)""", "data", "pool"))
def pool_coverage(p):
    rows = p.pool().where("member").select("d", "symbol").join(data(p).select("d", "symbol", "f_disc", "label"), ["d", "symbol"], "left")
    return quality.pool_coverage(rows, "f_disc", p.slices())


@query("e20_neutral_audit", sql(f"""SELECT d, count(*) AS covered, count(DISTINCT industry) AS industry_count, {r('max(abs(im))')} AS max_abs_industry_mean,
    {r('stddev_pop(f_qty)')} AS raw_score_std, {r('stddev_pop(neutral)')} AS optimized_score_std FROM (
    SELECT *, avg(neutral) OVER (PARTITION BY d, industry) AS im FROM (
      SELECT *, c * CASE WHEN stddev_pop(c) OVER (PARTITION BY d) > 1e-12 THEN stddev_pop(f_qty) OVER (PARTITION BY d)/stddev_pop(c) OVER (PARTITION BY d) ELSE 1 END AS neutral
      FROM (SELECT f.d, f.symbol, f_qty, industry, f_qty - avg(f_qty) OVER (PARTITION BY f.d, industry) AS c FROM fx f JOIN industry i ON i.symbol = f.symbol)))
    GROUP BY d""", "fx", "industry"))
def neutral_audit(p):
    return xs.neutral_audit(xs.neutralise(p.fx().select("d", "symbol", "f_qty"), p.industry(), "f_qty"), "f_qty")


@query("e21_risk_events", sql(f"""SELECT count(*) FILTER (WHERE scheduled) AS scheduled_rebalance_days, count(*) FILTER (WHERE NOT enabled) AS risk_paused_days,
    count(*) FILTER (WHERE exposure < 0.999::DOUBLE) AS adjustment_days, {r('avg(exposure)')} AS average_target_exposure,
    {r('min(exposure)')} AS minimum_target_exposure FROM (SELECT d, month(d) % 3 = 1 AS scheduled,
      value/max(value) OVER (ORDER BY d)-1 > -0.02::DOUBLE AS enabled,
      least(1, greatest(0.3::DOUBLE, 1 + 5*(value/max(value) OVER (ORDER BY d)-1))) AS exposure FROM benchmark)""", "benchmark"))
def risk_events(p):
    fall = F.col("value") / F.max("value").over(Window.orderBy("d")) - 1
    events = p.benchmark().select("d", (F.month("d") % 3 == 1).alias("scheduled_rebalance"), (fall > -0.02).alias("trade_enabled"),
                                  c.clip(1 + 5 * fall, 0.3, 1.0).alias("target_exposure"))
    return quality.risk_event_summary(events)


@query("e22_signal_flags", sql("""SELECT d, risk_off AND true AS risk_off, NOT risk_off AS trade_enabled FROM (
    SELECT d, avg(f_ret) > 0.25::DOUBLE AS risk_off FROM fx GROUP BY d)""", "fx"))
def signal_flags(p):
    fx = p.fx()
    flags = xs.with_stats(fx, ("d",), (F.avg("f_ret") > 0.25).alias("risk_off"))
    return quality.daily_flag(flags, "risk_off").withColumn("trade_enabled", ~F.col("risk_off"))


@query("e23_cross_style_ic", sql(f"""SELECT d, {r('CASE WHEN n >= 3 AND sx > 1e-12 AND sy > 1e-12 THEN ic END')} AS rank_ic,
    {r('avg(CASE WHEN n >= 3 AND sx > 1e-12 AND sy > 1e-12 THEN ic END) OVER ()')} AS mean_rank_ic FROM (
    SELECT d, count(*) AS n, stddev_samp(y) AS sy, stddev_samp(x) AS sx, corr(ra, rb) AS ic FROM (
      SELECT d, x, y, rank() OVER (PARTITION BY d ORDER BY x) + (count(*) OVER (PARTITION BY d, x)-1)/2.0 AS ra,
        rank() OVER (PARTITION BY d ORDER BY y) + (count(*) OVER (PARTITION BY d, y)-1)/2.0 AS rb FROM (
        SELECT d, style, round(avg(style_return) OVER (PARTITION BY style ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 10) AS x,
          round(style_return, 10) AS y FROM sret) WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY d)""", "data", extra=STYLE_CTES))
def cross_style_ic(p):
    past = Window.partitionBy("style").orderBy("d").rowsBetween(-5, -1)
    rows = style_returns(p).select("d", "style", F.round("style_return", 10).alias("y"),
                                   F.round(F.avg("style_return").over(past), 10).alias("x"))
    daily = style.cross_style_ic(rows.where("x IS NOT NULL AND y IS NOT NULL"), "x", "y")
    return daily.select("d", "rank_ic", F.avg("rank_ic").over(Window.partitionBy()).alias("mean_rank_ic"))
