"""Section D: joins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from factorloom.operators import align, calendar, cross_section as xs, selection, series
from factorloom.plans.aggregates import STD, STYLE_CTES, style_returns
from factorloom.plans.inputs import FACTORS, data, kept
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query


@query("d01_factor_label_join", sql(f"SELECT d, symbol, f_qty, {r('label')} AS label, label_entry_date, label_exit_date FROM data", "data"))
def factor_label_join(p):
    fx = p.fx()
    joined = align.dataset(align.require_unique(fx), align.require_unique(align.labels(p.px(), fx, p.sessions())))
    return joined.select("d", "symbol", "f_qty", "label", "label_entry_date", "label_exit_date")


@query("d02_key_intersection", sql("""SELECT (SELECT count(*) FROM (SELECT d FROM px INTERSECT SELECT d FROM fx WHERE f_disc IS NOT NULL
      INTERSECT SELECT d FROM st WHERE st INTERSECT SELECT d FROM pool WHERE member INTERSECT SELECT d FROM adj)) AS dates,
    (SELECT count(*) FROM (SELECT symbol FROM px INTERSECT SELECT symbol FROM fx WHERE f_disc IS NOT NULL
      INTERSECT SELECT symbol FROM st WHERE st INTERSECT SELECT symbol FROM pool WHERE member INTERSECT SELECT symbol FROM adj)) AS symbols,
    true AS enough""", "px", "fx", "st", "pool", "adj"))
def key_intersection(p):
    tables = [p.px(), p.fx().where("f_disc IS NOT NULL"), p.st().where("st"), p.pool().where("member"), p.adj()]
    return align.common_keys(tables, 2, 1)[2]


# two signal dates in the month, so that two signals meet on one session
TWICE = """SELECT symbol, d, f_disc AS v FROM sparse UNION ALL
    SELECT symbol, CAST(d + INTERVAL 10 DAY AS DATE), CASE WHEN f_ret > 0.2::DOUBLE THEN f_tax END FROM sparse"""


def twice(p):
    s = p.sparse()
    return s.select("symbol", "d", F.col("f_disc").alias("v")).unionByName(
        s.select("symbol", F.date_add("d", 10).alias("d"), F.when(F.col("f_ret") > 0.2, F.col("f_tax")).alias("v")))


@query("d03_asof_backward", sql(f"""SELECT CAST(date_trunc('month', d) AS DATE) AS d, symbol,
    {r('arg_max(v, d) FILTER (WHERE v IS NOT NULL)')} AS v FROM tw GROUP BY 1, 2""", "sparse", "sess", extra={"tw": TWICE}))
def asof_backward(p):
    return align.signals_on_sessions(twice(p), p.sessions(), "v")


@query("d04_asof_forward", sql(f"""SELECT s.d, s.symbol, CAST(h AS INT) AS horizon, {r('b.price/a.price-1')} AS forward_return
    FROM sparse s JOIN (VALUES (1),(2),(5)) h(h) ON true
    LEFT JOIN (SELECT sp.d, min(q.idx) AS e FROM (SELECT DISTINCT d FROM sparse) sp JOIN sess q ON q.d > sp.d GROUP BY sp.d) m ON m.d = s.d
    LEFT JOIN pxi a ON a.symbol = s.symbol AND a.idx = m.e LEFT JOIN pxi b ON b.symbol = s.symbol AND b.idx = m.e + h""", "sparse", "pxi"))
def asof_forward(p):
    return align.forward_by_signal(p.sparse(), p.px(), (1, 2, 5), p.sessions())


@query("d05_label_builder", sql(f"""SELECT s.d, s.symbol, {r('b.price/a.price-1')} AS label, m.ed AS label_entry_date, m.xd AS label_exit_date
    FROM sparse s JOIN (SELECT d, CASE WHEN nd IS NOT NULL AND xd IS NOT NULL THEN ed END AS ed, CASE WHEN nd IS NOT NULL THEN xd END AS xd FROM (
      SELECT d, nd, (SELECT min(q.d) FROM sess q WHERE q.d > t.d) AS ed, (SELECT min(q.d) FROM sess q WHERE q.d > t.nd) AS xd
      FROM (SELECT d, lead(d) OVER (ORDER BY d) AS nd FROM (SELECT DISTINCT d FROM sparse)) t)) m ON m.d = s.d
    LEFT JOIN px a ON a.symbol = s.symbol AND a.d = m.ed LEFT JOIN px b ON b.symbol = s.symbol AND b.d = m.xd""", "sparse", "sess"))
def label_builder(p):
    return align.labels(p.px(), p.sparse(), p.sessions())


@query("d06_signal_carried_daily", sql("""SELECT d, symbol, f_qty FROM (SELECT x.d, x.symbol,
      (SELECT arg_max(s.f_qty, s.d) FROM sparse s WHERE s.symbol = x.symbol AND s.d < x.d) AS f_qty FROM px x) WHERE f_qty IS NOT NULL""", "px", "sparse"))
def signal_carried_daily(p):
    return align.carried_to_sessions(p.sparse(), p.px(), "f_qty", p.sessions())


@query("d07_industry_asof", sql("""SELECT x.d, x.symbol, i.industry AS static_industry, a.industry AS dated_industry FROM px x
    LEFT JOIN industry i ON i.symbol = x.symbol ASOF LEFT JOIN industry_dated a ON a.symbol = x.symbol AND a.d <= x.d""",
                                "px", "industry", "industry_dated"))
def industry_asof(p):
    rows = p.px().select("d", "symbol")
    fixed = align.with_industry(rows, p.industry()).withColumnRenamed("industry", "static_industry")
    return align.with_industry(fixed, p.industry_dated()).withColumnRenamed("industry", "dated_industry")


@query("d08_signal_eligibility", sql("""SELECT s.d, x.symbol FROM sess s JOIN sparse x ON x.f_disc IS NOT NULL
    AND x.d = (SELECT max(z.d) FROM sparse z WHERE z.f_disc IS NOT NULL AND z.d <= s.d)""", "sess", "sparse"))
def signal_eligibility(p):
    return align.eligibility(p.sparse(), p.sessions(), "f_disc")


@query("d09_series_forward_fill", sql(f"""SELECT s.d, {r('(SELECT arg_max(b.value, b.d) FROM benchmark b WHERE b.d <= s.d AND month(b.d) % 3 = 0)')} AS value
    FROM sess s""", "sess", "benchmark"))
def series_forward_fill(p):
    return series.filled_on(p.benchmark().where(F.month("d") % 3 == 0), p.sessions(), "value")


@query("d10_pool_filter", sql(f"SELECT x.d, x.symbol, {r('x.price')} AS price FROM px x JOIN pool m ON m.d = x.d AND m.symbol = x.symbol WHERE member",
                              "px", "pool"))
def pool_filter(p):
    return align.in_pool(p.px(), p.pool())


LONG = " UNION ALL ".join(f"SELECT d, symbol, '{f}' AS style, {f} AS x FROM zx" for f in FACTORS)
WEIGHT = " UNION ALL ".join(f"SELECT d, '{f}' AS style, avg({f}) AS w FROM fx GROUP BY d" for f in FACTORS)


def exposures(p):
    """Standardised factors as long (d, symbol, style, x)."""
    return xs.standardise(p.fx(), FACTORS).unpivot(["d", "symbol"], FACTORS, "style", "x")


def style_weights(p):
    means = p.fx().groupBy("d").agg(*[F.avg(f).alias(f) for f in FACTORS])
    return means.unpivot(["d"], FACTORS, "style", "w")


@query("d11_weighted_style_score", sql(f"""SELECT d, symbol, {r('(s-avg(s) OVER (PARTITION BY d))/CASE WHEN stddev_pop(s) OVER (PARTITION BY d) > 1e-12 THEN stddev_pop(s) OVER (PARTITION BY d) ELSE 1 END')} AS prediction
    FROM (SELECT e.d, e.symbol, sum(x*w) AS s FROM lg e JOIN wt w ON w.d = e.d AND w.style = e.style GROUP BY 1,2)""", "fx",
                                       extra={**STD, "lg": LONG, "wt": WEIGHT}))
def weighted_style_score(p):
    return selection.style_score(exposures(p), style_weights(p))


@query("d12_forecast_realised", sql(f"""SELECT w.d, w.style, {r('w.w')} AS predicted_return, {r('s.style_return')} AS realised_return, s.style_exit_date AS label_exit_date
    FROM wt w LEFT JOIN sret s ON s.d = w.d AND s.style = w.style""", "data", extra={**STYLE_CTES, "wt": WEIGHT}))
def forecast_realised(p):
    actual = style_returns(p).select("d", "style", F.col("style_return").alias("realised_return"),
                                     F.col("style_exit_date").alias("label_exit_date"))
    return style_weights(p).withColumnRenamed("w", "predicted_return").join(actual, ["d", "style"], "left")


@query("d13_pool_score_label", sql(f"""SELECT m.d, m.symbol, {r('f.f_disc')} AS score, {r('l.label')} AS label FROM pool m
    LEFT JOIN fx f ON f.d = m.d AND f.symbol = m.symbol AND f.f_tax > 0.03::DOUBLE LEFT JOIN lab l ON l.d = m.d AND l.symbol = m.symbol WHERE member""", "pool", "lab"))
def pool_score_label(p):
    scores = p.fx().where("f_tax > 0.03").select("d", "symbol", F.col("f_disc").alias("score"))
    labels = align.labels(p.px(), p.fx(), p.sessions()).select("d", "symbol", "label")
    return p.pool().where("member").select("d", "symbol").join(scores, ["d", "symbol"], "left").join(labels, ["d", "symbol"], "left")


SPLITS = """SELECT CAST(year(d) AS VARCHAR) || 'Q' || quarter(d) AS name, min(d) AS prediction_start, max(d) AS prediction_end,
    (SELECT max(x.d) FROM fx x WHERE x.d < min(c.d)) AS train_cutoff FROM (SELECT DISTINCT d FROM fx) c
    WHERE d >= (SELECT date_trunc('quarter', min(d) + INTERVAL 27 MONTH) FROM fx) GROUP BY 1"""


def splits(p, start=None, end=None, frequency="quarterly"):
    """Refits over the whole calendar, from the first quarter with two years behind it, unless the ends are given."""
    dates = p.sessions().select("d")
    first, last = dates.agg(F.date_trunc("quarter", F.add_months(F.min("d"), 27)).cast("date").cast("string"), F.max("d").cast("string")).first()
    return calendar.refit_periods(dates, frequency, start or first, end or last)


@query("d14_training_rows", sql("""SELECT s.name, 'expanding' AS mode, count(*) AS n, min(x.d) AS first_d, max(x.label_exit_date) AS last_exit
    FROM data x JOIN sp s ON x.d >= DATE '1993-01-01' AND x.label IS NOT NULL AND x.label_exit_date <= s.train_cutoff GROUP BY 1
    UNION ALL SELECT s.name, 'fixed', count(*), min(x.d), max(x.label_exit_date) FROM data x JOIN sp s
      ON x.d >= CAST(s.train_cutoff - INTERVAL 2 YEAR + INTERVAL 1 DAY AS DATE) AND x.label IS NOT NULL AND x.label_exit_date <= s.train_cutoff GROUP BY 1""",
                                "data", extra={"sp": SPLITS}))
def training_rows(p):
    rows, sp = data(p), kept(splits(p))
    counts = kept(rows.where("label IS NOT NULL").groupBy("d", "label_exit_date").agg(F.count("*").alias("rows")))

    def summary(mode):
        picked = align.in_training(counts, sp, "1993-01-01", mode, years=2)  # sums per date, not rows, go to the splits
        return picked.groupBy("name").agg(F.lit(mode).alias("mode"), F.sum("rows").alias("n"), F.min("d").alias("first_d"),
                                          F.max("label_exit_date").alias("last_exit"))

    return summary("expanding").unionByName(summary("fixed"))


@query("d15_prediction_rows", sql("""SELECT s.name, x.d, count(*) AS n FROM data x JOIN sp s ON x.d BETWEEN s.prediction_start AND s.prediction_end
    GROUP BY 1, 2""", "data", extra={"sp": SPLITS}))
def prediction_rows(p):
    return align.prediction_rows(p.fx(), splits(p)).groupBy("name", "d").agg(F.count("*").alias("n"))


TOP = "SELECT d, symbol FROM (SELECT f.d, f.symbol, s.idx, row_number() OVER (PARTITION BY f.d ORDER BY f_qty DESC, f.symbol) AS k FROM fx f JOIN sess s ON s.d = f.d) WHERE k <= 10"


@query("d16_held_and_new", sql("""SELECT t.d, t.symbol, CASE WHEN EXISTS (SELECT 1 FROM top p JOIN sess a ON a.d = p.d JOIN sess b ON b.d = t.d
      WHERE p.symbol = t.symbol AND a.idx = b.idx - 1) THEN 'kept' ELSE 'new' END AS status FROM top t""", "fx", "sess", extra={"top": TOP}))
def held_and_new(p):
    top = selection.top_n(p.fx().select("d", "symbol", F.col("f_qty").alias("score")), 10).select("d", "symbol")
    cal = p.sessions()
    following = cal.select("d", F.lead("d").over(Window.orderBy("d")).alias("next_d"))
    held = top.join(calendar.calendar_broadcast(following), "d").select(F.col("next_d").alias("d"), "symbol").where("d IS NOT NULL")
    return (top.join(held, ["d", "symbol"], "left_semi").withColumn("status", F.lit("kept"))
            .unionByName(top.join(held, ["d", "symbol"], "left_anti").withColumn("status", F.lit("new"))))
