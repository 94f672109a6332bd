"""Section G: sorts, limits and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import selection
from factorloom.plans.aggregates import STYLE_CTES, style_returns
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query


def scores(p):
    return p.fx().select("d", "symbol", F.col("f_qty").alias("score"))


DESC = "SELECT d, symbol, f_qty, row_number() OVER (PARTITION BY d ORDER BY f_qty DESC, symbol) AS k, count(*) OVER (PARTITION BY d) AS n FROM fx"


@query("g01_top_n", sql("SELECT d, symbol, f_qty AS score, CAST(k AS INT) AS rank FROM ds WHERE k <= 20", "fx", extra={"ds": DESC}))
def top_n(p):
    return selection.top_n(scores(p), 20)


@query("g02_top_quantile", sql("SELECT d, symbol, f_qty AS score, k AS rank FROM ds WHERE k <= greatest(1, ceil(n*0.1::DOUBLE))", "fx", extra={"ds": DESC}))
def top_quantile(p):
    return selection.top_quantile(scores(p), 0.1, slices=p.slices())


PCT = """SELECT d, symbol, (rank() OVER (PARTITION BY d ORDER BY f_qty) + (count(*) OVER (PARTITION BY d, f_qty)-1)/2.0::DOUBLE)/count(*) OVER (PARTITION BY d) AS pct,
    count(*) OVER (PARTITION BY d) AS n FROM ds WHERE k <= 20"""


@query("g03_rank_weights", sql(f"SELECT d, symbol, {r('1.0::DOUBLE/n')} AS equal_weight, {r('pct/sum(pct) OVER (PARTITION BY d)')} AS weight FROM pc", "fx",
                               extra={"ds": DESC, "pc": PCT}))
def rank_weights(p):
    chosen = selection.top_n(scores(p), 20)
    equal = selection.weights(chosen, "equal").select("d", "symbol", F.col("weight").alias("equal_weight"))
    return selection.weights(chosen, "score", slices=0).select("d", "symbol", "weight").join(equal, ["d", "symbol"])


@query("g04_tilted_weights", sql(f"SELECT d, symbol, {r('0.2/n + 0.8*pct/sum(pct) OVER (PARTITION BY d)')} AS weight FROM pc", "fx",
                                 extra={"ds": DESC, "pc": PCT}))
def tilted_weights(p):
    return selection.weights(selection.top_n(scores(p), 20), "tilted", slices=0).select("d", "symbol", "weight")


@query("g05_industry_budget", sql(f"""SELECT d, symbol, {r('w/sum(w) OVER (PARTITION BY d, ind)/ni')} AS weight FROM (
    SELECT *, (SELECT count(DISTINCT z.ind) FROM wi z WHERE z.d = wi.d) AS ni FROM wi)""", "fx", "industry", extra={"ds": DESC, "pc": PCT, "wi": """
    SELECT pc.d, pc.symbol, pct/sum(pct) OVER (PARTITION BY pc.d) AS w, coalesce(CAST(i.industry AS VARCHAR), 'UNKNOWN') AS ind
    FROM pc LEFT JOIN industry i ON i.symbol = pc.symbol AND i.industry <> 4"""}))
def industry_budget(p):
    weighted = selection.weights(selection.top_n(scores(p), 20), "score", slices=0).select("d", "symbol", "weight")
    return selection.equal_industry_budget(weighted, p.industry().where("industry <> 4")).select("d", "symbol", "weight")


def prior_holdings(p):
    """Top 20 by another factor, as the book to rotate."""
    return selection.top_n(p.fx().select("d", "symbol", F.col("f_tax").alias("score")), 20).select("d", "symbol")


HELD = "SELECT d, symbol FROM (SELECT d, symbol, row_number() OVER (PARTITION BY d ORDER BY f_tax DESC, symbol) AS k FROM fx) WHERE k <= 20"
SCORED = """SELECT h.d, h.symbol, ds.f_qty, ds.k, CAST(f.f_qty AS BIGINT) % 5 = 0 AS retain FROM held h
    LEFT JOIN ds ON ds.d = h.d AND ds.symbol = h.symbol LEFT JOIN fx f ON f.d = h.d AND f.symbol = h.symbol"""
REFILL = """SELECT d, symbol, 'buy' AS action FROM (SELECT c.d, c.symbol, row_number() OVER (PARTITION BY c.d ORDER BY c.f_qty DESC, c.symbol) AS j, fr.free
    FROM cand c JOIN (SELECT d, 20 - count(*) FILTER (WHERE NOT sold) AS free FROM (SELECT h.d, h.symbol, s.symbol IS NOT NULL AS sold FROM held h
      LEFT JOIN sold s ON s.d = h.d AND s.symbol = h.symbol) GROUP BY d) fr ON fr.d = c.d
    WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.d = c.d AND h.symbol = c.symbol AND NOT EXISTS (SELECT 1 FROM sold s WHERE s.d = h.d AND s.symbol = h.symbol)))
    WHERE j <= free"""


@query("g06_buffered_replacement", sql(f"SELECT d, symbol, 'sell' AS action FROM sold UNION ALL {REFILL}", "fx", extra={
    "ds": DESC, "held": HELD, "sc": SCORED, "cand": "SELECT * FROM ds",
    "sold": """SELECT d, symbol FROM (SELECT d, symbol, row_number() OVER (PARTITION BY d ORDER BY f_qty, symbol) AS j FROM sc
        WHERE k > 20 AND NOT retain) WHERE j <= 6"""}))
def buffered_replacement(p):
    retain = p.fx().select("d", "symbol", (F.col("f_qty").cast("bigint") % 5 == 0).alias("retain"))
    return selection.buffered_replacement(scores(p), prior_holdings(p), 20, 0.30, retain)


@query("g07_decile_rotation", sql(f"SELECT d, symbol, 'sell' AS action FROM sold UNION ALL {REFILL}", "fx", extra={
    "ds": DESC, "held": HELD, "sc": SCORED, "cand": "SELECT * FROM ds WHERE k <= greatest(1, ceil(n*0.15::DOUBLE))",
    "sold": """SELECT d, symbol FROM (SELECT d, symbol, row_number() OVER (PARTITION BY d ORDER BY f_qty, symbol) AS j, count(*) OVER (PARTITION BY d) AS h FROM sc)
        WHERE j <= least(6, greatest(1, ceil(h*0.15::DOUBLE)))"""}))
def decile_rotation(p):
    return selection.decile_rotation(scores(p), prior_holdings(p), 20, 0.30, 0.15, slices=p.slices())


@query("g08_style_picks", sql(f"""SELECT d, max(style) FILTER (WHERE k = 1) AS best, max(style) FILTER (WHERE k = n) AS worst, {r('max(style_return)')} AS best_return
    FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY style_return DESC, style) AS k, count(*) OVER (PARTITION BY d) AS n FROM sret) GROUP BY d""", "data", extra=STYLE_CTES))
def style_picks(p):
    ret, name = F.col("style_return"), F.col("style")
    return style_returns(p).groupBy("d").agg(
        F.min(F.struct((-ret).alias("a"), name))["style"].alias("best"), F.max(F.struct((-ret).alias("a"), name))["style"].alias("worst"),
        F.max(ret).alias("best_return"))
