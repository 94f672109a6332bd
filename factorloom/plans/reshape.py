"""Section H: set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import columns as c
from factorloom.operators import quality, reshape
from factorloom.plans.inputs import FACTORS
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query


@query("h01_union_models", sql("""SELECT 'a' AS model, d, symbol, f_qty AS prediction, NULL::BIGINT AS sell_votes FROM fx UNION ALL
    SELECT 'b', d, symbol, f_qty*2, CAST(f_qty AS BIGINT) % 3 FROM fx""", "fx"))
def union_models(p):
    fx = p.fx()
    a = fx.select(F.lit("a").alias("model"), "d", "symbol", F.col("f_qty").alias("prediction"))
    b = fx.select(F.lit("b").alias("model"), "d", "symbol", (F.col("f_qty") * 2).alias("prediction"),
                  (F.col("f_qty").cast("bigint") % 3).alias("sell_votes"))
    return quality.union_all([a, b])


@query("h02_key_intersect", sql("SELECT d FROM px INTERSECT SELECT d FROM sparse_m", "px", "fx", extra={"sparse_m": "SELECT d FROM fx WHERE f_ret > 0.9::DOUBLE"}))
def key_intersect(p):
    return p.px().select("d").intersect(p.fx().where("f_ret > 0.9").select("d"))


@query("h03_date_union", sql("SELECT d FROM px UNION SELECT d FROM sparse", "px", "sparse"))
def date_union(p):
    return p.px().select("d").union(p.sparse().select("d")).distinct()


@query("h04_difference", sql("""SELECT 'date' AS kind, CAST(d AS VARCHAR) AS name FROM (SELECT d FROM px EXCEPT SELECT d FROM fx WHERE month(d) % 3 = 0)
    UNION ALL SELECT 'quarter', '1980Q1'""", "px", "fx"))
def difference(p):
    dates = p.px().select("d").distinct().join(p.fx().where(F.month("d") % 3 == 0).select("d").distinct(), "d", "left_anti")
    quarters = p.px().select(c.quarter_name(F.col("d")).alias("quarter"))
    gone = reshape.missing_names(["1980Q1", "1995Q1"], quarters, "quarter")
    return dates.select(F.lit("date").alias("kind"), F.col("d").cast("string").alias("name")).unionByName(
        gone.select(F.lit("quarter").alias("kind"), F.col("quarter").alias("name")))


@query("h05_keep_last", sql(f"""SELECT symbol, order_id, d, side, {r('gross')} AS gross FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC, order_id DESC) AS k
    FROM ledger) WHERE k = 1""", "ledger"))
def keep_last(p):
    return reshape.keep_last(p.ledger(), ["symbol"], ["d", "order_id"])


INDUSTRIES = [str(k) for k in range(5)]


@query("h06_long_to_wide", sql("SELECT d, " + ", ".join(f"{r(f'sum(price) FILTER (WHERE industry = {k})')} AS \"{k}\"" for k in INDUSTRIES)
                               + " FROM px JOIN industry USING (symbol) GROUP BY d", "px", "industry"))
def long_to_wide(p):
    # the axis is the fixed list of industries; every price is in a cell
    cells = p.px().join(p.industry(), "symbol").groupBy("d", F.col("industry").cast("string").alias("industry")).agg(F.sum("price").alias("price"))
    return reshape.widen(cells, "d", "industry", "price", INDUSTRIES, "d")


@query("h07_wide_to_long", sql(" UNION ALL ".join(f"SELECT d, symbol, '{f}' AS factor, {r(f)} AS value FROM fx WHERE {f} IS NOT NULL" for f in FACTORS), "fx"))
def wide_to_long(p):
    return reshape.lengthen(p.fx(), ["d", "symbol"], FACTORS, "factor", "value", drop_null=True)
