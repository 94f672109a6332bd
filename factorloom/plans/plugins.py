"""Section K: factor and score plug-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import factors as fx_ops
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query


def z(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE greatest(least(({expr}-avg({expr}) OVER w)/nullif(stddev_pop({expr}) OVER w,0),5),-5) END"


@query("k01_factor_registry", sql(f"SELECT d, symbol, {r(z('(f_qty/f_tax)'))} AS qty_per_tax FROM (SELECT d, symbol, f_qty, nullif(f_tax,0) AS f_tax FROM fx) WINDOW w AS (PARTITION BY d)", "fx"))
def factor_registry(p):
    items = {**fx_ops.BUILT_IN, "per": lambda a, b: fx_ops.Factor("per", lambda df: F.try_divide(F.col(a), F.col(b)), (a, b))}
    spec = {"name": "per", "output": "qty_per_tax", "parameters": {"a": "f_qty", "b": "f_tax"}}
    return fx_ops.run_factors(p.fx(), [spec], items).values


@query("k02_column_factor", sql("SELECT d, symbol, CAST(CASE WHEN f_disc IS NULL THEN NULL WHEN CAST(f_qty AS BIGINT) % 3 = 0 THEN NULL ELSE CAST(f_qty AS BIGINT) END AS DOUBLE) AS value FROM fx", "fx"))
def column_factor(p):
    qty = F.col("f_qty").cast("bigint")
    text = F.when(F.col("f_disc").isNotNull(), F.when(qty % 3 == 0, "n/a").otherwise(qty.cast("string")))
    rows = p.fx().withColumn("text", text)
    return rows.select("d", "symbol", fx_ops.column_factor("text").compute(rows).alias("value"))


@query("k03_factor_pipeline", sql(f"""SELECT 'disc' AS factor, count(z) AS valid, {r('1-count(z)/count(*)')} AS missing_rate, 'kept' AS status FROM (SELECT {z('f_disc')} AS z FROM fx WINDOW w AS (PARTITION BY d))
    UNION ALL SELECT 'ret', count(z), {r('1-count(z)/count(*)')}, 'kept' FROM (SELECT {z('f_ret')} AS z FROM fx WINDOW w AS (PARTITION BY d))
    UNION ALL SELECT 'absent', NULL, NULL, 'skipped' UNION ALL SELECT 'flat', NULL, NULL, 'skipped' UNION ALL SELECT 'unknown', NULL, NULL, 'skipped'""", "fx"))
def factor_pipeline(p):
    rows = p.fx().withColumn("one", F.lit(1.0))
    specs = [{"name": "column", "output": o, "parameters": {"column": col}}
             for o, col in (("disc", "f_disc"), ("ret", "f_ret"), ("absent", "f_none"), ("flat", "one"))]
    run = fx_ops.run_factors(rows, [*specs, {"name": "unknown"}])
    gone = p.spark.createDataFrame([(n, None, None, "skipped") for n in run.skipped], "factor string, valid bigint, missing_rate double, status string")
    return run.coverage.withColumn("status", F.lit("kept")).unionByName(gone)


@query("k04_score_transform", sql(f"""SELECT d, symbol, {r('score')} AS score, 'none' AS transform FROM sc UNION ALL
    SELECT d, symbol, {r('CASE WHEN member THEN c * CASE WHEN sc2 > 1e-12 THEN ss/sc2 ELSE 1 END ELSE score END')}, 'industry_neutral' FROM (
      SELECT *, stddev_pop(score) OVER (PARTITION BY d, member) AS ss, stddev_pop(c) OVER (PARTITION BY d, member) AS sc2 FROM (
        SELECT sc.*, m.member, score - avg(score) OVER (PARTITION BY sc.d, member, i.industry) AS c FROM sc JOIN pool m ON m.d = sc.d AND m.symbol = sc.symbol JOIN industry i ON i.symbol = sc.symbol))""",
                                  "fx", "pool", "industry", extra={"sc": "SELECT d, symbol, f_qty*f_tax*0.731058578630049::DOUBLE AS score FROM fx"}))
def score_transform(p):
    scores = p.fx().select("d", "symbol", (F.col("f_qty") * F.col("f_tax") * 0.731058578630049).alias("score"))
    same, _ = fx_ops.score_transform("none")(scores, p.pool())
    neutral, _ = fx_ops.score_transform("industry_neutral", p.industry())(scores, p.pool())
    return same.withColumn("transform", F.lit("none")).unionByName(neutral.withColumn("transform", F.lit("industry_neutral")))
