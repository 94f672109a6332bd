"""Section I, second part: components, style timing, residual models and the flows built from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from factorloom.operators import align, boosting, cross_section as xs, ic, pca, quality, rotation, style, timing, walkforward as wf
from factorloom.plans.aggregates import STD, STYLE_CTES, style_returns
from factorloom.plans.inputs import FACTORS, data, kept
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query
from factorloom.plans.windows import FEATURES, horizon_cte, SI
from factorloom.plans.windows import timing as style_features
from factorloom.session import materialise

LEAST = 2
EMBARGO = 20  # trading days before a validation span
FEWEST = 4  # realised dates before a quarter's models are fitted
# Most boosting rounds, and rounds without a better held-out loss before growing stops.
STOCK_ROUNDS, STOCK_PATIENCE = 24, 6
HORIZON_ROUNDS, HORIZON_PATIENCE = 16, 4
TIMER_ROUNDS = 8
STOCK = boosting.Params(depth=2, rate=0.1, subsample=0.75, colsample=0.70)
HORIZON = boosting.Params(depth=2, rate=0.1, subsample=0.75, colsample=0.70, bins=64)
TIMER = boosting.Params(depth=2, rate=0.1, bins=32)
# Fixed loadings for the queries that check projection alone (4 factors, 2 components).
LOADINGS = np.array([[0.8, -0.1], [0.3, 0.7], [-0.2, 0.6], [0.1, 0.4]])


def standardised(p):
    return materialise(xs.standardise(p.fx(), FACTORS))


def rolled(p, z=None):
    """(standardised panel, components per quarter, notes)."""
    z = standardised(p) if z is None else z
    found, notes = pca.rolling_components(pca.daily_moments(z, FACTORS), FACTORS, least=LEAST)
    return z, found, notes


def note_rows(p, notes):
    rows = [(n["quarter"], n["fit_start"], n["fit_end"], n["dates"], n["explained"], n["alignment"]) for n in notes]
    return p.spark.createDataFrame(rows, "quarter string, fit_start date, fit_end date, dates bigint, explained double, alignment double")


@query("i19_style_components")
def style_components(p):
    part = pca.fixed_components(pca.daily_moments(standardised(p), FACTORS), FACTORS, "1994-01-01", "1996-12-31", least=LEAST)
    return pca.loading_rows(p.spark, {0: part}, FACTORS).drop("quarter")


def _projected(j: int) -> str:
    return " + ".join(f"{f}*({float(LOADINGS[i, j])}::DOUBLE)" for i, f in enumerate(FACTORS))


@query("i20_projection", sql("SELECT d, symbol, " + ", ".join(
    r(f"CASE WHEN stddev_pop(s{j}) OVER (PARTITION BY d) > 1e-12 THEN (s{j}-avg(s{j}) OVER (PARTITION BY d))/stddev_pop(s{j}) OVER (PARTITION BY d) ELSE 0 END") + f" AS style_{j + 1}"
    for j in range(2)) + f" FROM (SELECT d, symbol, {_projected(0)} AS s0, {_projected(1)} AS s1 FROM zx)", "fx", extra=STD))
def projection(p):
    return pca.project(xs.standardise(p.fx(), FACTORS), pca.Components(LOADINGS, np.array([0.5, 0.3])), FACTORS)


@query("i21_rolling_components")
def rolling_components(p):
    return note_rows(p, rolled(p)[2])


@query("i22_component_alignment")
def component_alignment(p):
    rows = [(n["quarter"], s, src, sim) for n in rolled(p)[2] for s, src, sim in n["match"]]
    return p.spark.createDataFrame(rows, "quarter string, style string, source_component int, signed_similarity double")


# Components of two factors in closed form: the axes of a 2x2 matrix, and the one angle that varimax turns a pair of columns by.
TWO = ["f_disc", "f_qty"]
QUARTER_OF = "year({0})*4 + quarter({0}) - 1"


def closed_form(matrices: str) -> dict[str, str]:
    """Loadings of ``matrices`` (key, aa, ab, bb) as expressions: tu (key, columns 1 and 2 of factors a and b)."""
    flip = lambda c: f"CASE WHEN abs(a{c}) >= abs(b{c}) THEN sign(a{c}) ELSE sign(b{c}) END"
    return {
        "mx": matrices,
        "ei": "SELECT *, atan2(2*ab, aa-bb)/2 AS t, sqrt((aa+bb)/2 + sqrt(((aa-bb)/2)**2 + ab*ab)) AS r1, sqrt(greatest((aa+bb)/2 - sqrt(((aa-bb)/2)**2 + ab*ab), 0)) AS r2 FROM mx",
        "ld": "SELECT key, r1*cos(t) AS ax, -r2*sin(t) AS ay, r1*sin(t) AS bx, r2*cos(t) AS bw FROM ei",
        "sq": "SELECT *, ax*ax-ay*ay AS au, 2*ax*ay AS av, bx*bx-bw*bw AS bu, 2*bx*bw AS bv FROM ld",
        "an": """SELECT *, atan2(au*av + bu*bv - (au+bu)*(av+bv)/2, (au*au-av*av+bu*bu-bv*bv)/2 - (((au+bu)/2)**2 - ((av+bv)/2)**2))/4 AS g FROM sq""",
        "ro": "SELECT key, ax*cos(g)+ay*sin(g) AS a1, ay*cos(g)-ax*sin(g) AS a2, bx*cos(g)+bw*sin(g) AS b1, bw*cos(g)-bx*sin(g) AS b2 FROM an",
        "tu": f"SELECT key, a1*{flip(1)} AS a1, b1*{flip(1)} AS b1, a2*{flip(2)} AS a2, b2*{flip(2)} AS b2 FROM ro",
    }


DAILY = {**STD, "dm": "SELECT d, avg(f_disc*f_disc) AS aa, avg(f_disc*f_qty) AS ab, avg(f_qty*f_qty) AS bb FROM zx GROUP BY d HAVING count(*) > 2"}
ROLLED = {
    **DAILY, "dq": f"SELECT *, {QUARTER_OF.format('d')} AS q FROM dm",
    "tg": """SELECT t.q AS key, min(x.d) AS fit_start, max(x.d) AS fit_end, count(*) AS dates, avg(aa) AS aa, avg(ab) AS ab, avg(bb) AS bb
        FROM (SELECT DISTINCT q FROM dq) t JOIN dq x ON x.q BETWEEN t.q - 2 AND t.q - 1 GROUP BY t.q HAVING count(DISTINCT x.q) = 2""",
    **closed_form("SELECT key, aa, ab, bb FROM tg"),
    "un": """SELECT row_number() OVER (ORDER BY key) AS k, key, a1, b1, a2, b2, sqrt(a1*a1+b1*b1) AS n1, sqrt(a2*a2+b2*b2) AS n2 FROM tu""",
    # one quarter after another: keep or swap the columns, then turn each to the side of the earlier one
    "al": """SELECT k, key, a1, b1, a2, b2, n1, n2, 1 AS s1, 2 AS s2, NULL::DOUBLE AS c1, NULL::DOUBLE AS c2 FROM un WHERE k = 1
        UNION ALL SELECT k, key, a1*sign(c1), b1*sign(c1), a2*sign(c2), b2*sign(c2), n1, n2, s1, s2, abs(c1), abs(c2) FROM (
          SELECT k, key, CASE WHEN keep THEN x1 ELSE x2 END AS a1, CASE WHEN keep THEN y1 ELSE y2 END AS b1, CASE WHEN keep THEN x2 ELSE x1 END AS a2,
            CASE WHEN keep THEN y2 ELSE y1 END AS b2, CASE WHEN keep THEN m1 ELSE m2 END AS n1, CASE WHEN keep THEN m2 ELSE m1 END AS n2,
            CASE WHEN keep THEN 1 ELSE 2 END AS s1, CASE WHEN keep THEN 2 ELSE 1 END AS s2,
            CASE WHEN keep THEN p11 ELSE p12 END AS c1, CASE WHEN keep THEN p22 ELSE p21 END AS c2 FROM (
            SELECT *, abs(p11) + abs(p22) >= abs(p12) + abs(p21) AS keep FROM (
              SELECT u.k, u.key, u.a1 AS x1, u.b1 AS y1, u.a2 AS x2, u.b2 AS y2, u.n1 AS m1, u.n2 AS m2,
                (al.a1*u.a1 + al.b1*u.b1)/(al.n1*u.n1) AS p11, (al.a1*u.a2 + al.b1*u.b2)/(al.n1*u.n2) AS p12,
                (al.a2*u.a1 + al.b2*u.b1)/(al.n2*u.n1) AS p21, (al.a2*u.a2 + al.b2*u.b2)/(al.n2*u.n2) AS p22
              FROM al JOIN un u ON u.k = al.k + 1)))""",
    "qu": "SELECT *, CAST(key // 4 AS VARCHAR) || 'Q' || CAST(key % 4 + 1 AS VARCHAR) AS quarter FROM al",
}


def rolling_sql(body: str) -> str:
    return "WITH RECURSIVE" + sql(body, "fx", extra=ROLLED).removeprefix("WITH")


def rolled_pair(p):
    z = materialise(xs.standardise(p.fx(), TWO))
    return z, *pca.rolling_components(pca.daily_moments(z, TWO), TWO, least=LEAST)


@query("i19_style_components_pair", sql(f"""SELECT 'f_disc' AS factor, 'style_1' AS style, {r('a1')} AS loading FROM tu UNION ALL SELECT 'f_disc', 'style_2', {r('a2')} FROM tu
    UNION ALL SELECT 'f_qty', 'style_1', {r('b1')} FROM tu UNION ALL SELECT 'f_qty', 'style_2', {r('b2')} FROM tu""", "fx", extra={**DAILY, **closed_form(
    "SELECT 1 AS key, avg(aa) AS aa, avg(ab) AS ab, avg(bb) AS bb FROM dm WHERE d BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'")}))
def style_components_pair(p):
    part = pca.fixed_components(pca.daily_moments(xs.standardise(p.fx(), TWO), TWO), TWO, "1994-01-01", "1996-12-31", least=LEAST)
    return pca.loading_rows(p.spark, {0: part}, TWO).drop("quarter")


@query("i21_rolling_components_pair", rolling_sql(f"""SELECT quarter, fit_start, fit_end, dates, 1.0::DOUBLE AS explained, {r('coalesce((c1+c2)/2, 1)')} AS alignment
    FROM qu JOIN tg ON tg.key = qu.key"""))
def rolling_components_pair(p):
    return note_rows(p, rolled_pair(p)[2])


@query("i22_component_alignment_pair", rolling_sql(f"""SELECT quarter, 'style_1' AS style, s1 AS source_component, {r('c1')} AS signed_similarity FROM qu WHERE c1 IS NOT NULL
    UNION ALL SELECT quarter, 'style_2', s2, {r('c2')} FROM qu WHERE c2 IS NOT NULL"""))
def component_alignment_pair(p):
    rows = [(n["quarter"], s, src, sim) for n in rolled_pair(p)[2] for s, src, sim in n["match"]]
    return p.spark.createDataFrame(rows, "quarter string, style string, source_component int, signed_similarity double")


def _centred(c: str) -> str:
    over = "OVER (PARTITION BY d)"
    return r(f"CASE WHEN stddev_pop({c}) {over} > 1e-12 THEN ({c}-avg({c}) {over})/stddev_pop({c}) {over} ELSE 0 END")


@query("i23_rolling_exposure_pair", rolling_sql(f"""SELECT d, symbol, {_centred('x1')} AS style_1, {_centred('x2')} AS style_2 FROM (
    SELECT d, symbol, f_disc*a1 + f_qty*b1 AS x1, f_disc*a2 + f_qty*b2 AS x2 FROM zx JOIN qu ON qu.key = {QUARTER_OF.format('d')})"""))
def rolling_exposure_pair(p):
    z, found, _ = rolled_pair(p)
    return pca.rolling_exposure(z, found, TWO)


def exposures(p):
    z, found, notes = rolled(p)
    return z, found, notes, materialise(pca.rolling_exposure(z, found, FACTORS))


@query("i23_rolling_exposure")
def rolling_exposure(p):
    z, found, _ = rolled(p)
    return pca.rolling_exposure(z, found, FACTORS)


RESIDUAL = """SELECT d, symbol, label - my - b1*(a-ma) - b2*(b-mb) AS residual_label, a, b FROM (SELECT *, (sbb*say-sab*sby)/(saa*sbb-sab*sab) AS b1, (saa*sby-sab*say)/(saa*sbb-sab*sab) AS b2 FROM (
    SELECT *, avg(label) OVER w AS my, avg(a) OVER w AS ma, avg(b) OVER w AS mb, covar_pop(a,a) OVER w AS saa, covar_pop(a,b) OVER w AS sab, covar_pop(b,b) OVER w AS sbb,
      covar_pop(a,label) OVER w AS say, covar_pop(b,label) OVER w AS sby, count(*) OVER w AS n
    FROM (SELECT z.d, z.symbol, z.f_qty AS a, z.f_tax AS b, l.label FROM zx z JOIN lab l ON l.d = z.d AND l.symbol = z.symbol WHERE l.label IS NOT NULL) WINDOW w AS (PARTITION BY d)) WHERE n > 3)"""


def residual_rows(p):
    rows = xs.standardise(p.fx(), FACTORS).join(align.labels(p.px(), p.fx(), p.sessions()), ["d", "symbol"], "left")
    return pca.residual_target(materialise(rows), ["f_qty", "f_tax"])


@query("i24_residual_target", sql(f"SELECT d, symbol, {r('residual_label')} AS residual_label FROM rs", "lab", "fx", extra={**STD, "rs": RESIDUAL}))
def residual_target(p):
    return residual_rows(p)[0].select("d", "symbol", "residual_label")


@query("i24_residual_audit", sql(f"SELECT d, count(*) AS stock_count, {r('stddev_pop(residual_label)')} AS residual_std, 0.0::DOUBLE AS max_abs_style_correlation FROM rs GROUP BY d",
                                 "lab", "fx", extra={**STD, "rs": RESIDUAL}))
def residual_audit(p):
    return residual_rows(p)[1]


AGE = "exp(-ln(2)*(datediff('day', d, DATE '1998-01-01')/365.25*252)/252)"


@query("i25_residual_ridge", sql(f"""SELECT 'f_qty' AS factor, {r('g/2')} AS coefficient, n AS rows FROM q UNION ALL SELECT 'f_tax', {r('-g/2')}, n FROM q
    UNION ALL SELECT 'intercept', {r('my - g*mz')}, n FROM q""", "lab", "fx", extra={**STD, "w": f"""SELECT (z.f_qty-z.f_tax)/2 AS z, l.label AS y, {AGE.replace('d,', 'z.d,', 1)} AS w
    FROM zx z JOIN lab l ON l.d = z.d AND l.symbol = z.symbol WHERE l.label IS NOT NULL AND l.label_exit_date < DATE '1998-01-01'""",
    "m": "SELECT sum(w*z)/sum(w) AS mz, sum(w*y)/sum(w) AS my, sum(w) AS sw, count(*) AS n FROM w",
    "q": "SELECT mz, my, n, (SELECT sum(w*(z-mz)*(y-my))/sw FROM w)/((SELECT sum(w*(z-mz)*(z-mz))/sw FROM w) + 0.05::DOUBLE/2) AS g FROM m"}))
def residual_ridge(p):
    rows = xs.standardise(p.fx(), FACTORS).join(align.labels(p.px(), p.fx(), p.sessions()), ["d", "symbol"])
    train = wf.age_weighted(rows.where(F.col("label_exit_date") < F.lit("1998-01-01").cast("date")), "1998-01-01")
    fit = pca.residual_ridge(train, np.ones((2, 1)), ["f_qty", "f_tax"], 0.05, "label", "sample_weight")
    table = [("f_qty", float(fit.coefficients[0]), fit.rows), ("f_tax", float(fit.coefficients[1]), fit.rows), ("intercept", fit.intercept, fit.rows)]
    return p.spark.createDataFrame(table, "factor string, coefficient double, rows bigint")


def pools(p):
    """Names and members; no members means every name."""
    return {"all": None, "core": p.pool()}


def residual_models(p, z, found, weight: float = 1.0):
    """(pooled panel, one fit per pool and quarter with its effective weight): the weight stands only where the rank IC on
    the purged validation span is positive."""
    labels = align.labels(p.px(), p.fx(), p.sessions()).select("d", "symbol", "label", "label_exit_date")
    labelled = z.join(labels, ["d", "symbol"], "left")
    rows = materialise(quality.union_all([align.in_pool(labelled, pool).withColumn("pool", F.lit(name)) for name, pool in pools(p).items()]))
    sums = kept(rotation.date_sums(rows, FACTORS))
    known = {name: [(r["d"], r["x"]) for r in sums.where(F.col("pool") == name).groupBy("d").agg(F.max("label_exit_date").alias("x"))
                    .orderBy("d").collect()] for name in pools(p)}
    spans = rotation.quarters_of([r["d"] for r in z.select("d").distinct().collect()])
    named = {pca.quarter_label(q): part for q, part in found.items()}
    specs, held = rotation.residual_specs(p.spark, {name: spans for name in known}, known, named, EMBARGO)
    fits = kept(rotation.residual_fits(sums, specs))
    checked = rotation.residual_validation(rows, sums, fits, held, FACTORS, p.slices())
    whole = fits.where("part = 'all'").drop("part").join(checked, ["pool", "quarter"], "left")
    return rows, kept(whole.withColumn("weight", F.when(F.col("rank_ic") > 0, F.lit(weight)).otherwise(F.lit(0.0))))


@query("i26_validated_residual_weight")
def validated_residual_weight(p):
    z, found, _ = rolled(p)
    return residual_models(p, z, found)[1].drop("weights", "intercept")


def timing_rows(p, components=None, members=None):
    """(styles, exposures, style returns, timing table) under rolling components, of one pool's names."""
    z, found, notes, exposure = exposures(p) if components is None else components
    styles = next(iter(found.values())).names
    exposure = align.in_pool(exposure, members)
    labels = align.labels(p.px(), p.fx(), p.sessions())
    keep = ["d", "symbol", "label", "label_entry_date", "label_exit_date"]
    long = exposure.join(labels, ["d", "symbol"]).select(*keep, *styles).unpivot(keep, styles, "style", "x")
    returns = kept(style.style_returns(long, p.slices()))
    table = kept(timing.timing_table(returns, exposure.select("d"), p.benchmark(), styles))
    return styles, exposure, returns, table


def contexts(p, components=None):
    """(styles, exposures by pool, timing tables by pool, quarters by pool)."""
    components = exposures(p) if components is None else components
    parts = {name: timing_rows(p, components, members) for name, members in pools(p).items()}
    tables = {name: part[3] for name, part in parts.items()}
    dates = rotation.decision_dates(tables, [])
    return (next(iter(parts.values()))[0], {name: part[1] for name, part in parts.items()}, tables,
            {name: rotation.quarters_of([r[0] for r in ds]) for name, ds in dates.items()})


def trained_quarters(p, tables, spans):
    """(pool, quarter, first, last) of quarters with ``FEWEST`` realised dates before them."""
    rows = []
    for name, ds in rotation.decision_dates(tables, ["label_exit_date"]).items():
        rows += [(name, q.name, q.first, q.last) for q in spans[name] if sum(x is not None and x < q.first for _, x in ds) >= FEWEST]
    return rows, p.spark.createDataFrame(rows, "pool string, quarter string, first date, last date")


@query("i27_style_timers")
def style_timers(p):
    """Style weights of five timers on every date of every quarter with enough history, in both pools."""
    styles, _, tables, spans = contexts(p)
    rows, quarters = trained_quarters(p, tables, spans)
    names = {(pool, q) for pool, q, *_ in rows}
    spans = {pool: [q for q in qs if (pool, q.name) in names] for pool, qs in spans.items()}
    rules = []
    for pool, table in tables.items():
        test = quality.union_all([table.select("d", *[f"{s}_momentum_20" for s in styles])])
        for name, w in (("equal_weight", timing.equal_weights(test, styles)),
                        ("momentum_rule", timing.softmax_weights(test, {s: f"{s}_momentum_20" for s in styles}))):
            rules.append(w.withColumns({"pool": F.lit(pool), "quarter": rotation.quarter_name(F.col("d")), "model": F.lit(name)}))
    rules = quality.union_all(rules).join(F.broadcast(quarters.select("pool", "quarter")), ["pool", "quarter"])
    logistic = rotation.logistic_weights(tables, styles, quarters).withColumn("model", F.lit("multinomial_logistic"))
    wins, returns = rotation.tree_timers(tables, styles, spans, TIMER, TIMER_ROUNDS)
    keys = ["pool", "quarter", "d"]
    share = F.greatest(F.col("x"), F.lit(1e-6))  # shares of classes are positive
    total = wins.groupBy(*keys).agg(F.sum(share).alias("total"))
    classes = wins.join(total, keys).select(*keys, "style", (share / F.col("total")).alias("w"), F.lit("boosted_classifier").alias("model"))
    wide = returns.groupBy(*keys).agg(*[F.max(F.when(F.col("style") == s, F.col("x"))).alias(f"{s}_forecast") for s in styles])
    boosted = timing.softmax_weights(wide.where(F.col("pool") == "all"), {s: f"{s}_forecast" for s in styles}).withColumn("pool", F.lit("all"))
    for pool in list(tables)[1:]:
        boosted = boosted.unionByName(timing.softmax_weights(wide.where(F.col("pool") == pool), {s: f"{s}_forecast" for s in styles})
                                      .withColumn("pool", F.lit(pool)))
    boosted = boosted.withColumns({"quarter": rotation.quarter_name(F.col("d")), "model": F.lit("boosted_regressors")})
    return quality.union_all([rules.select("pool", "quarter", "d", "style", "w", "model"), logistic.select("pool", "quarter", "d", "style", "w", "model"),
                              classes.select("pool", "quarter", "d", "style", "w", "model"), boosted.select("pool", "quarter", "d", "style", "w", "model")])


@query("i28_dual_horizon")
def dual_horizon(p):
    """Both horizons' forecasts for every quarter with enough history, in both pools, with the tree counts kept."""
    styles, _, tables, _ = contexts(p)
    forecasts, _, notes = rotation.dual_horizon(tables, styles, HORIZON, HORIZON_ROUNDS, HORIZON_PATIENCE)
    trees = notes.groupBy("pool", "quarter").agg(*[F.max(F.when(F.col("horizon") == h, F.col("trees"))).alias(f"trees_{h}") for h in timing.HORIZONS])
    return forecasts.join(trees, ["pool", "quarter"])


@query("i28_horizon_choices")
def horizon_choices(p):
    styles, _, tables, _ = contexts(p)
    return rotation.dual_horizon(tables, styles, HORIZON, HORIZON_ROUNDS, HORIZON_PATIENCE)[2]


def stock_models(p):
    """(components, exposures with labels, one forest per quarter, notes per quarter).

    One model on all names serves every pool. Its tree count and validation IC are chosen on the first quarter with enough
    history and kept; quarters before it take all rounds and no validation.
    """
    z, found, notes, exposure = exposures(p)
    styles = next(iter(found.values())).names
    rows = materialise(exposure.join(align.labels(p.px(), p.fx(), p.sessions()), ["d", "symbol"], "left"))
    known = [(r["d"], r["x"]) for r in rows.where("label IS NOT NULL").groupBy("d").agg(F.max("label_exit_date").alias("x")).orderBy("d").collect()]
    quarters = rotation.quarters_of([r["d"] for r in rows.select("d").distinct().collect()])
    pick = rotation.selection(quarters, known, 0, FEWEST)
    trees, value, first = STOCK_ROUNDS, None, None
    if pick:
        first, end, start = pick
        cutoff = rotation.day_number(first.first)
        trial = boosting.Model("trial", 0, rotation.day_number(end), rotation.day_number(start), 0, cutoff, (rotation.day_number(start), cutoff, cutoff), STOCK)
        booster = boosting.Booster(rows, styles, [trial])
        forest = booster.advance(STOCK_ROUNDS, patience=STOCK_PATIENCE)[0]
        booster.close()
        trees = forest.best_rounds()
        span = (F.col("d") >= F.lit(start)) & (F.col("label_exit_date") < F.lit(first.first)) & F.col("label").isNotNull()
        held = boosting.predict(rows.where(span).withColumn("name", F.lit("trial")), [boosting.truncated(forest, trees)], styles)
        value = ic.daily_ic(held, ("d",), slices=p.slices()).agg(F.avg("rank_ic")).first()[0]
    models, table = [], []
    for q in quarters:
        seen = sum(x < q.first for _, x in known)
        kept_choice = first is not None and q.first >= first.first
        if not seen:
            table.append((q.name, seen, None, None, "no label is realised before the quarter"))
            continue
        cutoff = rotation.day_number(q.first)
        models.append(boosting.Model(q.name, 0, cutoff, cutoff, 0, cutoff, None, STOCK))
        reason = "chosen here" if kept_choice and q.name == first.name else f"kept from {first.name}" if kept_choice else "too few realised dates for a purged validation"
        table.append((q.name, seen, trees if kept_choice else STOCK_ROUNDS, value if kept_choice else None, reason))
    count = {name: n for name, _, n, _, _ in table}
    forests = rotation.grown(boosting.Booster(rows, styles, models), models, lambda m: count[m.name])
    choices = p.spark.createDataFrame(table, "quarter string, realised_dates int, trees int, validation_ic double, reason string")
    return styles, notes, rows, forests, choices


@query("i29_stock_boosting")
def stock_boosting(p):
    """Boosted trees on exposures for every quarter, read off for two pools, then the confidence gate on realised and
    validated rank IC and the components' quality."""
    styles, notes, rows, forests, choices = stock_models(p)
    named = rows.withColumn("name", rotation.quarter_name(F.col("d")))
    scored = materialise(boosting.predict(named, forests, styles).select("d", "symbol", "label", "label_exit_date", "prediction"))
    predictions = materialise(quality.union_all([align.in_pool(scored, members).withColumn("pool", F.lit(name)) for name, members in pools(p).items()]))
    exits = predictions.groupBy("pool", "d").agg(F.max("label_exit_date").alias("label_exit_date"))
    daily = ic.daily_ic(predictions, ("pool", "d"), slices=p.slices()).join(exits, ["pool", "d"])
    measured = note_rows(p, notes).join(choices.select("quarter", "validation_ic"), "quarter")
    structure = measured.select(F.explode(F.array(*[F.lit(name) for name in pools(p)])).alias("pool"), "quarter", "explained", "alignment", "validation_ic")
    gated, _ = style.confidence_gate(predictions, daily, structure, 2)
    return gated.select("pool", "d", "symbol", "label", "prediction", "trade_prediction", "mode", "retain", "trade_enabled")


@query("i29_stock_choices")
def stock_choices(p):
    return stock_models(p)[4]


@query("i30_quarter_context")
def quarter_context(p):
    """The training and test rows of every pool and quarter: a row is training where its label is realised before the
    quarter's first decision date."""
    styles, _, tables, spans = contexts(p)
    out = []
    for pool, table in tables.items():
        quarters = rotation.quarter_table(p.spark, spans[pool])
        with_ic = table
        for h in timing.HORIZONS:
            with_ic = with_ic.join(timing.momentum_ic(table, styles, h).withColumnRenamed("rank_ic", f"momentum_ic_{h}"), "d", "left")
        with_ic = kept(with_ic)
        train = align.in_training(with_ic, quarters.select("name", "train_cutoff"), "0001-01-01", strict=True).withColumn("role", F.lit("train"))
        test = align.prediction_rows(with_ic, quarters).drop("prediction_start", "prediction_end").withColumn("role", F.lit("test"))
        out.append(train.unionByName(test).withColumn("pool", F.lit(pool)))
    return quality.union_all(out).withColumnsRenamed({"name": "quarter", "train_cutoff": "cutoff"})


# quarters with components: those whose two predecessors both have a date with more names than factors
CONTEXT_DATES = f"""SELECT pool, d, q FROM (SELECT x.d, x.symbol, x.q, 'all' AS pool FROM dated x UNION ALL
    SELECT x.d, x.symbol, x.q, 'core' FROM dated x JOIN (SELECT d, avg(f_qty) AS level FROM fx GROUP BY d) l ON l.d = x.d WHERE x.f_qty >= l.level)
    WHERE q IN (SELECT a.q FROM (SELECT DISTINCT q FROM dated) a JOIN full_q b ON b.q = a.q - 1 JOIN full_q c ON c.q = a.q - 2) GROUP BY pool, d, q"""


@query("i30_context_counts", sql("""SELECT a.pool, CAST(a.q // 4 AS VARCHAR) || 'Q' || (a.q % 4 + 1) AS quarter, a.cutoff, a.test_rows, a.last_date,
    true AS information_available FROM (SELECT pool, q, min(d) AS cutoff, max(d) AS last_date, count(*) AS test_rows FROM cd GROUP BY pool, q) a""", "fx", extra={
    "dated": "SELECT *, year(d)*4 + quarter(d) - 1 AS q FROM fx", "full_q": f"SELECT DISTINCT q FROM (SELECT q, d, count(*) AS n FROM dated GROUP BY q, d) WHERE n > {len(FACTORS)}",
    "cd": CONTEXT_DATES}))
def context_counts(p):
    rows = quarter_context(p)
    test = F.col("role") == "test"
    return rows.groupBy("pool", "quarter", "cutoff").agg(F.count(F.when(test, 1)).alias("test_rows"), F.max(F.when(test, F.col("d"))).alias("last_date"),
                                                         F.bool_and("information_available").alias("information_available"))


@query("i31_final_score", sql(f"""SELECT d, symbol, {r('a + 0.5*CASE WHEN sb > 1e-12 THEN (b-mb)/sb ELSE 0 END')} AS prediction, a IS NULL AS not_candidate FROM (
    SELECT d, symbol, CASE WHEN f_disc IS NOT NULL THEN f_qty/100 END AS a, f_tax AS b, avg(f_tax) OVER (PARTITION BY d) AS mb, stddev_pop(f_tax) OVER (PARTITION BY d) AS sb FROM fx)""", "fx"))
def final_score(p):
    rows = p.fx().select("d", "symbol", F.when(F.col("f_disc").isNotNull(), F.col("f_qty") / 100).alias("style_timing_score"),
                         F.col("f_tax").alias("residual_prediction_score"))
    z = xs.zscore(rows, ["residual_prediction_score"], limit=None, zero_spread="center")
    return z.select("d", "symbol", pca.combined_score("style_timing_score", "residual_prediction_score", 0.5).alias("prediction"),
                    F.col("style_timing_score").isNull().alias("not_candidate"))


def horizon_mix(p, table, forecasts, styles, priors):
    """(d, weight_5, weight_20, risk_off) of one pool: reliability of the forecasts realised so far, and the market's state."""
    targets = table.select("d", *[F.struct(F.lit(s).alias("style"), *[F.col(f"target_{s}_{h}").alias(f"y_{h}") for h in timing.HORIZONS]).alias(s) for s in styles])
    realised = targets.select("d", F.explode(F.array(*styles)).alias("leg")).select("d", "leg.*")
    both, dates = forecasts.join(realised, ["d", "style"]), forecasts.select("d").distinct()
    legs = []
    for h in timing.HORIZONS:
        daily = style.cross_style_ic(both, f"forecast_{h}", f"y_{h}").select("d", "rank_ic").join(
            table.select("d", F.col(f"label_exit_date_{h}").alias("label_exit_date")), "d")
        legs.append(style.rolling_reliability(daily, dates, 60).select("d", F.col("rolling_icir").alias(f"icir_{h}"), F.col("observations").alias(f"n_{h}")))
    return style.horizon_weights(legs[0].join(legs[1], "d").join(style.market_state(p.benchmark()), "d", "left"), *priors)


@query("i31_style_rotation")
def style_rotation(p):
    """The full flow for every quarter with enough history and both pools: forecasts, horizon weights, votes, residual score,
    final score."""
    z, found, notes, exposure = components = exposures(p)
    styles, exposed, tables, _ = contexts(p, components)
    forecasts, choices, _ = rotation.dual_horizon(tables, styles, HORIZON, HORIZON_ROUNDS, HORIZON_PATIENCE)
    forecasts = kept(forecasts)
    rows, fits = residual_models(p, z, found)
    residual = F.col("intercept")
    for i, f in enumerate(FACTORS):
        residual = residual + F.coalesce(F.col(f), F.lit(0.0)) * F.get("weights", F.lit(i))
    placed = rows.withColumn("quarter", rotation.quarter_name(F.col("d"))).join(fits.select("pool", "quarter", "weights", "intercept", "weight"), ["pool", "quarter"])
    residuals = placed.select("pool", "quarter", "d", "symbol", residual.alias("residual_prediction_score"), F.col("weight").alias("residual_weight"))
    out = []
    for pool, table in tables.items():
        own = forecasts.where(F.col("pool") == pool).drop("pool")
        priors = [(choices[pool, h].value or 0.0) if (pool, h) in choices else 0.0 for h in timing.HORIZONS]
        weights = kept(horizon_mix(p, table, own, styles, priors))
        mixed = own.join(weights, "d").select(
            "d", "style", (F.col("weight_5") * F.col("forecast_5") + F.col("weight_20") * F.col("forecast_20")).alias("w"))
        long = exposed[pool].unpivot(["d", "symbol"], styles, "style", "x").join(F.broadcast(mixed), ["d", "style"]).select(
            "d", "symbol", "style", (F.col("x") * F.col("w")).alias("x"))
        scores = xs.consensus(materialise(long), slices=p.slices()).withColumnRenamed("prediction", "style_timing_score")
        score = xs.zscore(residuals.where(F.col("pool") == pool).drop("pool"), ["residual_prediction_score"], limit=None, zero_spread="center")
        out.append(scores.join(score, ["d", "symbol"], "left").join(F.broadcast(weights.select("d", "risk_off")), "d").withColumn("pool", F.lit(pool)))
    whole = quality.union_all(out)
    blend = F.col("style_timing_score") + F.col("residual_weight") * F.col("residual_prediction_score")
    # a quarter without a residual model has the style score alone
    return whole.withColumn("prediction", F.when(F.col("residual_weight").isNull(), F.col("style_timing_score")).otherwise(blend))


@query("i32_retain_flags", sql("""SELECT d, symbol, coalesce(CASE WHEN f_disc IS NULL THEN NULL ELSE CAST(f_qty AS BIGINT) % 4 END, 0) < 2 AS retain FROM fx""", "fx"))
def retain_flags(p):
    votes = p.fx().select("d", "symbol", F.when(F.col("f_disc").isNotNull(), F.col("f_qty").cast("bigint") % 4).alias("sell_votes"))
    return style.retain_flags(votes).select("d", "symbol", "retain")


@query("i33_component_tables")
def component_tables(p):
    _, found, _ = rolled(p)
    return pca.loading_rows(p.spark, found, FACTORS)


@query("i33_component_tables_pair", rolling_sql(" UNION ALL ".join(
    f"SELECT quarter, '{f}' AS factor, 'style_{j}' AS style, {r(c + str(j))} AS loading FROM qu" for f, c in zip(TWO, "ab") for j in (1, 2))))
def component_tables_pair(p):
    return pca.loading_rows(p.spark, rolled_pair(p)[1], TWO)


@query("i34_information_audit", sql(f"""SELECT x.d, x.max_information_date, x.max_information_date IS NULL OR x.max_information_date <= x.d AS information_available, {r('m.rank_ic')} AS momentum_ic FROM (
    SELECT d, max(max_information_date) AS max_information_date FROM ft GROUP BY d) x LEFT JOIN (
    SELECT d, CASE WHEN count(*) >= 3 AND stddev_samp(x) > 1e-12 AND stddev_samp(y) > 1e-12 THEN corr(ra, rb) END AS rank_ic FROM (SELECT d, x, y,
      rank() OVER (PARTITION BY d ORDER BY x) + (count(*) OVER (PARTITION BY d, x)-1)/2.0 AS ra, rank() OVER (PARTITION BY d ORDER BY y) + (count(*) OVER (PARTITION BY d, y)-1)/2.0 AS rb
      FROM (SELECT f.d, f.style, round(f.momentum_5, 10) AS x, round(h.target, 10) AS y FROM ft f JOIN hl h ON h.d = f.d AND h.style = f.style WHERE f.momentum_5 IS NOT NULL)) GROUP BY d) m ON m.d = x.d""",
                                    "data", extra={**STYLE_CTES, "ft": FEATURES, "si": SI, "hl": horizon_cte(5)}))
def information_audit(p):
    known = style_features(p)
    dates = known.groupBy("d").agg(F.max("max_information_date").alias("max_information_date"))
    target = style.horizon_labels(style_returns(p), 5, FACTORS).select("d", "style", F.round("target", 10).alias("y"))
    momentum = known.select("d", "style", F.round("momentum_5", 10).alias("x")).where("x IS NOT NULL")
    daily = style.cross_style_ic(momentum.join(target, ["d", "style"]), "x", "y").select("d", F.col("rank_ic").alias("momentum_ic"))
    out = dates.withColumn("information_available", F.coalesce(F.col("max_information_date") <= F.col("d"), F.lit(True)))
    return out.join(daily, "d", "left")
