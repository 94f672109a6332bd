"""Section I, first part: splits, leakage checks, linear and tree models."""

from __future__ import annotations

import datetime
from dataclasses import astuple, replace

from pyspark.sql import functions as F

from factorloom.functions import columns as c
from factorloom.operators import align, boosting, calendar, ic, quality, ranking, rotation, walkforward as wf
from factorloom.plans.inputs import FACTORS, data, kept
from factorloom.plans.joins import SPLITS, splits
from factorloom.plans.oracle import r, sql
from factorloom.plans.registry import query
from factorloom.session import materialise

START = "1993-01-01"
EPOCH = datetime.date(1970, 1, 1)
PAIR = ["f_disc", "f_qty"]


@query("i01_quarter_splits", sql("SELECT name, train_cutoff, prediction_start, prediction_end FROM sp", "fx", extra={"sp": SPLITS}))
def quarter_splits(p):
    return splits(p)


def _periods(frequency: str, key: str, name: str) -> str:
    return f"""SELECT '{frequency}' AS frequency, {name} AS name, prior AS train_cutoff, a AS prediction_start, b AS prediction_end FROM (
        SELECT min(d) AS a, max(d) AS b, arg_min(prior, d) AS prior FROM (SELECT *, {key} AS key FROM (SELECT *, row_number() OVER (ORDER BY d)-1 AS i FROM (
          SELECT d, lag(d) OVER (ORDER BY d) AS prior FROM (SELECT DISTINCT d FROM px_day)) WHERE d BETWEEN DATE '1996-02-01' AND DATE '1996-07-31')) GROUP BY key)"""


@query("i02_refit_periods", sql(" UNION ALL ".join((
    _periods("daily", "d", "strftime(a, '%Y-%m-%d')"), _periods("alternate", "i // 2", "strftime(a, '%Y-%m-%d')"),
    _periods("weekly", "date_trunc('week', d)", "strftime(a, '%Y-%m-%d')"), _periods("monthly", "date_trunc('month', d)", "strftime(a, '%Y-%m')"),
    _periods("quarterly", "date_trunc('quarter', d)", "CAST(year(a) AS VARCHAR) || 'Q' || quarter(a)"))), "px_day"))
def refit_periods(p):
    cal = calendar.sessions(p.px_day())
    return quality.union_all([calendar.refit_periods(cal, f, "1996-02-01", "1996-07-31").withColumn("frequency", F.lit(f))
                              for f in ("daily", "alternate", "weekly", "monthly", "quarterly")])


def _fold_sql(source: str) -> str:
    return f"""SELECT name, s AS validation_start, (SELECT count(*) FROM data x WHERE x.label IS NOT NULL AND x.label_exit_date < s) AS train_rows,
      (SELECT count(*) FROM data x WHERE x.label IS NOT NULL AND x.d BETWEEN s AND e) AS validation_rows FROM ({source})"""


FOLD_DATES = """SELECT CAST(year(d) AS VARCHAR) || 'Q' || quarter(d) AS name, min(d) AS s, max(d) AS e FROM data WHERE label IS NOT NULL AND d BETWEEN {} GROUP BY 1"""


def fold_counts(rows, table):
    counts = rows.where("label IS NOT NULL").groupBy("d", "label_exit_date").agg(F.count("*").alias("rows"))
    train = align.in_training(counts, table, "0001-01-01", strict=True).groupBy("name").agg(F.sum("rows").alias("train_rows"))
    valid = align.prediction_rows(rows.where("label IS NOT NULL"), table).groupBy("name", F.col("prediction_start").alias("validation_start")).agg(
        F.count("*").alias("validation_rows"))
    return valid.join(train, "name", "left").withColumn("train_rows", F.coalesce("train_rows", F.lit(0)))


@query("i03_validation_folds", sql(_fold_sql(FOLD_DATES.format("DATE '1997-01-01' AND DATE '1997-12-31'")), "data"))
def validation_folds(p):
    rows = materialise(data(p).select("d", "symbol", "label", "label_exit_date"))
    return fold_counts(rows, wf.folds(rows, "1997-01-01", "1997-12-31"))


@query("i04_trailing_folds", sql(_fold_sql(FOLD_DATES.format("DATE '1993-01-01' AND DATE '1997-11-30'") + " ORDER BY s DESC LIMIT 3"), "data"))
def trailing_folds(p):
    rows = materialise(data(p).select("d", "symbol", "label", "label_exit_date"))
    return fold_counts(rows, wf.folds(rows, START, "1997-11-30", last=3))


@query("i05_purged_split", sql("""SELECT CASE WHEN pos >= vs THEN 'validation' WHEN pos < vs - emb THEN CASE WHEN x.label_exit_date >= vd THEN 'purged' ELSE 'fit' END ELSE 'embargo' END AS part,
    count(*) AS n, min(x.d) AS first_d, max(x.d) AS last_d FROM data x JOIN (SELECT *, min(d) FILTER (WHERE pos >= vs) OVER () AS vd FROM (
      SELECT d, pos, emb, greatest(emb+1, least(n-1, CAST(floor(n*0.8::DOUBLE) AS BIGINT))) AS vs FROM (SELECT d, row_number() OVER (ORDER BY d)-1 AS pos, count(*) OVER () AS n, 1 AS emb
        FROM (SELECT DISTINCT d FROM data)))) t ON t.d = x.d GROUP BY 1""", "data"))
def purged_split(p):
    rows = data(p).select("d", "symbol", "label", "label_exit_date")
    return wf.purged_split(rows, 20).groupBy("part").agg(F.count("*").alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query("i06_leakage_checks", sql("""SELECT s.name, s.train_cutoff, t.max_train_label_exit, t.max_train_factor_date, t.train_rows, v.m AS min_prediction_date,
    t.max_train_label_exit <= s.train_cutoff AND t.max_train_factor_date < v.m AS passed FROM sp s
    JOIN (SELECT s.name, max(label_exit_date) AS max_train_label_exit, max(d) AS max_train_factor_date, count(*) AS train_rows FROM data x JOIN sp s
      ON x.d >= DATE '1993-01-01' AND x.label IS NOT NULL AND x.label_exit_date <= s.train_cutoff GROUP BY 1) t ON t.name = s.name
    JOIN (SELECT s.name, min(d) AS m FROM data x JOIN sp s ON x.d BETWEEN s.prediction_start AND s.prediction_end GROUP BY 1) v ON v.name = s.name""", "data", extra={"sp": SPLITS}))
def leakage_checks(p):
    rows = data(p)
    return wf.leakage_report(wf.moments(rows, PAIR), rows.select("d"), splits(p), START)


@query("i07_label_audit", sql("""SELECT 'checked' AS item, count(*) AS value FROM lab WHERE label IS NOT NULL UNION ALL SELECT 'wrong', 0 UNION ALL SELECT 'out_of_order', 0
    UNION ALL SELECT 'entered_early', 0 UNION ALL SELECT 'tail_labels', count(label) FROM lab WHERE d = (SELECT max(d) FROM lab)""", "lab"))
def label_audit(p):
    px = p.px()
    return wf.label_audit(materialise(align.labels(px, p.fx(), p.sessions())), px, calendar.sessions(px))


FIT = {
    "sp": SPLITS,
    "tr": "SELECT s.name, x.f_disc, x.f_qty, x.label, x.d, x.label_exit_date FROM data x JOIN sp s ON x.d >= DATE '1993-01-01' AND x.label IS NOT NULL AND x.label_exit_date <= s.train_cutoff",
    "sc": "SELECT name, avg(f_disc) AS ma, stddev_pop(f_disc) AS sa, avg(f_qty) AS mb, stddev_pop(f_qty) AS sb, avg(label) AS my, count(*) AS n FROM tr GROUP BY name",
    "zs": "SELECT t.name, coalesce((f_disc-ma)/sa,0) AS a, (f_qty-mb)/sb AS b, label AS y FROM tr t JOIN sc ON sc.name = t.name",
    "gm": "SELECT name, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*y) AS ay, sum(b*y) AS by_ FROM zs GROUP BY name",
    "fit": """SELECT g.name, v.model, v.alpha, sc.my AS intercept, ((bb+alpha)*ay - ab*by_)/((aa+alpha)*(bb+alpha)-ab*ab) AS wa, ((aa+alpha)*by_ - ab*ay)/((aa+alpha)*(bb+alpha)-ab*ab) AS wb,
        ma, sa, mb, sb FROM gm g JOIN sc ON sc.name = g.name, (VALUES ('linear_regression', 0.0::DOUBLE), ('ridge', 0.01::DOUBLE), ('ridge', 0.1::DOUBLE), ('ridge', 1.0::DOUBLE),
        ('ridge', 10.0::DOUBLE), ('ridge', 100.0::DOUBLE)) v(model, alpha)""",
    "pr": """SELECT f.name, f.model, f.alpha, x.d, x.symbol, x.label, round(intercept + coalesce((f_disc-ma)/sa,0)*wa + (f_qty-mb)/sb*wb, 12) AS prediction
        FROM data x JOIN sp s ON x.d BETWEEN s.prediction_start AND s.prediction_end JOIN fit f ON f.name = s.name""",
}


def fitted(p, candidates, features=tuple(PAIR)):
    """(labelled panel, splits, their sums, fits): panel, splits and sums are written once, and every split is fitted with
    the same candidates (model, alpha, l1_ratio)."""
    rows, sp = materialise(data(p)), kept(splits(p))
    sums = wf.split_sums(wf.moments(rows, features), sp, START)
    return rows, sp, sums, wf.fits(sums, features, lambda name: candidates)


OLS = [("linear_regression", 0.0, 0.0)]
ELASTIC = [("elasticnet", a, l1) for a in wf.ELASTIC_ALPHAS for l1 in wf.ELASTIC_L1_RATIOS]


@query("i08_split_scaler", sql(f"""SELECT s.name, x.d, x.symbol, {r('coalesce((f_disc-ma)/sa,0)')} AS f_disc, {r('(f_qty-mb)/sb')} AS f_qty FROM data x
    JOIN sp s ON x.d BETWEEN s.prediction_start AND s.prediction_end JOIN sc ON sc.name = s.name""", "data", extra={k: FIT[k] for k in ("sp", "tr", "sc")}))
def split_scaler(p):
    rows, sp, _, fits = fitted(p, OLS)
    return wf.scaled_rows(rows, sp, fits, PAIR)


def coefficient_rows(fits, features):
    weights = F.map_from_arrays(F.array(*[F.lit(f) for f in [*features, "intercept"]]), F.concat("weight", F.array("intercept")))
    return fits.select("name", "model", "alpha", "l1_ratio", F.explode(weights).alias("feature", "coefficient"))


def _coefficients(model: str) -> str:
    return sql(f"""SELECT name, alpha, feature, {r('v')} AS coefficient FROM (SELECT name, model, alpha, 'f_disc' AS feature, wa AS v FROM fit UNION ALL
        SELECT name, model, alpha, 'f_qty', wb FROM fit UNION ALL SELECT name, model, alpha, 'intercept', intercept FROM fit) WHERE model = '{model}'""", "data",
               extra={k: FIT[k] for k in ("sp", "tr", "sc", "zs", "gm", "fit")})


@query("i09_ols", _coefficients("linear_regression"))
def ols(p):
    fits = fitted(p, OLS)[3]
    return coefficient_rows(fits, PAIR).drop("model", "l1_ratio")


@query("i10_ridge", _coefficients("ridge"))
def ridge(p):
    fits = fitted(p, [("ridge", a, 0.0) for a in wf.RIDGE_ALPHAS])[3]
    return coefficient_rows(fits, PAIR).drop("model", "l1_ratio")


@query("i11_elastic_net")
def elastic_net(p):
    return coefficient_rows(fitted(p, ELASTIC, tuple(FACTORS))[3], FACTORS)


# The minimum for two features by cases: for each pair of signs, weights that have these signs and no slope left.
ELASTIC_FIT = {
    **{k: FIT[k] for k in ("sp", "tr", "sc", "zs", "gm")},
    "me": "SELECT g.name, sc.my, g.aa/n AS aa, g.ab/n AS ab, g.bb/n AS bb, (g.ay - sa_ * my)/n AS ca, (g.by_ - sb_ * my)/n AS cb FROM gm g JOIN sc ON sc.name = g.name"
          " JOIN (SELECT name, sum(a) AS sa_, sum(b) AS sb_ FROM zs GROUP BY name) z ON z.name = g.name",
    "ca": "SELECT me.*, alpha, l1_ratio, alpha*l1_ratio AS soft, alpha*(1-l1_ratio) AS flat, ga, gb FROM me, (VALUES (0.001::DOUBLE), (0.01), (0.1), (1.0)) x(alpha),"
          " (VALUES (0.2::DOUBLE), (0.8)) y(l1_ratio), (VALUES (-1), (0), (1)) u(ga), (VALUES (-1), (0), (1)) v(gb)",
    "so": """SELECT *, CASE WHEN ga = 0 THEN 0 WHEN gb = 0 THEN (ca - soft*ga)/(aa + flat) ELSE ((bb+flat)*(ca - soft*ga) - ab*(cb - soft*gb))/((aa+flat)*(bb+flat) - ab*ab) END AS wa,
        CASE WHEN gb = 0 THEN 0 WHEN ga = 0 THEN (cb - soft*gb)/(bb + flat) ELSE ((aa+flat)*(cb - soft*gb) - ab*(ca - soft*ga))/((aa+flat)*(bb+flat) - ab*ab) END AS wb FROM ca""",
    "fi": """SELECT name, alpha, l1_ratio, any_value(my) AS intercept, any_value(wa) AS wa, any_value(wb) AS wb FROM so
        WHERE sign(wa) = ga AND sign(wb) = gb AND (ga <> 0 OR abs(ca - ab*wb) <= soft) AND (gb <> 0 OR abs(cb - ab*wa) <= soft) GROUP BY name, alpha, l1_ratio""",
}


@query("i11_elastic_net_pair", sql(f"""SELECT name, 'elasticnet' AS model, alpha, l1_ratio, feature, {r('v')} AS coefficient FROM (
    SELECT name, alpha, l1_ratio, 'f_disc' AS feature, wa AS v FROM fi UNION ALL SELECT name, alpha, l1_ratio, 'f_qty', wb FROM fi
    UNION ALL SELECT name, alpha, l1_ratio, 'intercept', intercept FROM fi)""", "data", extra=ELASTIC_FIT))
def elastic_net_pair(p):
    return coefficient_rows(fitted(p, ELASTIC)[3], PAIR)


def scored_candidates(p, rows, fold_table, features, model, grid):
    """Selection score of every (alpha, l1_ratio) on every fold, all scored in one frame."""
    sums = wf.split_sums(wf.moments(rows, features), fold_table, START, strict=True)
    fits = wf.fits(sums, features, lambda name: [(model, a, l1) for a, l1 in grid])
    predictions = wf.score(rows.where("label IS NOT NULL"), fold_table, fits, features)
    candidate = F.concat_ws("|", "name", F.col("alpha").cast("string"), F.col("l1_ratio").cast("string"))
    scored = ic.metric_summary(materialise(predictions.withColumn("model", candidate)), slices=p.slices())
    parts = F.split("model", "\\|")
    flat = F.coalesce(F.col("rank_ic_std").isNull() & F.col("mean_rank_ic").isNull(), F.lit(True))
    return scored.select(parts[0].alias("name"), parts[1].cast("double").alias("alpha"), parts[2].cast("double").alias("l1_ratio"),
                         flat.alias("constant"), c.selection_score(F.col("mean_rank_ic"), F.col("pearson_ic"), F.col("top_bottom_return")).alias("score"))


def chosen(scores):
    """Mean score per candidate over the folds that have one; a candidate that predicts a constant on any fold is rejected.
    Of equal scores the first candidate of the (ascending) grid is taken."""
    table = scores.groupBy("alpha", "l1_ratio").agg(F.when(~F.bool_or("constant"), F.avg("score")).alias("score"))
    best = F.min_by(F.struct("alpha", "l1_ratio"), F.struct(-F.col("score"), "alpha", "l1_ratio"))
    return table, table.where("score IS NOT NULL").agg(best.alias("b")).select("b.*")


@query("i12_grid_search")
def grid_search(p):
    """Both grids on the last four folds."""
    rows = materialise(data(p))
    first, last = rows.agg(F.min("d"), F.max("d")).first()
    fold_table = kept(wf.folds(rows, first.isoformat(), last.isoformat(), last=4))
    grids = {"ridge": [(a, 0.0) for a in wf.RIDGE_ALPHAS], "elasticnet": [(a, l1) for a in wf.ELASTIC_ALPHAS for l1 in wf.ELASTIC_L1_RATIOS]}
    return quality.union_all([chosen(scored_candidates(p, rows, fold_table, FACTORS, model, grid))[0].withColumn("model", F.lit(model))
                              for model, grid in grids.items()])


TREES = 30  # boosting rounds of all splits together
ROUNDS, DRAWS = 6, 8  # of the search: rounds between two halvings, and candidates


def days(date) -> int:
    return (date - EPOCH).days


def split_models(sp, start: str = START, strict: bool = False, **options) -> list[boosting.Model]:
    """One model per split; the rows it trains on follow from its dates. One row per refit reaches the driver."""
    first = days(datetime.date.fromisoformat(start))
    return [boosting.Model(x["name"], first, boosting.NEVER, days(x["train_cutoff"]) + (not strict), **options)
            for x in sp.select("name", "train_cutoff").orderBy("name").collect()]


def tree_fits(p, trees: int = TREES):
    """(labelled panel, splits, one forest per split), all grown in the same passes."""
    rows, sp = materialise(data(p)), kept(splits(p))
    booster = boosting.Booster(rows, FACTORS, split_models(sp))
    booster.advance(trees)
    return rows, sp, booster.close()


@query("i13_boosted_trees")
def boosted_trees(p):
    rows, sp, forests = tree_fits(p)
    test = align.prediction_rows(rows, sp.select("name", "prediction_start", "prediction_end"))
    return boosting.predict(test, forests, FACTORS).select("name", "d", "symbol", "label", "prediction")


@query("i14_parameter_search")
def parameter_search(p):
    """Seeded candidates over all nine parameters on the last four folds before the calendar's last year, all grown in the
    same passes; after every ``ROUNDS`` rounds the better half goes on. Rows of the last year play no part."""
    rows = materialise(data(p))
    cutoff = sorted(x["train_cutoff"] for x in splits(p).select("train_cutoff").collect())[-4]  # one row per refit
    window = rows.where(F.col("label_exit_date") <= F.lit(cutoff))
    fold_table = kept(wf.folds(window, START, cutoff.isoformat(), last=4))
    draws = boosting.drawn(DRAWS, boosting.Params(rate=0.03, subsample=0.75, min_child_weight=10.0))
    models = [replace(m, name=f"{i}|{m.name}", params=params, seed=boosting.SEED + i)
              for i, params in enumerate(draws) for m in split_models(fold_table, strict=True)]
    booster = boosting.Booster(window, FACTORS, models)
    held = materialise(align.prediction_rows(window.where("label IS NOT NULL"), fold_table.select("name", "prediction_start", "prediction_end")))
    value = c.selection_score(F.col("mean_rank_ic"), F.col("pearson_ic"), F.col("top_bottom_return"))
    alive, table = list(range(DRAWS)), []
    while alive:
        wanted = [m.name for m in models if int(m.name.split("|")[0]) in alive]
        forests = [f for f in booster.advance(ROUNDS, wanted) if f.name in set(wanted)]
        placed = held.select("d", "symbol", "label", *FACTORS, F.col("name").alias("fold"), F.explode(F.array(*[F.lit(i) for i in alive])).alias("candidate"))
        named = placed.withColumn("name", F.concat_ws("|", "candidate", "fold"))
        predicted = boosting.predict(named, forests, FACTORS).withColumn("model", F.col("candidate").cast("string"))
        # a candidate that predicts a constant on every date has no score and ranks last
        scores = {int(r["model"]): (r["score"], r["folds"]) for r in ic.metric_summary(materialise(predicted), slices=p.slices()).select(
            "model", value.alias("score")).join(predicted.groupBy("model").agg(F.countDistinct("fold").alias("folds")), "model").collect()}
        ranked = sorted(alive, key=lambda i: (scores[i][0] is None, -(scores[i][0] or 0.0), i))
        table += [(i, booster.rounds, *astuple(draws[i]), *scores[i], place + 1) for place, i in enumerate(ranked)]
        alive = sorted(ranked[:len(ranked) // 2])
    booster.close()
    return p.spark.createDataFrame(table, "candidate int, rounds int, depth int, learning_rate double, min_child_weight double, gamma double, "
                                   "reg_alpha double, reg_lambda double, subsample double, colsample double, max_bin int, score double, folds bigint, place int")


@query("i15_walk_forward", sql(f"""SELECT model, name, {r('avg(ic)')} AS mean_rank_ic, {r('avg(pic)')} AS pearson_ic, CAST(sum(n) AS BIGINT) AS samples FROM (
    SELECT model, name, d, corr(ra, rb) AS ic, corr(prediction, label) AS pic, count(*) AS n FROM (
      SELECT *, rank() OVER (PARTITION BY model, name, d ORDER BY prediction) + (count(*) OVER (PARTITION BY model, name, d, prediction)-1)/2.0 AS ra,
        rank() OVER (PARTITION BY model, name, d ORDER BY label) + (count(*) OVER (PARTITION BY model, name, d, label)-1)/2.0 AS rb
      FROM pr WHERE label IS NOT NULL AND alpha IN (0, 10)) GROUP BY model, name, d) GROUP BY model, name""", "data", extra=FIT))
def walk_forward(p):
    rows, sp, _, fits = fitted(p, [*OLS, ("ridge", 10.0, 0.0)])
    predictions = wf.score(rows, sp, fits, PAIR).withColumn("prediction", F.round("prediction", 12))
    daily = ic.daily_ic(predictions.where("label IS NOT NULL"), ("model", "name", "d"), slices=p.slices())
    return daily.groupBy("model", "name").agg(F.avg("rank_ic").alias("mean_rank_ic"), F.avg("pearson_ic").alias("pearson_ic"),
                                              F.sum("stock_count").alias("samples"))


def yearly_folds(dates, years, last: int = 2) -> list[tuple]:
    """(year, quarter, first, last date) of each year's trailing folds: quarters whose labels are realised before the year.
    ``dates``: ascending (d, label_exit_date)."""
    out = []
    for year in years:
        begin = datetime.date(year, 1, 1)
        known = [d for d, x in dates if d < begin and x < begin]
        out += [(year, q.name, q.first, q.last) for q in rotation.quarters_of(known)[-last:]]
    return out


def yearly_penalties(p, rows, table, years) -> dict[int, float]:
    """The ridge penalty of every year, chosen on its trailing folds. All folds of all years are fitted from one table of
    moments and scored in one frame; a choice per year reaches the driver."""
    first = datetime.date.fromisoformat(START)
    dates = sorted(tuple(r) for r in table.select("d", "label_exit_date").distinct().collect() if r["d"] >= first)
    folds = yearly_folds(dates, years)
    spans = p.spark.createDataFrame([(f"{y}/{q}", a, a, b) for y, q, a, b in folds], "name string, train_cutoff date, prediction_start date, prediction_end date")
    fits = wf.fits(wf.split_sums(table, spans, START, strict=True), FACTORS, lambda name: [("ridge", a, 0.0) for a in wf.RIDGE_ALPHAS])
    parts, rest = [], sorted(folds, key=lambda f: f[2])
    while rest:  # spans of one pass do not overlap; two years share a quarter only where the calendar has gaps
        own, later, end = [], [], datetime.date.min
        for f in rest:
            (own if f[2] > end else later).append(f)
            end = max(end, f[3]) if f[2] > end else end
        named = spans.where(F.col("name").isin([f"{y}/{q}" for y, q, *_ in own]))
        parts.append(wf.score(rows.where("label IS NOT NULL"), named, fits, FACTORS))
        rest = later
    scored = quality.union_all(parts).withColumn("model", F.concat_ws("|", "name", F.col("alpha").cast("string")))
    figures = ic.metric_summary(materialise(scored), slices=p.slices())
    value = c.selection_score(F.col("mean_rank_ic"), F.col("pearson_ic"), F.col("top_bottom_return"))
    split = F.split("model", "\\|")
    flat = F.coalesce(F.col("rank_ic_std").isNull() & F.col("mean_rank_ic").isNull(), F.lit(True))
    each = figures.select(F.substring_index(split[0], "/", 1).cast("int").alias("year"), split[1].cast("double").alias("alpha"), value.alias("score"), flat.alias("flat"))
    mean = each.groupBy("year", "alpha").agg(F.when(~F.bool_or("flat"), F.avg("score")).alias("score")).where("score IS NOT NULL")
    best = mean.groupBy("year").agg(F.min_by("alpha", F.struct(-F.col("score"), "alpha")).alias("alpha"))
    return {r["year"]: r["alpha"] for r in best.collect()}


@query("i16_yearly_retune")
def yearly_retune(p):
    """Penalty chosen once a year on trailing folds inside that year's training window, then used for its splits."""
    rows, sp = materialise(data(p)), kept(splits(p))
    table = wf.moments(rows, FACTORS)
    sums = wf.split_sums(table, sp, START)
    years = sums.select(F.substring("name", 1, 4).cast("int").alias("year")).distinct().collect()
    alpha = yearly_penalties(p, rows, table, sorted(x["year"] for x in years))
    fits = wf.fits(sums, FACTORS, lambda name: [("ridge", alpha[int(name[:4])], 0.0)])
    scored = wf.score(rows, sp, fits, FACTORS)
    return scored.groupBy("name", "alpha").agg(F.count("*").alias("rows"), F.avg("prediction").alias("mean_prediction"))


@query("i17_training_records", sql(f"""SELECT t.name, t.train_rows, t.first_d, t.last_d, t.last_exit, 2 AS feature_count, v.prediction_rows, {r('v.rank_ic')} AS test_rank_ic FROM (
    SELECT name, count(*) AS train_rows, min(d) AS first_d, max(d) AS last_d, max(label_exit_date) AS last_exit FROM tr GROUP BY name) t JOIN (
    SELECT name, CAST(sum(n) AS BIGINT) AS prediction_rows, avg(ic) AS rank_ic FROM (SELECT name, d, count(*) AS n, corr(ra, rb) AS ic FROM (
      SELECT *, CASE WHEN label IS NOT NULL THEN rank() OVER (PARTITION BY name, d, label IS NULL ORDER BY prediction) + (count(*) OVER (PARTITION BY name, d, label IS NULL, prediction)-1)/2.0 END AS ra,
        CASE WHEN label IS NOT NULL THEN rank() OVER (PARTITION BY name, d ORDER BY label NULLS LAST) + (count(*) OVER (PARTITION BY name, d, label)-1)/2.0 END AS rb
      FROM pr WHERE model = 'linear_regression') GROUP BY name, d) GROUP BY name) v ON v.name = t.name""", "data", extra=FIT))
def training_records(p):
    rows, sp, sums, fits = fitted(p, OLS)
    predictions = wf.score(rows, sp, fits, PAIR).withColumn("prediction", F.round("prediction", 12))
    daily = ic.daily_ic(predictions, ("name", "d"), slices=p.slices())
    tests = daily.groupBy("name").agg(F.avg("rank_ic").alias("test_rank_ic"))
    counts = predictions.groupBy("name").agg(F.count("*").alias("prediction_rows"))
    table = sums.select("name", F.element_at("block", -1).cast("bigint").alias("train_rows"), F.col("first").alias("first_d"),
                        F.col("last").alias("last_d"), "last_exit", F.lit(len(PAIR)).alias("feature_count"))
    return table.join(tests, "name").join(counts, "name")


@query("i17_train_fit", sql(f"""SELECT name, {r('avg(ic)')} AS mean_rank_ic, {r('avg(pic)')} AS pearson_ic, CAST(sum(n) AS BIGINT) AS samples FROM (
    SELECT name, d, corr(ra, rb) AS ic, corr(prediction, label) AS pic, count(*) AS n FROM (
      SELECT *, rank() OVER (PARTITION BY name, d ORDER BY prediction) + (count(*) OVER (PARTITION BY name, d, prediction)-1)/2.0 AS ra,
        rank() OVER (PARTITION BY name, d ORDER BY label) + (count(*) OVER (PARTITION BY name, d, label)-1)/2.0 AS rb FROM (
        SELECT t.name, t.d, t.label, round(intercept + coalesce((f_disc-ma)/sa,0)*wa + (f_qty-mb)/sb*wb, 12) AS prediction
        FROM tr t JOIN fit f ON f.name = t.name AND f.model = 'linear_regression')) GROUP BY name, d) GROUP BY name""", "data",
                             extra={k: FIT[k] for k in ("sp", "tr", "sc", "zs", "gm", "fit")}))
def train_fit(p):
    """Rank IC of every split's fit on all its training rows, to set beside the test figure."""
    rows, sp, _, fits = fitted(p, OLS)
    train = align.training_rows(rows, sp.select("name", "train_cutoff"), START)
    scored = wf.with_fit(train, fits, PAIR).withColumn("prediction", F.round("prediction", 12))
    daily = ic.daily_ic(scored, ("name", "d"), slices=p.slices())
    return daily.groupBy("name").agg(F.avg("rank_ic").alias("mean_rank_ic"), F.avg("pearson_ic").alias("pearson_ic"), F.sum("stock_count").alias("samples"))


@query("i18_importance")
def importance(p):
    trees = boosting.importance_rows(p.spark, tree_fits(p)[2], FACTORS).withColumn("model", F.lit("boosted_trees"))
    fits = fitted(p, [("ridge", 1.0, 0.0)], tuple(FACTORS))[3]
    linear = coefficient_rows(fits, FACTORS).where("feature <> 'intercept'").select(
        "feature", F.col("coefficient").alias("importance"), "model", "name")
    return linear.unionByName(trees)
