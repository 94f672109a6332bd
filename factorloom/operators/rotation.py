"""Style rotation over every quarter of the calendar and every pool.

What a quarter may know follows from its first decision date, the cutoff: rows dated before it whose labels are realised
before it. Rules and choices are tables by (pool, quarter); the rows they act on are never copied per quarter, save where
the result itself has a row per quarter. Trees of all quarters grow together (``boosting``), tree counts are chosen once per
pool and horizon on the first quarter with enough history and kept from then on, and residual models come from one table of
sums per date.

Decision dates and their label exits reach the driver: one row per date and pool, which the DATE type bounds.
"""

from __future__ import annotations

import datetime
import math
import statistics
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factorloom.functions.columns import CALENDAR_DAYS, TRADING_DAYS, quarter_name
from factorloom.operators import boosting, gram, ic, timing
from factorloom.operators.pca import Components, quarter_label
from factorloom.operators.style import cross_style_ic
from factorloom.session import materialise

EPOCH = datetime.date(1970, 1, 1)
SHARE = 0.80


def day_number(d: datetime.date) -> int:
    return (d - EPOCH).days


@dataclass(frozen=True)
class Quarter:
    name: str
    first: datetime.date
    last: datetime.date


def quarters_of(dates: Sequence[datetime.date]) -> list[Quarter]:
    spans: dict[str, list[datetime.date]] = {}
    for d in sorted(dates):
        spans.setdefault(quarter_label(d.year * 4 + (d.month - 1) // 3), []).append(d)
    return [Quarter(name, ds[0], ds[-1]) for name, ds in spans.items()]


def embargo(dates: Sequence[datetime.date], trading_days: int) -> int:
    """The embargo in observations, from the median gap of ascending dates (as ``calendar.embargo_observations``)."""
    gaps = [(b - a).days for a, b in zip(dates, dates[1:])]
    if trading_days <= 0:
        return 0
    if not gaps:
        return max(1, trading_days)
    return max(1, math.ceil(trading_days / max(1.0, statistics.median(gaps) * TRADING_DAYS / CALENDAR_DAYS)))


def chronological(dates: Sequence[datetime.date], trading_days: int) -> tuple[datetime.date, datetime.date] | None:
    """(day after the last fit date, first validation date) of ascending dates, or None without room for both."""
    n, gap = len(dates), embargo(dates, trading_days)
    start = max(gap + 1, min(n - 1, math.floor(n * SHARE)))
    if start >= n or start - gap < 1:
        return None
    return dates[start - gap - 1] + datetime.timedelta(days=1), dates[start]


def quarter_table(spark, quarters: Sequence[Quarter]) -> DataFrame:
    rows = [(q.name, q.first, q.first, q.last) for q in quarters]
    return spark.createDataFrame(rows, "name string, train_cutoff date, prediction_start date, prediction_end date")


def decision_dates(tables: dict[str, DataFrame], exits: Sequence[str]) -> dict[str, list[tuple]]:
    """Per pool, ascending rows (d, *exits)."""
    return {pool: [tuple(r) for r in t.select("d", *exits).orderBy("d").collect()] for pool, t in tables.items()}


@dataclass
class Choice:
    """Trees and validation figure of one model family, chosen once; ``quarter`` is where."""
    quarter: str
    trees: int
    value: float | None
    fit_end: datetime.date
    validation_start: datetime.date


def selection(quarters: Sequence[Quarter], known, trading_days: int, fewest: int):
    """The first quarter whose training dates leave room for a purged validation: (quarter, day after the fit, first
    validation date). ``known``: ascending (d, exit); fit rows are realised before the validation starts."""
    for q in quarters:
        pairs = [(d, x) for d, x in known if d < q.first and x is not None and x < q.first]
        cut = chronological([d for d, _ in pairs], trading_days) if len(pairs) >= fewest else None
        if cut and any(d < cut[0] and x < cut[1] for d, x in pairs):
            return q, *cut
    return None


# the two horizons

def horizon_rows(tables: dict[str, DataFrame], styles: Sequence[str], horizons: Sequence[int] = timing.HORIZONS) -> tuple[DataFrame, list[str]]:
    """(kind, d, style, label_exit_date, target, features): the long design of every pool and horizon; kinds count them."""
    out, features = None, []
    for i, (pool, table) in enumerate(tables.items()):
        for j, h in enumerate(horizons):
            rows, features = timing.long_design(table.withColumn("label_exit_date", F.col(f"label_exit_date_{h}")), styles, h)
            rows = rows.withColumns({"kind": F.lit(i * len(horizons) + j), "pool": F.lit(pool), "horizon": F.lit(h)})
            out = rows if out is None else out.unionByName(rows)
    return out, features


def dual_horizon(tables: dict[str, DataFrame], styles: Sequence[str], params: boosting.Params, rounds: int, patience: int,
                 horizons: Sequence[int] = timing.HORIZONS) -> tuple[DataFrame, dict[tuple[str, int], Choice], DataFrame]:
    """(forecasts, choices, one row per pool, horizon and quarter with its tree count or the reason it has none).

    Forecasts: pool, quarter, d, style, forecast_<h>.
    """
    spark = next(iter(tables.values())).sparkSession
    rows, features = horizon_rows(tables, styles, horizons)
    rows = materialise(rows.where("target IS NOT NULL"))
    known = decision_dates(tables, [f"label_exit_date_{h}" for h in horizons])
    spans = {pool: quarters_of([r[0] for r in ds]) for pool, ds in known.items()}
    picks = {(pool, h): selection(spans[pool], [(r[0], r[1 + j]) for r in known[pool]], timing.EMBARGO_DAYS, 4)
             for pool in tables for j, h in enumerate(horizons)}
    kind = {(pool, h): i * len(horizons) + j for i, pool in enumerate(tables) for j, h in enumerate(horizons)}

    trial = []
    for key, pick in picks.items():
        if pick:
            q, end, start = pick
            cutoff = day_number(q.first)
            trial.append(boosting.Model(f"{key[0]}|{key[1]}", 0, day_number(end), day_number(start), kind[key], cutoff,
                                        (day_number(start), cutoff, cutoff), params, True))
    choices: dict[tuple[str, int], Choice] = {}
    if trial:
        booster = boosting.Booster(rows, features, trial, "target", ("d", "style", "kind"), "kind")
        booster.advance(rounds, patience=patience)
        fitted = [boosting.truncated(f, f.best_rounds()) for f in booster.close()]
        named = rows.withColumn("name", F.concat_ws("|", "pool", "horizon"))
        spans_held = spark.createDataFrame([(f"{k[0]}|{k[1]}", v[2], v[0].first) for k, v in picks.items() if v], "name string, lo date, hi date")
        held = named.join(F.broadcast(spans_held), "name").where("d >= lo AND label_exit_date < hi")
        daily = cross_style_ic(boosting.predict(held, fitted, features), "prediction", "target", ("name", "d"))
        values = {r["name"]: r["v"] for r in daily.groupBy("name").agg(F.avg("rank_ic").alias("v")).collect()}  # one per pool and horizon
        for f in fitted:
            pool, h = f.name.split("|")
            q, end, start = picks[pool, int(h)]
            choices[pool, int(h)] = Choice(q.name, len(f.trees), values.get(f.name), end, start)

    models, notes = [], []
    for (pool, h), choice in ((k, choices.get(k)) for k in picks):
        for q in spans[pool]:
            if choice is None or q.first < next(x.first for x in spans[pool] if x.name == choice.quarter):
                notes.append((pool, h, q.name, None, None, "too few realised dates for a purged validation"))
                continue
            cutoff = day_number(q.first)
            models.append(boosting.Model(f"{pool}|{h}|{q.name}", 0, cutoff, cutoff, kind[pool, h], cutoff, None, params, True))
            notes.append((pool, h, q.name, choice.trees, choice.value, "chosen here" if q.name == choice.quarter else f"kept from {choice.quarter}"))
    table = spark.createDataFrame(notes, "pool string, horizon int, quarter string, trees int, validation_ic double, reason string")
    forests = grown(boosting.Booster(rows, features, models, "target", ("d", "style", "kind"), "kind"), models,
                    lambda m: choices[m.name.split("|")[0], int(m.name.split("|")[1])].trees) if models else []
    out = None
    for h in horizons:
        legs = None
        for pool, t in tables.items():
            design, _ = timing.long_design(t, styles)
            leg = design.withColumns({"pool": F.lit(pool), "quarter": quarter_name(F.col("d"))})
            legs = leg if legs is None else legs.unionByName(leg)
        named = legs.withColumn("name", F.concat_ws("|", "pool", F.lit(str(h)), "quarter"))
        scored = boosting.predict(named, [f for f in forests if f.name.split("|")[1] == str(h)], features, output=f"forecast_{h}").select(
            "pool", "quarter", "d", "style", f"forecast_{h}")
        out = scored if out is None else out.join(scored, ["pool", "quarter", "d", "style"])
    return out, choices, table


def grown(booster: boosting.Booster, models: Sequence[boosting.Model], trees) -> list[boosting.Forest]:
    """Grow every model to its own number of trees; those that have fewer stop, the others go on together."""
    at = 0
    for level in sorted({trees(m) for m in models}):
        booster.advance(level - at, [m.name for m in models if trees(m) >= level])
        at = level
    return [boosting.truncated(f, trees(m)) for m, f in zip(models, booster.close())]


# timers

def class_and_target_rows(tables: dict[str, DataFrame], styles: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(kind, d, label_exit_date, label, weight, features): for every pool and style, whether the style wins (even kinds) and
    its return (odd kinds). A winner by a margin weighs more."""
    features = timing.feature_names(styles)[:-1]
    out = None
    for i, table in enumerate(tables.values()):
        legs = []
        for j, s in enumerate(styles):
            base = 2 * (i * len(styles) + j)
            legs += [F.struct(F.lit(base).alias("kind"), F.when(F.col("best_style").isNotNull(), (F.col("best_style") == s).cast("double")).alias("label")),
                     F.struct(F.lit(base + 1).alias("kind"), F.col(f"target_{s}_5").alias("label"))]
        rows = table.select("d", "label_exit_date", (1 + F.greatest(F.coalesce("winner_margin", F.lit(0.0)), F.lit(0.0))).alias("weight"),
                            *features, F.explode(F.array(*legs)).alias("leg")).select("d", "label_exit_date", "weight", *features, "leg.*")
        out = rows if out is None else out.unionByName(rows)
    return out, features


def softmax_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, ridge: float = 0.01, steps: int = 25) -> np.ndarray:
    """Weights (classes x columns, intercept last) of the penalised multinomial likelihood, by Newton steps.

    ``x`` is scaled; the intercepts are not penalised, but for what keeps the system regular.
    """
    n, k = x.shape
    x1 = np.column_stack([x, np.ones(n)])
    b = np.zeros((classes, k + 1))
    target = np.eye(classes)[y]
    share = w / w.sum()
    penalty = np.tile(np.append(np.full(k, ridge), 1e-8), classes)
    for _ in range(steps):
        z = x1 @ b.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = ((p - target) * share[:, None]).T @ x1
        curve = np.zeros((classes * (k + 1),) * 2)
        for a in range(classes):
            for c in range(a, classes):
                block = (x1 * (share * p[:, a] * ((a == c) - p[:, c]))[:, None]).T @ x1
                curve[a * (k + 1):(a + 1) * (k + 1), c * (k + 1):(c + 1) * (k + 1)] = block
                curve[c * (k + 1):(c + 1) * (k + 1), a * (k + 1):(a + 1) * (k + 1)] = block.T
        move = np.linalg.solve(curve + np.diag(penalty), slope.ravel() + penalty * b.ravel())
        b -= move.reshape(b.shape)
        if np.abs(move).max() < 1e-9:
            break
    return b


def logistic_weights(tables: dict[str, DataFrame], styles: Sequence[str], quarters: DataFrame) -> DataFrame:
    """(pool, quarter, d, style, w): class probabilities of one multinomial model per pool and quarter.

    A group is a pool's decision dates up to a quarter's end: one row per date, bounded by the calendar.
    """
    features = timing.feature_names(styles)[:-1]
    both = None
    for pool, table in tables.items():
        rows = table.select(F.lit(pool).alias("pool"), "d", "label_exit_date", "best_style", "winner_margin",
                            F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias("x"))
        both = rows if both is None else both.unionByName(rows)
    named = quarters.select(F.col("pool").alias("pool_"), "quarter", "first", "last")
    dated = both.join(F.broadcast(named), (F.col("pool") == F.col("pool_")) & (F.col("d") <= F.col("last"))).drop("pool_")
    place = {s: k for k, s in enumerate(styles)}

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("d")
        first = part["first"].iloc[0]
        train = part[(part["d"] < first) & part["best_style"].notna() & part["label_exit_date"].notna()]
        train = train[[x < first for x in train["label_exit_date"]]]
        test = part[part["d"] >= first]
        share = np.full((len(test), len(styles)), 1.0 / len(styles))
        if len(train):
            x = np.stack(train["x"].to_list())
            mean, spread = x.mean(axis=0), x.std(axis=0)
            spread = np.where(spread > 1e-12, spread, 1.0)
            age = np.array([(first - d).days for d in train["d"]]) / boosting.HALF_LIFE
            w = np.exp2(-age) * (1 + np.maximum(np.nan_to_num(train["winner_margin"].to_numpy(dtype=float)), 0))
            b = softmax_fit((x - mean) / spread, train["best_style"].map(place).to_numpy(), w, len(styles))
            z = np.column_stack([(np.stack(test["x"].to_list()) - mean) / spread, np.ones(len(test))]) @ b.T
            share = np.exp(z - z.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
        return pd.DataFrame([(key[0], key[1], d, s, float(v)) for d, row in zip(test["d"], share) for s, v in zip(styles, row)],
                            columns=["pool", "quarter", "d", "style", "w"])

    return dated.groupBy("pool", "quarter").applyInPandas(run, "pool string, quarter string, d date, style string, w double")


def tree_timers(tables: dict[str, DataFrame], styles: Sequence[str], spans: dict[str, list[Quarter]], params: boosting.Params,
                rounds: int) -> tuple[DataFrame, DataFrame]:
    """(class shares, return forecasts) per pool, quarter, d and style from trees that all grow together."""
    rows, features = class_and_target_rows(tables, styles)
    models = []
    for i, pool in enumerate(tables):
        for q in spans[pool]:
            cutoff = day_number(q.first)
            for j, s in enumerate(styles):
                for t, what in enumerate(("wins", "return")):
                    models.append(boosting.Model(f"{pool}|{q.name}|{s}|{what}", 0, cutoff, cutoff, 2 * (i * len(styles) + j) + t, cutoff, None, params, True))
    booster = boosting.Booster(rows, features, models, "label", ("d", "kind"), "kind", "weight")
    booster.advance(rounds)
    forests = booster.close()
    legs = None
    for pool, table in tables.items():
        leg = table.select(F.lit(pool).alias("pool"), quarter_name(F.col("d")).alias("quarter"), "d", *features, F.explode(F.array(*[F.lit(s) for s in styles])).alias("style"))
        legs = leg if legs is None else legs.unionByName(leg)
    out = []
    for what in ("wins", "return"):
        named = legs.withColumn("name", F.concat_ws("|", "pool", "quarter", "style", F.lit(what)))
        out.append(boosting.predict(named, [f for f in forests if f.name.endswith(what)], features, output="x").select("pool", "quarter", "d", "style", "x"))
    return out[0], out[1]


# residual models

def upper(x: np.ndarray) -> np.ndarray:
    """Sums over rows of (features..., label): the upper triangle of the products of (features, 1), then with the label."""
    x1 = np.column_stack([np.nan_to_num(x[:, :-1]), np.ones(len(x))])
    return np.concatenate([(x1.T @ x1)[np.triu_indices(x1.shape[1])], x1.T @ x[:, -1]])


def date_sums(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(pool, d, label_exit_date, block) of labelled rows."""
    labelled = rows.where(F.col("label").isNotNull() & F.col("label_exit_date").isNotNull())
    return gram.block_sums(labelled, ["pool", "d", "label_exit_date"], [*features, "label"], upper)


def residual_part(block: np.ndarray, loadings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """From a date's sums: products of (features, 1), their products with the residual label, the coefficients (on features
    and 1) that the label is explained with, and the rows. The residual is what least squares on the exposures leaves; a
    standardised exposure spans with the intercept what the raw one does, so the sums of raw features are enough."""
    k, s = loadings.shape
    m = np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = block[:-(k + 1)]
    m = m + np.triu(m, 1).T
    v, n = block[-(k + 1):], m[-1, -1]
    if n <= s + 1:
        return None
    turn = np.zeros((k + 1, s + 1))
    turn[:k, :s], turn[k, s] = loadings, 1.0
    beta = turn @ np.linalg.lstsq(turn.T @ m @ turn, turn.T @ v, rcond=None)[0]
    return m, v - m @ beta, beta, n


SPECS = "pool string, quarter string, part string, until date, realised date, cutoff date, loadings array<array<double>>"


def residual_specs(spark, spans: dict[str, list[Quarter]], known: dict[str, list[tuple]], found: dict[str, Components],
                   trading_days: int) -> tuple[DataFrame, DataFrame]:
    """(specs of the fits, validation spans): per pool and quarter all training rows, and those before a purged validation."""
    fits, held = [], []
    for pool, quarters in spans.items():
        for q in quarters:
            if q.name not in found:
                continue
            loadings = found[q.name].loadings.tolist()
            fits.append((pool, q.name, "all", q.first, q.first, q.first, loadings))
            cut = chronological([d for d, x in known[pool] if d < q.first and x is not None and x < q.first], trading_days)
            if cut:
                fits.append((pool, q.name, "fit", cut[0], cut[1], q.first, loadings))
                held.append((pool, q.name, cut[1], q.first, loadings))
    return (spark.createDataFrame(fits, SPECS),
            spark.createDataFrame(held, "pool string, quarter string, start date, cutoff date, loadings array<array<double>>"))


def residual_fits(sums: DataFrame, specs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(pool, quarter, part, rows, last_exit, weights, intercept): weighted ridge of the residual label on the part of the
    features that the quarter's loadings do not span. A (pool, quarter, part) adds up its own dates' sums."""
    on = (F.col("s.pool") == F.col("b.pool")) & (F.col("d") < F.col("until")) & (F.col("label_exit_date") < F.col("realised"))
    met = sums.alias("b").join(specs.alias("s"), on).select("s.pool", "quarter", "part", "d", "label_exit_date", "cutoff", "loadings", "block")

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                loadings = np.array([list(x) for x in r.loadings])
                got = residual_part(np.asarray(r.block), loadings)
                if got:
                    m, v, _, n = got
                    w = 2.0 ** (-(r.cutoff - r.d).days / boosting.HALF_LIFE)
                    out.append((r.pool, r.quarter, r.part, np.concatenate([(w * m).ravel(), w * v, [w * n, n]]).tolist()))
            yield pd.DataFrame(out, columns=["pool", "quarter", "part", "block"])

    keys = ["pool", "quarter", "part"]
    total = gram.added(met.mapInPandas(weigh, "pool string, quarter string, part string, block array<double>"), keys)
    exits = met.groupBy(*keys).agg(F.max("label_exit_date").alias("last_exit"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                loadings = np.array([list(x) for x in r.loadings])
                k = len(loadings)
                block = np.asarray(r.block)
                m, v, (w, n) = block[:(k + 1) ** 2].reshape(k + 1, k + 1), block[(k + 1) ** 2:-2], block[-2:]
                basis, _ = np.linalg.qr(loadings)
                lift = np.eye(k + 1)
                lift[:k, :k] -= basis @ basis.T
                solution = gram.solve_ridge(lift @ m @ lift / w, lift @ v / w, alpha)
                out.append((r.pool, r.quarter, r.part, int(n), r.last_exit, (lift[:k, :k] @ solution[:k]).tolist(), float(solution[k])))
            yield pd.DataFrame(out, columns=[*keys, "rows", "last_exit", "weights", "intercept"])

    asked = total.join(exits, keys).join(specs.select(*keys, "loadings"), keys)
    return asked.mapInPandas(solve, "pool string, quarter string, part string, rows bigint, last_exit date, weights array<double>, intercept double")


def residual_validation(rows: DataFrame, sums: DataFrame, fits: DataFrame, held: DataFrame, features: Sequence[str],
                        slices: int | None = None) -> DataFrame:
    """(pool, quarter, rank_ic, dates): mean daily rank IC, on the validation dates, of the fit on the rows before them
    against the residual label."""
    on = (F.col("h.pool") == F.col("b.pool")) & (F.col("d") >= F.col("start")) & (F.col("d") < F.col("cutoff")) & (F.col("label_exit_date") < F.col("cutoff"))
    met = sums.alias("b").join(held.alias("h"), on).select("h.pool", "quarter", "d", "loadings", "block")

    def explain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                got = residual_part(np.asarray(r.block), np.array([list(x) for x in r.loadings]))
                if got:
                    out.append((r.pool, r.quarter, r.d, got[2].tolist()))
            yield pd.DataFrame(out, columns=["pool", "quarter", "d", "beta"])

    betas = met.mapInPandas(explain, "pool string, quarter string, d date, beta array<double>")
    rules = betas.join(fits.where("part = 'fit'").select("pool", "quarter", "weights", "intercept"), ["pool", "quarter"])
    explained, predicted = F.get("beta", F.lit(len(features))), F.col("intercept")
    for i, f in enumerate(features):
        x = F.coalesce(F.col(f), F.lit(0.0))
        explained, predicted = explained + x * F.get("beta", F.lit(i)), predicted + x * F.get("weights", F.lit(i))
    scored = rows.where("label IS NOT NULL").join(rules, ["pool", "d"]).select(
        "pool", "quarter", "d", "symbol", (F.col("label") - explained).alias("residual_label"), predicted.alias("prediction"))
    daily = ic.daily_ic(scored, ("pool", "quarter", "d"), "prediction", "residual_label", slices=slices)
    return daily.groupBy("pool", "quarter").agg(F.avg("rank_ic").alias("rank_ic"), F.count("rank_ic").alias("dates"))
