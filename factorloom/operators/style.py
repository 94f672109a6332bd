"""Style returns, timing features and labels, votes, forecast weights and the confidence gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factorloom.functions.columns import quarter_name
from factorloom.operators import ic
from factorloom.operators.calendar import calendar_broadcast
from factorloom.operators.ranking import add_rank, percent
from factorloom.operators.series import compounded

HIGH, LOW, LEAST_NAMES = 0.8, 0.2, 10
SELL_CONFIRMATIONS = 2


def style_returns(rows: DataFrame, slices: int | None = None) -> DataFrame:
    """(d, style) mean label of the top fifth minus the bottom fifth by exposure ``x``."""
    valid = rows.where(F.col("x").isNotNull() & F.col("label").isNotNull())
    ranked = add_rank(valid, ("d", "style"), "x", prefix="_r", slices=slices).withColumn("_pct", percent("_r"))
    top, bottom = F.when(F.col("_pct") >= HIGH, F.col("label")), F.when(F.col("_pct") <= LOW, F.col("label"))
    return ranked.where(F.col("_r_n") >= LEAST_NAMES).groupBy("d", "style").agg(
        (F.avg(top) - F.avg(bottom)).alias("style_return"), F.max("label_entry_date").alias("style_entry_date"),
        F.max("label_exit_date").alias("style_exit_date"))


def retain_flags(votes: DataFrame, confirmations: int = SELL_CONFIRMATIONS) -> DataFrame:
    """Keep a holding that the model retains, or that fewer than ``confirmations`` styles want sold."""
    if "retain" in votes.columns:
        return votes.withColumns({"retain": F.coalesce("retain", F.lit(False)), "sell_votes": F.lit(None).cast("double")})
    if "sell_votes" not in votes.columns:
        raise ValueError("retain flags need a retain or a sell_votes column")
    return votes.withColumn("retain", F.coalesce("sell_votes", F.lit(0)) < confirmations)


def retain_audit(flags: DataFrame) -> DataFrame:
    """Rows are unique on (d, symbol), so names are counted as rows."""
    return flags.groupBy("d").agg(F.count("symbol").alias("stock_count"),
                                  F.count(F.when(F.col("retain"), 1)).alias("retained_count"),
                                  F.avg("sell_votes").alias("average_sell_votes"))


def quarterly_component_ic(daily: DataFrame) -> DataFrame:
    std = F.stddev_samp("rank_ic")
    return daily.groupBy(quarter_name(F.col("d")).alias("quarter"), "style").agg(
        F.avg("rank_ic").alias("mean_rank_ic"), std.alias("rank_ic_std"),
        F.try_divide(F.avg("rank_ic"), std).alias("icir"), ic.ratio_above("rank_ic").alias("positive_ratio"),
        F.count("rank_ic").alias("observation_days"), F.avg("stock_count").alias("average_stock_count"))


def component_rows(rows: DataFrame) -> DataFrame:
    """Score components over the names that have a final score, plus the residual over all names."""
    candidate = F.col("prediction").isNotNull()
    legs = [F.struct(F.lit(name).alias("component"), F.when(candidate | F.lit(whole), F.col(col)).alias("x"))
            for name, col, whole in (("style_timing", "style_timing_score", False),
                                     ("orthogonal_residual", "residual_prediction_score", False),
                                     ("final", "prediction", False),
                                     ("orthogonal_residual_all_universe", "residual_prediction_score", True))]
    return (rows.select("d", "symbol", "label", F.explode(F.array(*legs)).alias("leg"))
            .select("d", "symbol", "label", "leg.component", "leg.x").where("x IS NOT NULL"))


def cross_style_ic(rows: DataFrame, signal: str, target: str, by: Sequence[str] = ("d",)) -> DataFrame:
    """Rank IC across styles on each date; at least three styles. A date has one row per style."""
    return ic.daily_ic(rows, by, signal, target, least=3, tie=("style",), slices=0)


def timing_features(returns: DataFrame, dates: DataFrame, styles: Sequence[str]) -> DataFrame:
    """(d, style) momentum over the last 5 and 20 returns realised by d, their volatility, and the latest date used.

    A style has one return per date; rolling values are computed on the returns and looked up as of d.
    """
    seen = Window.partitionBy("style").orderBy("d")
    rolled = returns.select(
        "style", F.col("style_exit_date").alias("at"), F.lit(0).alias("kind"), F.col("d").alias("source"),
        F.struct(F.avg("style_return").over(seen.rowsBetween(-4, 0)).alias("momentum_5"),
                 F.avg("style_return").over(seen.rowsBetween(-19, 0)).alias("momentum_20"),
                 F.stddev_pop("style_return").over(seen.rowsBetween(-4, 0)).alias("volatility_5"),
                 F.col("style_exit_date").alias("max_information_date")).alias("features"))
    wanted = dates.select("d").distinct().select(
        F.explode(F.array(*[F.lit(s) for s in styles])).alias("style"), F.col("d").alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast("date").alias("source"), F.lit(None).cast(rolled.schema["features"].dataType).alias("features"))
    known = Window.partitionBy("style").orderBy("at", "kind", "source").rowsBetween(Window.unboundedPreceding, 0)
    looked = rolled.unionByName(wanted).withColumn("features", F.last("features", ignorenulls=True).over(known))
    return looked.where("kind = 1").select(F.col("at").alias("d"), "style", "features.*")


def benchmark_features(benchmark: DataFrame, window: int = 20) -> DataFrame:
    """(d, benchmark_volatility, benchmark_return) over the last sessions; one series, calendar-sized."""
    order = Window.orderBy("d")
    recent = order.rowsBetween(-(window - 1), 0)
    rows = benchmark.select("d", (F.col("value") / F.lag("value").over(order) - 1).alias("_r"))
    return rows.select("d", F.stddev_pop("_r").over(recent).alias("benchmark_volatility"),
                       F.when(F.count("_r").over(recent) > 0, compounded(F.col("_r"), recent) - 1).alias("benchmark_return"))


def horizon_labels(returns: DataFrame, horizon: int, styles: Sequence[str]) -> DataFrame:
    """(d, style, target, label_exit_date): compound return of the next ``horizon`` dates.

    Dates without all returns of all styles in the window are left out.
    """
    calendar = returns.select("d").distinct().withColumn("idx", F.row_number().over(Window.orderBy("d")))
    rows = returns.join(calendar_broadcast(calendar), "d")
    ahead = Window.partitionBy("style").orderBy("idx").rangeBetween(0, horizon - 1)
    spans = rows.select("d", "style", (compounded(F.col("style_return"), ahead) - 1).alias("target"),
                        F.count("style_return").over(ahead).alias("_n"),
                        F.max("style_exit_date").over(ahead).alias("_exit"))
    whole = spans.where(F.col("_n") == horizon).groupBy("d").agg(F.count(F.lit(1)).alias("_styles"),
                                                                F.max("_exit").alias("label_exit_date"))
    complete = whole.where(F.col("_styles") == len(styles)).drop("_styles")
    return spans.where(F.col("_n") == horizon).join(calendar_broadcast(complete), "d").select(
        "d", "style", "target", "label_exit_date")


def winners(targets: DataFrame) -> DataFrame:
    """(d, best_style, winner_margin, label_exit_date); a date has one row per style."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("target")).alias("loss"), F.col("style").alias("style"))))
    ranked = targets.groupBy("d").agg(ordered.alias("o"), F.first("label_exit_date").alias("label_exit_date"))
    first, second = F.get(F.col("o"), F.lit(0)), F.get(F.col("o"), F.lit(1))
    return ranked.select("d", first["style"].alias("best_style"), (second["loss"] - first["loss"]).alias("winner_margin"),
                         "label_exit_date")


def market_state(benchmark: DataFrame, window: int = 252) -> DataFrame:
    """(d, volatility_percentile, trend_strength): today's volatility among the last ones; return per unit of volatility."""
    rows = benchmark_features(benchmark)
    vol = F.col("benchmark_volatility")
    past = F.collect_list(vol).over(Window.orderBy("d").rowsBetween(-(window - 1), 0))  # at most ``window`` values
    known = rows.where(vol.isNotNull()).withColumn("_past", past)
    share = F.size(F.filter("_past", lambda v: v <= F.col("benchmark_volatility"))) / F.size("_past")
    trend = F.abs(F.coalesce("benchmark_return", F.lit(0.0))) / F.greatest(vol * F.sqrt(F.lit(20.0)), F.lit(1e-6))
    return known.select("d", share.alias("volatility_percentile"), trend.alias("trend_strength"))


def rolling_reliability(history: DataFrame, dates: DataFrame, window: int, by: Sequence[str] = ()) -> DataFrame:
    """As of each date: mean, ICIR and count of the last ``window`` ICs whose label was realised before it.

    ``history`` has (by, d, rank_ic, label_exit_date), one row per date; ``dates`` has (by, d).
    """
    known = history.where(F.col("rank_ic").isNotNull())
    recent = Window.partitionBy(*by).orderBy("d").rowsBetween(-(window - 1), 0)
    std = F.stddev_samp("rank_ic").over(recent)
    rolled = known.select(*by, F.col("label_exit_date").alias("at"), F.lit(1).alias("kind"), F.col("d").alias("source"), F.struct(
        F.avg("rank_ic").over(recent).alias("rolling_ic"),
        F.coalesce(F.when(std > 1e-12, F.avg("rank_ic").over(recent) / std), F.lit(0.0)).alias("rolling_icir"),
        F.count("rank_ic").over(recent).alias("observations"),
        F.col("label_exit_date").alias("information_date")).alias("f"))
    wanted = dates.select(*by, F.col("d").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("date").alias("source"),
                          F.lit(None).cast(rolled.schema["f"].dataType).alias("f"))
    upto = Window.partitionBy(*by).orderBy("at", "kind", "source").rowsBetween(Window.unboundedPreceding, 0)
    looked = rolled.unionByName(wanted).withColumn("f", F.last("f", ignorenulls=True).over(upto)).where("kind = 0")
    return looked.select(*by, F.col("at").alias("d"), "f.rolling_ic", "f.rolling_icir",
                         F.coalesce("f.observations", F.lit(0)).alias("observations"), "f.information_date")


def reliability(rolled: Column | str, observations: Column | str, prior: float, window: int) -> Column:
    """Rolling ICIR floored at 0; the prior until enough ICs are realised."""
    enough = F.col(observations) >= min(10, window) if isinstance(observations, str) else observations >= min(10, window)
    value = F.col(rolled) if isinstance(rolled, str) else rolled
    return F.when(enough, F.greatest(value, F.lit(0.0))).otherwise(F.lit(max(float(prior), 0.0)))


def horizon_weights(rows: DataFrame, prior_short: float = 0.0, prior_medium: float = 0.0, window: int = 60) -> DataFrame:
    """Weights of two forecast horizons from reliability and market state; ``risk_off`` where neither is reliable.

    ``rows``: d, icir_5, n_5, icir_20, n_20, volatility_percentile, trend_strength.
    """
    quick = 0.5 + F.coalesce("volatility_percentile", F.lit(0.5))
    slow = 0.5 + F.least(F.coalesce("trend_strength", F.lit(0.0)), F.lit(1.5))
    a = reliability("icir_5", "n_5", prior_short, window) * quick
    b = reliability("icir_20", "n_20", prior_medium, window) * slow
    off = a + b <= 1e-12
    fall_a, fall_b = F.lit(max(prior_short, 0.0)) * quick, F.lit(max(prior_medium, 0.0)) * slow
    none = fall_a + fall_b <= 1e-12
    # with no reliable horizon and no positive prior both sides carry the full weight
    short = F.when(~off, a / (a + b)).when(none, 1.0).otherwise(fall_a / (fall_a + fall_b))
    medium = F.when(~off, b / (a + b)).when(none, 1.0).otherwise(fall_b / (fall_a + fall_b))
    return rows.select("d", short.alias("weight_5"), medium.alias("weight_20"), off.alias("risk_off"))


def confidence_gate(predictions: DataFrame, daily: DataFrame, structure: DataFrame, window: int, threshold: float = 0.0,
                    explained_floor: float = 0.85, alignment_floor: float = 0.80) -> tuple[DataFrame, DataFrame]:
    """Trade, hold or liquidate per (pool, d), from realised rank IC and the quarter's component quality.

    ``daily``: (pool, d, rank_ic, label_exit_date). ``structure``: (pool, quarter, explained, alignment,
    validation_ic), one row per quarter. Returns (gated predictions, audit per date).
    """
    ok = (F.col("explained") >= explained_floor - 1e-12) & (F.col("alignment") >= alignment_floor)
    order = Window.partitionBy("pool").orderBy("quarter")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    run = structure.withColumn("structural_ok", ok).withColumn("_run", F.sum(F.col("structural_ok").cast("int")).over(upto))
    failed = F.sum((~F.col("structural_ok")).cast("int")).over(Window.partitionBy("pool", "_run").orderBy("quarter"))
    quarters = run.withColumn("structural_failures", failed).drop("_run")

    # last ``window`` realised ICs and the ``window`` before them
    known = daily.where(F.col("rank_ic").isNotNull())
    seen = Window.partitionBy("pool").orderBy("d")
    new, old = seen.rowsBetween(-(window - 1), 0), seen.rowsBetween(-(2 * window - 1), -window)
    rolled = known.select("pool", F.col("label_exit_date").alias("at"), F.lit(1).alias("kind"), F.col("d").alias("source"), F.struct(
        F.avg("rank_ic").over(new).alias("recent"), F.count("rank_ic").over(new).alias("n"),
        F.avg("rank_ic").over(old).alias("earlier"), F.count("rank_ic").over(old).alias("n_old")).alias("f"))
    dates = predictions.select("pool", "d").distinct()
    wanted = dates.select("pool", F.col("d").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("date").alias("source"),
                          F.lit(None).cast(rolled.schema["f"].dataType).alias("f"))
    asof = Window.partitionBy("pool").orderBy("at", "kind", "source").rowsBetween(Window.unboundedPreceding, 0)
    looked = (rolled.unionByName(wanted).withColumn("f", F.last("f", ignorenulls=True).over(asof)).where("kind = 0")
              .select("pool", F.col("at").alias("d"), "f.*", quarter_name(F.col("at")).alias("quarter"))
              .join(quarters, ["pool", "quarter"]))
    rolling = F.when(F.col("n") >= min(10, window), F.col("recent"))
    confidence = F.coalesce(rolling, F.col("validation_ic"))
    predictive = F.coalesce(confidence > threshold, F.lit(True))
    two_bad = ((F.col("n") == window) & (F.col("n_old") == window) & (F.col("recent") <= threshold)
               & (F.col("earlier") <= threshold))
    risk_off = (F.col("structural_failures") >= 2) | F.coalesce(two_bad, F.lit(False))
    audit = looked.select("pool", "d", "quarter", "structural_ok", "structural_failures",
                          F.coalesce("n", F.lit(0)).alias("available"), confidence.alias("confidence"),
                          risk_off.alias("risk_off"), (F.col("structural_ok") & predictive).alias("_go"))
    mode = F.when(F.col("risk_off"), "risk_off_liquidate").when(F.col("_go"), "normal").otherwise("hold")
    audit = audit.withColumns({"mode": mode, "trade_enabled": F.col("risk_off") | F.col("_go")}).drop("_go")
    gate = audit.select("pool", "d", "mode", "trade_enabled")
    gated = predictions.join(calendar_broadcast(gate), ["pool", "d"]).withColumns({
        "trade_prediction": F.when(F.col("mode") == "normal", F.col("prediction")), "retain": F.col("mode") == "hold"})
    return gated, audit


