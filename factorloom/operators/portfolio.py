"""Layered portfolios, drifting target weights, costs and performance, as windows and joins."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from factorloom.functions import columns as c
from factorloom.functions.columns import period_key
from factorloom.operators import ic
from factorloom.operators.calendar import calendar_broadcast, session_before, sessions, with_index
from factorloom.operators.ranking import add_rank, bucket
from factorloom.operators.selection import top_n, weights
from factorloom.operators.series import at_offset, compounded, running
from factorloom.session import materialise

RISK_FREE = 0.02
METRICS = ("annual_return", "annual_volatility", "sharpe", "max_drawdown", "calmar", "win_rate", "profit_loss_ratio",
           "underwater_ratio")


def performance(returns: DataFrame, by: Sequence[str] = (), ret: str = "ret", periods: Column | float = 252.0,
                risk_free: float = RISK_FREE, active: Column | None = None) -> DataFrame:
    """Eight figures per series. A series holds one return per date."""
    value = F.col(ret)
    rows = returns.withColumn(ret, c.finite(value)).where(value.isNotNull())
    path = running(by, "d")
    rows = rows.withColumn("_nav", compounded(value, path)).withColumn("_dd", F.col("_nav") / F.max("_nav").over(path) - 1)
    periods = F.lit(float(periods)) if not isinstance(periods, Column) else F.max(periods)
    years = F.greatest(F.count(value) / periods, 1 / periods)
    annual = F.pow(F.max_by("_nav", "d"), 1 / years) - 1
    spread = F.stddev_samp(value) * F.sqrt(periods)
    worst = F.min("_dd")
    gain, loss = F.avg(F.when(value > 0, value)), F.avg(F.when(value < 0, value))
    counted = value if active is None else F.when(active, value)
    flat = F.avg(F.when(counted.isNotNull(), (counted == 0).cast("double")))
    return rows.groupBy(*by).agg(
        annual.alias("annual_return"), spread.alias("annual_volatility"),
        F.when(spread > 0, (annual - risk_free) / spread).alias("sharpe"), worst.alias("max_drawdown"),
        F.when(worst < 0, annual / F.abs(worst)).alias("calmar"), ic.ratio_above(value).alias("win_rate"),
        (gain / F.abs(loss)).alias("profit_loss_ratio"), flat.alias("underwater_ratio"))


def relative_nav(asset: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(d, strategy, benchmark, excess, excess_return): both paths start at 1, excess is their ratio."""
    order = Window.orderBy("d")
    both = asset.select("d", "asset").join(benchmark.select("d", F.col("value").alias("_b")), "d")
    nav = both.select("d", (F.col("asset") / F.first("asset").over(order)).alias("strategy"),
                      (F.col("_b") / F.first("_b").over(order)).alias("benchmark"))
    nav = nav.withColumn("excess", F.col("strategy") / F.col("benchmark"))
    return nav.withColumn("excess_return", F.col("excess") / F.lag("excess").over(order) - 1)


def account_performance(asset: DataFrame, benchmark: DataFrame, annual_days: float = 252.0,
                        risk_free: float = RISK_FREE) -> DataFrame:
    """Absolute and excess figures of an account against a benchmark, long by ``side``.

    ``asset``: d, asset, holding_count. Observations per year follow from the median gap between dates.
    A non-finite value fails the job.
    """
    bad = F.raise_error(F.concat(F.lit("non-finite account value on "), F.col("d").cast("string"))).cast("double")
    checked = asset.withColumn("asset", F.coalesce(c.finite(F.col("asset")), bad))
    order = Window.orderBy("d")
    nav = relative_nav(checked, benchmark).join(calendar_broadcast(asset.select("d", "holding_count")), "d")
    steps = nav.select("d", "holding_count", F.datediff("d", F.lag("d").over(order)).cast("double").alias("gap"),
                       (F.col("strategy") / F.lag("strategy").over(order) - 1).alias("absolute"),
                       F.col("excess_return").alias("excess"))
    gap = F.median("gap").over(Window.partitionBy())  # one calendar
    periods = F.when(F.count("gap").over(Window.partitionBy()) <= 1, annual_days).when(gap >= 20, 12.0).when(gap >= 5, 52.0).otherwise(annual_days)
    long = steps.withColumn("_periods", periods).unpivot(["d", "holding_count", "_periods"], ["absolute", "excess"], "side", "ret")
    return performance(long, ("side",), periods=F.col("_periods"), risk_free=risk_free, active=F.col("holding_count") > 0)


def report_series(daily: DataFrame, nav: DataFrame) -> DataFrame:
    """Cumulative IC, mean IC of the quarter, and the quarter's return from its last value."""
    quarter = F.trunc("d", "quarter")
    order = Window.orderBy("q")
    ends = nav.groupBy(quarter.alias("q")).agg(F.max_by("value", "d").alias("v"))
    ends = ends.select("q", (F.col("v") / F.lag("v").over(order) - 1).alias("quarter_return"))
    rows = daily.select("d", quarter.alias("q"), F.sum(F.coalesce("rank_ic", F.lit(0.0))).over(
        Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_ic"),
        F.avg("rank_ic").over(Window.partitionBy(quarter)).alias("quarter_ic"))
    return rows.join(calendar_broadcast(ends, "q"), "q", "left").drop("q")


def layer_returns(rows: DataFrame, value: str, ret: str, layers: int, by: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """(by, d, layer, ret): mean return per equal-frequency layer on dates with at least ``layers`` names."""
    valid = rows.where(F.col(value).isNotNull() & F.col(ret).isNotNull())
    ranked = add_rank(valid, [*by, "d"], value, prefix="_r", slices=slices)
    return (ranked.where(F.col("_r_n") >= layers).groupBy(*by, "d", (bucket(layers, "_r") + 1).alias("layer"))
            .agg(F.avg(ret).alias("ret")))


def layer_curves(returns: DataFrame, layers: int, by: Sequence[str] = ()) -> DataFrame:
    """NAV per layer and of the top layer minus the bottom one (layer 0)."""
    spread = returns.groupBy(*by, "d").agg(
        F.lit(0).alias("layer"), F.coalesce(F.max(F.when(F.col("layer") == layers, F.col("ret")))
                                            - F.max(F.when(F.col("layer") == 1, F.col("ret"))), F.lit(0.0)).alias("ret"))
    every = returns.unionByName(spread)
    return every.withColumn("nav", compounded(F.col("ret"), running((*by, "layer"), "d")))


def layer_summary(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return returns.groupBy(*by, "layer").agg(F.avg("ret").alias("mean_return"), ic.ratio_above("ret").alias("win_rate"))


def rebalance_targets(scores: DataFrame, frequency: str, n: int, mode: str = "score", slices: int | None = None) -> DataFrame:
    """(d, symbol, weight) on the first date of each period."""
    order = Window.partitionBy("_p").orderBy("d")
    firsts = (scores.select("d").distinct().withColumn("_p", period_key(F.col("d"), frequency))
              .withColumn("_k", F.row_number().over(order)).where("_k = 1").select("d"))
    due = scores.join(calendar_broadcast(firsts), "d")
    return weights(top_n(due, n), mode, slices=slices).select("d", "symbol", "weight")


def drifting_portfolio(targets: DataFrame, returns: DataFrame, commission: float = 0.0003, stamp: float = 0.0005,
                       calendar: DataFrame | None = None) -> DataFrame:
    """Daily gross, cost, net, turnover and NAV of target weights that drift until the next rebalance.

    ``targets``: d, symbol, weight on rebalance dates. ``returns``: d, symbol, ret, where a missing return is 0.
    Within a period a weight is its target times the product of its earlier returns, renormalised each
    date, so no date waits for another; turnover compares each period's targets with the drifted weights
    at the end of the period before.
    """
    cal = sessions(returns) if calendar is None else calendar
    targets = materialise(targets)
    starts = targets.select("d").distinct().withColumn("period", F.row_number().over(Window.orderBy("d")))
    period_of = session_before(cal, starts.withColumnRenamed("period", "idx"), "period").where("period > 0")
    days = materialise(with_index(period_of, cal).select("d", "idx", "period"))
    held = targets.join(calendar_broadcast(starts), "d").select("period", "symbol", "weight")
    # every date of the period for every held name; absent returns count as 0
    grid = (held.join(F.broadcast(days), "period")
            .join(returns.select("d", "symbol", "ret"), ["d", "symbol"], "left")
            .withColumn("ret", F.coalesce("ret", F.lit(0.0))))
    before = Window.partitionBy("period", "symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    grown = grid.withColumn("grown", F.col("weight") * F.coalesce(compounded(F.col("ret"), before), F.lit(1.0)))
    grown = materialise(grown)
    per_day = grown.groupBy("period", "idx", "d").agg(F.sum("grown").alias("total"),
                                                      F.sum(F.col("grown") * F.col("ret")).alias("_earned"),
                                                      F.count(F.when(F.col("grown") > 0, 1)).alias("holding_count"))
    last = days.groupBy("period").agg(F.max("idx").alias("idx"))
    ends = (grown.join(F.broadcast(last), ["period", "idx"])
            .withColumn("_end", F.col("grown") * (1 + F.col("ret"))))
    end_total = ends.groupBy("period").agg(F.sum("_end").alias("_all"))
    carried = ends.join(F.broadcast(end_total), "period").select(
        (F.col("period") + 1).alias("period"), "symbol",
        F.when(F.col("_all") > 0, F.col("_end") / F.col("_all")).otherwise(F.col("_end")).alias("old"))
    moves = (held.join(carried.join(F.broadcast(starts.select("period")), "period", "left_semi"), ["period", "symbol"], "full")
             .withColumn("_delta", F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))
    traded = moves.groupBy("period").agg(F.sum(F.greatest("_delta", F.lit(0.0))).alias("buys"),
                                         F.sum(F.greatest(-F.col("_delta"), F.lit(0.0))).alias("sells"))
    first = days.groupBy("period").agg(F.min("idx").alias("idx"))
    charged = first.join(traded, "period").select("idx", (F.col("buys") + F.col("sells")).alias("turnover"), "sells")
    cost = F.col("turnover") * commission + F.col("sells") * stamp
    daily = (per_day.join(charged, "idx", "left")
             .select("d", F.when(F.col("total") > 0, F.col("_earned") / F.col("total")).otherwise(0.0).alias("gross_return"),
                     F.coalesce(cost, F.lit(0.0)).alias("cost"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"),
                     F.coalesce("sells", F.lit(0.0)).alias("sells"), "holding_count"))
    net = daily.withColumn("net_return", F.col("gross_return") - F.col("cost"))
    path = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return net.withColumns({"nav": compounded(F.col("net_return"), path), "gross_nav": compounded(F.col("gross_return"), path)})


def constrain(rows: DataFrame, no_trade: float, max_turnover: float, max_drawdown: float | None) -> DataFrame:
    """One-step limits on (d, symbol, target, current, drawdown): turnover scaling, drawdown throttle, no shorts.

    Small changes are dropped from the turnover and from the scaled step; where the scaling does not bind,
    the full target stands.
    """
    delta = F.col("target") - F.col("current")
    kept = rows.withColumn("_delta", F.when(F.abs(delta) < no_trade, 0.0).otherwise(delta))
    total = kept.groupBy("d").agg(F.sum(F.abs("_delta")).alias("_turnover"))
    out = kept.join(calendar_broadcast(total), "d")
    target = F.col("target")
    if max_turnover > 0:
        target = F.when(F.col("_turnover") > max_turnover,
                        F.col("current") + F.col("_delta") * (max_turnover / F.col("_turnover"))).otherwise(target)
    if max_drawdown:
        throttle = F.greatest(F.lit(0.0), 1 + F.col("drawdown") / max_drawdown)
        target = F.when(F.col("drawdown") <= -max_drawdown, target * throttle).otherwise(target)
    return out.withColumn("constrained", F.greatest(target, F.lit(0.0))).drop("_delta", "_turnover")


def equal_weight_benchmark(prices: DataFrame, eligible: DataFrame, base: float = 100.0,
                           calendar: DataFrame | None = None) -> DataFrame:
    """(d, ret, value): mean change of names that were eligible and priced on the session before."""
    cal = sessions(prices) if calendar is None else calendar
    rows = with_index(prices.select("d", "symbol", "price"), cal)
    mark = eligible.select("d", "symbol", F.lit(True).alias("eligible"))
    joined = rows.join(mark, ["d", "symbol"], "left").withColumn("_ok", F.coalesce("eligible", F.lit(False)).cast("int"))
    change = F.try_divide(F.col("price"), at_offset("price", -1)) - 1
    moved = joined.select("d", F.when(at_offset("_ok", -1) == 1, change).alias("ret"))
    daily = moved.groupBy("d").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("ret"))
    path = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("value", compounded(F.col("ret"), path) * base)


def corporate_actions(holdings: DataFrame, adj: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Held names whose adjustment factor moved since the session before, with the share ratio."""
    rows = with_index(adj, sessions(adj) if calendar is None else calendar).withColumn("old_adj", at_offset("adj", -1))
    same = F.abs(F.col("old_adj") - F.col("adj")) <= 1e-8 + 1e-5 * F.abs("adj")
    moved = rows.where((F.col("old_adj") > 0) & F.col("adj").isNotNull() & ~same)
    return moved.join(holdings.select("d", "symbol"), ["d", "symbol"], "left_semi").select(
        "d", "symbol", "old_adj", F.col("adj").alias("new_adj"), (F.col("adj") / F.col("old_adj")).alias("share_ratio"))


def closed_trades(trades: DataFrame, **fee_options) -> DataFrame:
    """Realised profit after the sell fee, and days held, per closed trade."""
    gross = F.col("shares") * F.col("sell_price")
    fee = c.transaction_fee(F.col("sell_date"), F.lit("SELL"), gross, **fee_options)
    return trades.withColumns({"pnl": (F.col("sell_price") - F.col("avg_cost")) * F.col("shares") - fee,
                               "holding_days": F.datediff("sell_date", "buy_date")})


def cost_scenarios(daily: DataFrame, scenarios: dict[str, tuple[float, float]]) -> DataFrame:
    """Net NAV of one portfolio under several (commission, stamp) pairs; ``daily`` has gross_return, turnover, sells."""
    legs = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"))
                               for n, (a, b) in scenarios.items()]))
    rows = daily.select("d", "gross_return", "turnover", "sells", legs.alias("s")).select(
        "d", "s.scenario", (F.col("gross_return") - F.col("turnover") * F.col("s.a") - F.col("sells") * F.col("s.b")).alias("ret"))
    return rows.withColumn("nav", compounded(F.col("ret"), running(("scenario",), "d")))


def exposure_overlay(returns: DataFrame, by: str, lookback: int = c.QP_LOOKBACK) -> DataFrame:
    """Scale each series by an exposure that reacts to its own past overlay returns and drawdown.

    Tomorrow's exposure depends on today's, so a task walks its series in order, batch by batch, and keeps the last
    ``lookback`` overlay returns of the series it is in: time is linear in the rows, memory does not grow with them.
    Rows: by, d, ret (missing is 0), risk_off. Returns (by, d, exposure, overlay_return, nav).
    """
    kind = returns.schema[by].dataType.simpleString()

    def walk(frames):
        series, state = None, None
        for frame in frames:
            out = []
            for key, d, ret, off in zip(frame["_by"], frame["d"], frame["ret"], frame["risk_off"]):
                if state is None or key != series:
                    series, state = key, c.OverlayState(lookback)
                out.append((key, d, *state.step(ret, bool(off))))
            yield pd.DataFrame(out, columns=["_by", "d", "exposure", "overlay_return", "nav"])

    rows = returns.select(F.col(by).alias("_by"), "d", F.coalesce(F.col("ret").cast("double"), F.lit(0.0)).alias("ret"),
                          F.coalesce("risk_off", F.lit(False)).alias("risk_off"))
    walked = rows.repartition("_by").sortWithinPartitions("_by", "d").mapInPandas(
        walk, f"_by {kind}, d date, exposure double, overlay_return double, nav double")
    return walked.withColumnRenamed("_by", by)
