"""Audit and summary rows over panels, ledgers and event tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from factorloom.functions.columns import is_infinite, transaction_fee
from factorloom.operators import ic
from factorloom.operators.calendar import calendar_broadcast
from factorloom.operators.series import last_known_many


def items(row: DataFrame, names: Sequence[str], key: str = "item") -> DataFrame:
    """One-row frame to (item, value) rows."""
    return row.select(*[F.col(n).cast("double") for n in names]).unpivot([], list(names), key, "value")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def quality_report(factors: DataFrame, features: Sequence[str], prices: DataFrame) -> DataFrame:
    """Rows, features, missing cells, duplicates, shared dates and symbols, share of absent prices."""
    per_key = factors.groupBy("d", "symbol").agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum(sum(F.col(f).isNull().cast("int") for f in features)).alias("gaps"))
    panel = per_key.agg(F.sum("copies").alias("factor_rows"), F.lit(len(features)).alias("feature_count"),
                        F.sum("gaps").alias("missing_cells"), F.sum(F.col("copies") - 1).alias("duplicate_rows"))
    shared = [items(factors.select(k).intersect(prices.select(k)).agg(F.count(F.lit(1)).alias(name)), [name])
              for k, name in (("d", "common_dates"), ("symbol", "common_symbols"))]
    grid = prices.agg(F.countDistinct("d").alias("a"), F.countDistinct("symbol").alias("b"), F.count("price").alias("c"))
    absent = items(grid.select((1 - F.try_divide(F.col("c"), F.col("a") * F.col("b"))).alias("price_missing_rate")),
                   ["price_missing_rate"])
    return union_all([items(panel, ["factor_rows", "feature_count", "missing_cells", "duplicate_rows"]), *shared, absent])


def pool_coverage(member_rows: DataFrame, prediction: str, slices: int | None = None) -> DataFrame:
    """Names with score and label per member, averaged over dates; share of dates with positive rank IC."""
    members = member_rows.groupBy("d").agg(F.count(F.lit(1)).alias("members"))
    daily = ic.daily_ic(member_rows, ("d",), prediction, slices=slices).join(calendar_broadcast(members), "d")
    return daily.agg(F.avg("stock_count").alias("average_stock_count"),
                     F.avg(F.col("stock_count") / F.col("members")).alias("signal_coverage"),
                     ic.ratio_above("rank_ic").alias("positive_ratio"))


def ledger_totals(ledger: DataFrame, **fee_options) -> DataFrame:
    """Fees, turnover against the mean daily gross, trades, and what the fees cost, from one pass over the orders."""
    fee = transaction_fee(F.col("d"), F.col("side"), F.col("gross"), **fee_options)
    signed = F.when(F.col("side") == "SELL", F.col("gross")).otherwise(-F.col("gross"))
    daily = ledger.groupBy("d").agg(F.sum("gross").alias("gross"), F.sum(fee).alias("fee"), F.sum(signed).alias("cash"),
                                    F.count(F.lit(1)).alias("trades"))
    return daily.agg(F.sum("fee").alias("total_fees"), (F.sum("gross") / F.avg("gross")).alias("turnover"),
                     F.sum("trades").alias("trade_count"), F.sum("cash").alias("no_fee_cash"),
                     F.sum(F.col("cash") - F.col("fee")).alias("net_cash"))


def risk_event_summary(events: DataFrame) -> DataFrame:
    exposure = F.col("target_exposure")
    return events.agg(F.count(F.when(F.col("scheduled_rebalance"), 1)).alias("scheduled_rebalance_days"),
                      F.count(F.when(~F.col("trade_enabled"), 1)).alias("risk_paused_days"),
                      F.count(F.when(exposure < 0.999, 1)).alias("adjustment_days"),
                      F.avg(exposure).alias("average_target_exposure"), F.min(exposure).alias("minimum_target_exposure"))


def daily_flag(rows: DataFrame, flag: str) -> DataFrame:
    """One flag per date; a date that carries both values fails the job."""
    low, high = F.min(flag), F.max(flag)
    clash = F.raise_error(F.concat(F.lit(f"conflicting {flag} on "), F.first("d").cast("string"))).cast("boolean")
    mixed = (low != high) | (F.count(flag).between(1, F.count(F.lit(1)) - 1))
    return rows.groupBy("d").agg(F.when(mixed, clash).otherwise(F.coalesce(high, F.lit(False))).alias(flag))


def mark_to_market(book: DataFrame, closes: DataFrame) -> DataFrame:
    """Value per date at the last valid close at or before it, else at cost. ``book``: d, symbol, shares, avg_cost."""
    valued = book.join(last_known_many(closes, book, "close"), ["d", "symbol"])
    price = F.coalesce("close", "avg_cost")
    return valued.groupBy("d").agg(F.sum(F.col("shares") * price).alias("value"),
                                   F.count(F.when(F.col("close").isNull(), 1)).alias("at_cost"))


def consistency(curve: DataFrame, account: DataFrame, calendar: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(check, value, passed) rows for a portfolio.

    ``curve``: d, nav, gross_nav, turnover. ``account``: d, asset. ``benchmark``: d, value. All are keyed by date.
    The curve must be the account scaled to one, on the account's dates, from the calendar's first session on; the
    first trade must follow the first signal by one session; without fees it must not end lower. The largest moves are
    reported, and fail only if they are no numbers.
    """
    order = Window.orderBy("d")
    both = (curve.select("d", "nav", "gross_nav", "turnover").join(account.select("d", "asset"), "d", "full")
            .join(calendar.select("d", "idx"), "d", "left"))
    paths = both.select("*", (F.col("nav") / F.first("nav", True).over(order)).alias("_curve"),
                        (F.col("asset") / F.first("asset", True).over(order)).alias("_account"),
                        F.abs(F.col("nav") / F.lag("nav").over(order) - 1).alias("_move"))
    number = lambda c: c.isNotNull() & ~F.isnan(c) & ~is_infinite(c)
    facts = paths.agg(
        F.count(F.when(F.col("asset").isNotNull() & ~number(F.col("asset")), 1)).cast("double").alias("nonfinite_assets"),
        F.max(F.abs(F.col("_curve") - F.col("_account"))).alias("curve_matches_account"),
        F.count(F.when(F.col("nav").isNull() | F.col("asset").isNull(), 1)).cast("double").alias("dates_in_one_only"),
        F.min(F.when(F.col("nav").isNotNull(), F.col("idx"))).cast("double").alias("first_date_kept"),
        F.min(F.when(F.col("turnover") > 0, F.col("idx"))).cast("double").alias("first_trade_session"),
        (F.max_by("gross_nav", "d") - F.max_by("nav", "d")).alias("no_fee_not_below_net"),
        F.max("_move").alias("max_abs_move"))
    tests = {"nonfinite_assets": F.col("nonfinite_assets") == 0, "curve_matches_account": F.col("curve_matches_account") <= 1e-8,
             "dates_in_one_only": F.col("dates_in_one_only") == 0, "first_date_kept": F.col("first_date_kept") == 1,
             "first_trade_session": F.col("first_trade_session") == 2, "no_fee_not_below_net": F.col("no_fee_not_below_net") >= 0,
             "max_abs_move": number(F.col("max_abs_move"))}
    rows = facts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("value"), F.coalesce(t, F.lit(False)).alias("passed"))
                                            for k, t in tests.items()])).alias("c")).select("c.*")
    moves = benchmark.select(F.abs(F.col("value") / F.lag("value").over(order) - 1).alias("m")).agg(F.max("m").alias("value"))
    return rows.unionByName(moves.select(F.lit("max_abs_benchmark_move").alias("check"), "value", number(F.col("value")).alias("passed")))

