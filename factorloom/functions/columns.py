"""Scalar column functions: codes, dates, prices, fees, weights."""

from __future__ import annotations

import math
from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Column aliases by role, excluded feature columns, look-ahead name patterns.
DATE_ALIASES = ("date", "factor_date", "TradingDate", "trade_date")
SYMBOL_ALIASES = ("symbol", "ticker", "Stkcd", "ts_code")
FEATURE_EXCLUDED = ("factor_date", "symbol", "label", "label_entry_date", "label_exit_date", "r_shift")
LOOKAHEAD_PATTERNS = ("future", "forward", "lead", "next_", "t+1", "t+2", "未来")
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")

# Fee schedule, limits by board, board lots.
COMMISSION_RATE = 0.0003
TRANSFER_RATE = 0.00001
MINIMUM_COMMISSION = 5.0
STAMP_BEFORE = 0.001
STAMP_FROM = 0.0005
STAMP_CUTOVER = "2023-08-28"
TRADING_DAYS = 252
CALENDAR_DAYS = 365.25

# Exposure optimiser.
QP_LOOKBACK = 60
QP_MIN_OBSERVATIONS = 10
QP_MIN_EXPOSURE = 0.30
QP_RISK_AVERSION = 4.0
QP_TURNOVER_PENALTY = 0.0025
QP_RETURN_REWARD = 1.0
QP_MAX_STEP = 0.10
QP_DRAWDOWN_TRIGGER = 0.20


def strip_float_tail(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def normal_symbol(c: Column) -> Column:
    """Six-character code; longer codes stay whole (lpad alone would cut them)."""
    text = strip_float_tail(c)
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def parse_date(c: Column) -> Column:
    """yyyyMMdd first, then any form a date cast reads, else null."""
    text = strip_float_tail(c)
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))
    return F.coalesce(compact, text.try_cast("date"))


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & ~is_infinite(c), c)


def clip(c: Column, low: float | Column, high: float | Column) -> Column:
    """Clip that keeps null (least/greatest skip nulls)."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def alias_of(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    present = set(columns)
    return next((name for name in aliases if name in present), None)


def with_roles(df: DataFrame, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """Rename whatever date and symbol columns the source has to the given names."""
    found = {alias_of(df.columns, DATE_ALIASES): date, alias_of(df.columns, SYMBOL_ALIASES): symbol}
    if None in found:
        raise ValueError("source has no date or no symbol column")
    return df.withColumnsRenamed(found)


def feature_columns(df: DataFrame, excluded: tuple[str, ...] = FEATURE_EXCLUDED) -> list[str]:
    return [name for name, kind in df.dtypes if kind in NUMERIC_TYPES and name not in excluded]


def reject_lookahead(features: list[str]) -> list[str]:
    bad = [f for f in features if any(p in f.lower() for p in LOOKAHEAD_PATTERNS)]
    if bad:
        raise ValueError(f"columns look like future information: {bad}")
    return features


def real_price(adjusted: Column, adj: Column) -> Column:
    return F.when(adj > 0, adjusted / adj)


def lot_size(symbol: Column) -> Column:
    return F.when(symbol.startswith("688"), 200).otherwise(100)


def lot_shares(shares: Column, symbol: Column) -> Column:
    return F.floor(shares / lot_size(symbol)) * lot_size(symbol)


def price_limit(symbol: Column) -> Column:
    return F.when(symbol.startswith("300") | symbol.startswith("688"), 0.20).otherwise(0.10)


def transaction_fee(date: Column, side: Column, gross: Column, *, commission: float = COMMISSION_RATE,
                    transfer: float = TRANSFER_RATE, minimum: float = MINIMUM_COMMISSION,
                    stamp_before: float = STAMP_BEFORE, stamp_from: float = STAMP_FROM,
                    cutover: str = STAMP_CUTOVER, flat_rate: float | None = None) -> Column:
    if flat_rate is not None:
        return gross * flat_rate
    fee = F.greatest(gross * commission, F.lit(minimum)) if commission > 0 else F.lit(0.0)
    stamp_rate = F.when(date >= F.lit(cutover).cast("date"), stamp_from).otherwise(stamp_before)
    stamp = F.when(side == "SELL", gross * stamp_rate).otherwise(0.0)
    return fee + gross * transfer + stamp


def tradeable(price: Column, previous_close: Column, symbol: Column, st: Column, side: str,
              enforce_limits: bool = True) -> Column:
    ok = price.isNotNull() & ~F.isnan(price)
    if side == "buy":
        ok = ok & ~F.coalesce(st, F.lit(False))
    if enforce_limits:
        limit = price_limit(symbol)
        change = F.when(previous_close > 0, price / previous_close - 1)
        hit = (change >= limit - 1e-6) | (change <= -limit + 1e-6)
        ok = ok & ~F.coalesce(hit, F.lit(False))
    return ok


def age_weight(age_days: Column, halflife: float = TRADING_DAYS) -> Column:
    """Exponential decay; age in calendar days is turned into trading days."""
    return F.exp(-F.log(F.lit(2.0)) * (age_days / CALENDAR_DAYS * TRADING_DAYS) / halflife)


def selection_score(rank_ic: Column, pearson: Column, spread: Column) -> Column:
    return 0.40 * finite(rank_ic) + 0.20 * finite(pearson) + 0.40 * F.tanh(finite(spread) * 5.0)


def period_key(date: Column, frequency: str) -> Column:
    unit = {"weekly": "week", "monthly": "month", "quarterly": "quarter"}.get(frequency)
    return date if unit is None else F.trunc(date, unit)


def quarter_name(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def qp_exposure(mean: Column, downside: Column, drawdown: Column, previous: Column, risk_off: Column,
                observations: Column, trigger: float = QP_DRAWDOWN_TRIGGER,
                min_observations: int = QP_MIN_OBSERVATIONS, min_exposure: float = QP_MIN_EXPOSURE,
                risk: float = QP_RISK_AVERSION, penalty: float = QP_TURNOVER_PENALTY,
                reward: float = QP_RETURN_REWARD, step: float = QP_MAX_STEP) -> tuple[Column, Column, Column]:
    """Minimiser of a one-dimensional quadratic in the exposure, then box and step limits.

    Returns (risk multiplier, unconstrained exposure, target exposure); a warm-up row
    keeps the previous exposure.
    """
    before = clip(previous, min_exposure, 1.0)
    warm = observations < min_observations
    excess = F.greatest(-drawdown, F.lit(0.0)) / trigger
    multiplier = 1.0 + 4.0 * excess * excess + F.when(risk_off, 2.0).otherwise(0.0)
    curvature = risk * multiplier * F.greatest(downside, F.lit(1e-12)) + penalty
    slope = reward * F.greatest(mean, F.lit(0.0)) + penalty * before
    free = F.when(warm, before).otherwise(slope / curvature)
    low = F.greatest(F.lit(min_exposure), before - step)
    high = F.least(F.lit(1.0), before + step)
    return (F.when(warm, 1.0).otherwise(multiplier), free,
            F.when(warm, before).otherwise(F.least(F.greatest(free, low), high)))


class OverlayState:
    """One series' overlay, a row at a time: what ``qp_exposure`` gives from the trailing overlay returns, their downside
    and the drawdown of the overlaid path."""

    def __init__(self, lookback: int = QP_LOOKBACK):
        self.nav = self.peak = self.exposure = 1.0
        self.recent: deque[float] = deque(maxlen=lookback)

    def step(self, ret: float, risk_off: bool) -> tuple[float, float, float]:
        """(exposure, overlay return, nav) of the next row."""
        before = min(max(self.exposure, QP_MIN_EXPOSURE), 1.0)
        n = len(self.recent)
        if n < QP_MIN_OBSERVATIONS:
            target = before
        else:
            down = math.fsum(min(x, 0.0) ** 2 for x in self.recent) / n
            excess = max(1 - self.nav / self.peak, 0.0) / QP_DRAWDOWN_TRIGGER
            curvature = QP_RISK_AVERSION * (1 + 4 * excess * excess + 2 * risk_off) * max(down, 1e-12) + QP_TURNOVER_PENALTY
            free = (QP_RETURN_REWARD * max(math.fsum(self.recent) / n, 0.0) + QP_TURNOVER_PENALTY * before) / curvature
            target = min(max(free, QP_MIN_EXPOSURE, before - QP_MAX_STEP), 1.0, before + QP_MAX_STEP)
        gained = target * ret
        self.nav *= 1 + gained
        self.peak, self.exposure = max(self.peak, self.nav), target
        self.recent.append(gained)
        return target, gained, self.nav


def any_not_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round every floating column, for printing and comparing."""
    return df.select([F.round(F.col(n).cast("double"), digits).alias(n) if k in ("double", "float")
                      else F.col(n) for n, k in df.dtypes])
