"""Point-in-time joins of signals, sessions, labels, pools and industries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from factorloom.operators.calendar import calendar_broadcast, holding_dates, session_before, sessions, with_index
from factorloom.operators.series import at_offset, last_known_many


def require_unique(df: DataFrame, keys: tuple[str, ...] = ("d", "symbol")) -> DataFrame:
    """Rows of ``df`` guarded so that a repeated key fails the job instead of fanning out a join."""
    seen = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), F.first(F.struct(*df.columns)).alias("_row"))
    checked = F.when(F.col("_copies") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit("repeated key "), F.to_json(F.struct(*keys)))))
    return seen.select(checked.alias("_row")).select("_row.*")


def duplicate_keys(df: DataFrame, keys: tuple[str, ...] = ("d", "symbol")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def labels(prices: DataFrame, keys: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Return from the session after a signal to the session after the next signal, per (d, symbol) of ``keys``.

    Here and below ``calendar`` saves taking the sessions from the prices again.
    """
    cal = sessions(prices) if calendar is None else calendar
    spans = holding_dates(keys, cal)
    priced = with_index(prices.select("d", "symbol", "price"), cal)
    buy = priced.select(F.col("idx").alias("entry_idx"), "symbol", F.col("price").alias("_buy"))
    sell = priced.select(F.col("idx").alias("exit_idx"), "symbol", F.col("price").alias("_sell"))
    return (keys.select("d", "symbol").join(calendar_broadcast(spans), "d")
            .join(buy, ["entry_idx", "symbol"], "left").join(sell, ["exit_idx", "symbol"], "left")
            .select("d", "symbol", (F.try_divide("_sell", "_buy") - 1).alias("label"),
                    "label_entry_date", "label_exit_date"))


def dataset(factors: DataFrame, label_table: DataFrame) -> DataFrame:
    """Factors with their labels; rows without a label stay."""
    return factors.join(label_table, ["d", "symbol"], "left")


def signals_on_sessions(signals: DataFrame, calendar: DataFrame, value: str) -> DataFrame:
    """Signals moved back to the latest session; of several on one session the last non-null wins."""
    mapped = session_before(signals, calendar).where("pos > 0")
    sess = calendar.select(F.col("idx").alias("pos"), F.col("d").alias("session"))
    placed = signals.join(calendar_broadcast(mapped.join(sess, "pos").drop("pos")), "d")
    kept = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("d")))
    return placed.groupBy("session", "symbol").agg(kept.alias(value)).withColumnRenamed("session", "d")


def forward_by_signal(signals: DataFrame, prices: DataFrame, horizons: tuple[int, ...],
                      calendar: DataFrame | None = None) -> DataFrame:
    """(d, symbol, horizon, forward_return): first session after d in, h sessions later out.

    Returns are worked out once per (symbol, entry session) for all horizons, then joined to the signals.
    """
    cal = sessions(prices) if calendar is None else calendar
    priced = with_index(prices.select("d", "symbol", "price"), cal)
    stacked = ", ".join(f"{h}, r{h}" for h in horizons)
    returns = (priced.select("symbol", F.col("idx").alias("entry_idx"),
                             *[(F.try_divide(at_offset("price", h), F.col("price")) - 1).alias(f"r{h}")
                               for h in horizons]))
    mapped = session_before(signals, cal).select("d", (F.col("pos") + 1).alias("entry_idx"))
    return (signals.select("d", "symbol").join(calendar_broadcast(mapped), "d")
            .join(returns, ["symbol", "entry_idx"], "left")
            .selectExpr("d", "symbol", f"stack({len(horizons)}, {stacked}) AS (horizon, forward_return)"))


def carried_to_sessions(signals: DataFrame, prices: DataFrame, value: str, calendar: DataFrame | None = None) -> DataFrame:
    """Signals entered on the next session and carried on, on every session a symbol is priced."""
    cal = sessions(prices) if calendar is None else calendar
    mapped = session_before(signals, cal).select("d", (F.col("pos") + 1).alias("idx"))
    entered = (signals.join(calendar_broadcast(mapped), "d").groupBy("idx", "symbol")
               .agg(F.max_by(value, "d").alias(value)))
    rows = with_index(prices.select("d", "symbol"), cal)
    marks = (rows.select("idx", "d", "symbol", F.lit(True).alias("priced"))
             .join(entered, ["idx", "symbol"], "full"))
    upto = Window.partitionBy("symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return (marks.withColumn(value, F.last(value, ignorenulls=True).over(upto))
            .where(F.col("priced") & F.col(value).isNotNull()).select("d", "symbol", value))


def with_industry(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Static mapping by symbol, or dated mapping as of the row's date; never a later value."""
    if "d" not in mapping.columns:
        return rows.join(mapping, "symbol", "left")
    known = last_known_many(mapping, rows, "industry")
    return rows.join(known, ["d", "symbol"], "left")


def eligibility(signals: DataFrame, calendar: DataFrame, value: str) -> DataFrame:
    """(d, symbol) eligible on each session: the universe of the latest date that has any signal.

    Each signal date covers a run of sessions; the runs are date-sized and broadcast.
    """
    live = signals.where(F.col(value).isNotNull()).select("d", "symbol")
    spans = (session_before(calendar, live.select("d").distinct().withColumn(
        "idx", F.row_number().over(Window.orderBy("d")))).where("pos > 0"))
    numbered = live.select("d").distinct().withColumn("pos", F.row_number().over(Window.orderBy("d")))
    cover = spans.withColumnRenamed("d", "session").join(numbered, "pos").select("session", "d")
    return live.join(calendar_broadcast(cover), "d").select(F.col("session").alias("d"), "symbol")


def in_pool(rows: DataFrame, pool: DataFrame | None) -> DataFrame:
    """Rows whose (d, symbol) is a member; no pool keeps every row."""
    return rows if pool is None else rows.join(pool.where("member").select("d", "symbol"), ["d", "symbol"], "left_semi")


def common_keys(tables: list[DataFrame], minimum_dates: int = 2, minimum_symbols: int = 1
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dates in all tables, symbols in all tables, one coverage row)."""
    dates, symbols = tables[0].select("d").distinct(), tables[0].select("symbol").distinct()
    for other in tables[1:]:
        dates = dates.intersect(other.select("d"))
        symbols = symbols.intersect(other.select("symbol"))
    one = F.lit(1)
    counts = (dates.select(one.alias("dates"), F.lit(0).alias("symbols"))
              .unionAll(symbols.select(F.lit(0).alias("dates"), one.alias("symbols")))
              .agg(F.sum("dates").alias("dates"), F.sum("symbols").alias("symbols")))
    ok = (F.col("dates") >= minimum_dates) & (F.col("symbols") >= minimum_symbols)
    return dates, symbols, counts.withColumn("enough", ok)


def _reach(dates: DataFrame, marks: DataFrame, ahead: bool, inclusive: bool) -> DataFrame:
    """For each date ``x``: the least ``idx`` of the marks (x, idx) after it (``ahead``), or the greatest before it.

    One window over a calendar and the splits' dates; ``idx`` grows with the marks.
    """
    first = 0 if inclusive else 1
    both = (dates.where("x IS NOT NULL").select("x", F.lit(1 - first).alias("_own"), F.lit(None).cast("int").alias("idx"))
            .unionByName(marks.select("x", F.lit(first).alias("_own"), F.col("idx").cast("int"))))
    way = F.col("x").desc() if ahead else F.col("x").asc()
    seen = Window.orderBy(way, "_own").rowsBetween(Window.unboundedPreceding, 0)
    best = F.min("idx").over(seen) if ahead else F.max("idx").over(seen)
    return both.withColumn("_idx", best).where(F.col("_own") == 1 - first).select("x", F.col("_idx").alias("idx"))


def in_training(rows: DataFrame, splits: DataFrame, start: str, mode: str = "expanding", years: int = 4,
                strict: bool = False) -> DataFrame:
    """``rows`` once per split they may train: dated from the split's start on, label realised by its cutoff.

    Splits are numbered by cutoff, so the splits of a row are a range: the first from its label's exit, the last from its
    date. Both ends are looked up by date, and the splits join by number.
    """
    numbered = splits.withColumn("idx", F.row_number().over(Window.orderBy("train_cutoff", "name")))
    exits = _reach(rows.select(F.col("label_exit_date").alias("x")).distinct(),
                   numbered.select(F.col("train_cutoff").alias("x"), "idx"), ahead=True, inclusive=not strict)
    lower = F.date_add(F.add_months(F.col("train_cutoff"), -12 * years), 1) if mode == "fixed" else F.lit(start).cast("date")
    ends = _reach(rows.select(F.col("d").alias("x")).distinct(), numbered.select(lower.alias("x"), "idx"), ahead=False, inclusive=True)
    ends = calendar_broadcast(ends.where("idx IS NOT NULL").select(F.col("x").alias("d"), F.col("idx").alias("_last")))
    exits = exits.where("idx IS NOT NULL").select(F.col("x").alias("label_exit_date"), F.col("idx").alias("_first"))
    placed = rows.join(ends, "d").join(F.broadcast(exits), "label_exit_date").where("_first <= _last")
    return (placed.withColumn("idx", F.explode(F.sequence("_first", "_last"))).join(F.broadcast(numbered), "idx")
            .select(*rows.columns, *splits.columns))


def training_rows(data: DataFrame, splits: DataFrame, start: str, mode: str = "expanding", years: int = 4,
                  strict: bool = False) -> DataFrame:
    """Rows usable by each split: label realised by the cutoff. ``splits`` is one row per refit."""
    labelled = data.where(F.col("label").isNotNull() & F.col("label_exit_date").isNotNull())
    return in_training(labelled, splits, start, mode, years, strict)


def prediction_rows(data: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows dated inside a split's prediction span; spans do not overlap, so a date has one split at most."""
    numbered = splits.withColumn("idx", F.row_number().over(Window.orderBy("prediction_start")))
    days = _reach(data.select(F.col("d").alias("x")).distinct(), numbered.select(F.col("prediction_start").alias("x"), "idx"),
                  ahead=False, inclusive=True)
    days = (days.where("idx IS NOT NULL").join(F.broadcast(numbered), "idx").where(F.col("x") <= F.col("prediction_end"))
            .select(F.col("x").alias("d"), *splits.columns))
    return data.join(calendar_broadcast(days), "d").select(*data.columns, *splits.columns)
