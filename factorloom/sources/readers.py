"""Readers for wide matrices, factor panels, signals, closes, calendars, industries and catalogues."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factorloom.functions import columns as c

# Accepted names and flags.
INDUSTRY_SYMBOLS = ("ticker", "symbol", "code")
INDUSTRY_NAMES = ("industry", "industry_code", "sector")
INDUSTRY_DATES = ("date", "factor_date", "effective_date")
OPEN_FLAGS = ("1", "true", "t", "yes")
CATALOGUE_EXCLUDED = ("date", "ticker", "factor_date", "symbol", "TradingDate", "Stkcd", "r_shift")
FREQUENCIES = {"monthly_calc": "monthly", "daily_alpha": "daily"}
LEAD_IN_DAYS = LEAD_OUT_DAYS = 10


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV or parquet by suffix; a folder without a suffix is parquet."""
    if path.lower().split("?")[0].rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True).option("recursiveFileLookup", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def row_order() -> Column:
    """Order of a row in its folder: file, block, row. Rows of a block are read in order by one task."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def keyed(df: DataFrame, date: str, symbol: str) -> DataFrame:
    """Parse date and code into ``d`` and ``symbol``; rows without either are dropped."""
    out = df.withColumns({"_d": c.parse_date(F.col(date)), "_s": c.normal_symbol(F.col(symbol))}).drop(date, symbol)
    return out.withColumnsRenamed({"_d": "d", "_s": "symbol"}).where("d IS NOT NULL AND symbol IS NOT NULL")


def read_wide(spark: SparkSession, path: str, date: str = "date", value: str = "value") -> DataFrame:
    """Date by code matrix to (d, symbol, value); unparsable dates are dropped."""
    wide = spark.read.parquet(path)
    names = [n for n in wide.columns if n != date]
    return keyed(wide.unpivot([date], names, "code", value), date, "code").select("d", "symbol", value)


def read_pool(spark: SparkSession, pool: str, paths: dict[str, str]) -> DataFrame | None:
    """Member (d, symbol) rows of a point-in-time pool; ALL_ pools do not filter."""
    if pool.startswith("ALL_"):
        return None
    if pool not in paths:
        raise ValueError(f"unknown pool {pool}")
    return read_wide(spark, paths[pool], value="member").where(F.coalesce(F.col("member").cast("boolean"), F.lit(False)))


def factor_names(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n not in CATALOGUE_EXCLUDED]


def read_factor(spark: SparkSession, path: str, factor: str | None = None) -> DataFrame:
    """One factor of a long panel; the first factor column by default. Only three columns are read."""
    raw = spark.read.parquet(path)
    if not {"ticker", "date"} <= set(raw.columns):
        raise ValueError("factor file needs ticker and date")
    names = factor_names(raw)
    factor = factor or names[0]
    if factor not in names:
        raise ValueError(f"no factor {factor}")
    return keyed(raw.select("date", "ticker", factor), "date", "ticker").select("d", "symbol", factor)


def _last_per_key(raw: DataFrame, value: str, name: str) -> DataFrame:
    rows = keyed(raw.select("date", "ticker", F.col(value).alias(name), row_order().alias("_order")), "date", "ticker")
    return rows.where(F.col(name).isNotNull()).groupBy("d", "symbol").agg(F.max_by(name, "_order").alias(name))


def read_signal(spark: SparkSession, path: str, name: str = "signal") -> DataFrame:
    """External signal file: last numeric column, null rows dropped, later rows win."""
    raw = read_any(spark, path)
    if not {"ticker", "date"} <= set(raw.columns):
        raise ValueError("signal file needs date and ticker")
    numeric = [n for n, kind in raw.dtypes if n not in ("date", "ticker") and kind in c.NUMERIC_TYPES]
    if not numeric:
        raise ValueError("signal file has no numeric column")
    return _last_per_key(raw, numeric[-1], name)


def read_predictions(spark: SparkSession, folder: str, name: str = "signal") -> DataFrame:
    """Folder of prediction CSVs in file order: last column that is no key, later files win."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("inferSchema", True).csv(folder)
    values = [n for n in raw.columns if n not in ("date", "ticker")]
    if not {"ticker", "date"} <= set(raw.columns) or not values:
        raise ValueError("prediction files need date, ticker and a value")
    return _last_per_key(raw, values[-1], name)


def _bound(df: DataFrame, column: str, day: str, shift: int = 0) -> Column:
    """A range bound in the column's own type, so that the filter reaches the file scan."""
    kind = dict(df.dtypes)[column]
    if kind in ("int", "bigint"):
        from datetime import date, timedelta
        return F.lit(int((date.fromisoformat(day) + timedelta(days=shift)).strftime("%Y%m%d"))).cast(kind)
    return F.date_add(F.lit(day).cast("date"), shift).cast("date" if kind == "string" else kind)


def in_range(df: DataFrame, column: str, start: str | None, end: str | None, before: int = 0, after: int = 0) -> DataFrame:
    key = c.parse_date(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)
    if start:
        df = df.where(key >= _bound(df, column, start, -before))
    if end:
        df = df.where(key <= _bound(df, column, end, after))
    return df


def read_closes(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                before: int = LEAD_IN_DAYS, after: int = 0) -> DataFrame:
    """Closes (TradingDate, Stkcd, price) with some days of lead; the last price per key."""
    raw = spark.read.parquet(path)
    missing = {"TradingDate", "Stkcd", "price"} - set(raw.columns)
    if missing:
        raise ValueError(f"close file lacks {sorted(missing)}")
    near = in_range(raw, "TradingDate", start, end, before, after)
    rows = near.select(F.col("TradingDate").cast("date").alias("d"), c.normal_symbol(F.col("Stkcd")).alias("symbol"),
                       "price", row_order().alias("_order"))
    return rows.groupBy("d", "symbol").agg(F.max_by("price", "_order").alias("price"))


def read_panel(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
               features: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """Feature panel under either key naming; date range pushed to the scan, stated features only."""
    raw = read_any(spark, path, schema)
    names = {"date": "date", "ticker": "ticker"} if {"date", "ticker"} <= set(raw.columns) else {
        "date": "TradingDate", "ticker": "Stkcd"}
    if not set(names.values()) <= set(raw.columns):
        raise ValueError("panel needs ticker and date, or Stkcd and TradingDate")
    available = c.feature_columns(raw.drop(*names.values()))
    wanted = list(dict.fromkeys(features or available))
    unknown = [f for f in wanted if f not in available]
    if unknown:
        raise ValueError(f"no such features: {unknown}")
    if not wanted:
        raise ValueError("panel has no numeric feature")
    c.reject_lookahead(wanted)
    rows = in_range(raw, names["date"], start, end).select(*names.values(), *wanted)
    return keyed(rows, names["date"], names["ticker"]).where(c.any_not_null(wanted)).select("d", "symbol", *wanted)


def load_range(df: DataFrame, start: str | None = None, end: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Date range and columns of any source; an unknown column is an error."""
    date = c.alias_of(df.columns, c.DATE_ALIASES)
    wanted = df.columns if columns is None else list(dict.fromkeys([*([date] if date else []), *columns]))
    unknown = sorted(set(wanted) - set(df.columns))
    if unknown:
        raise ValueError(f"source lacks {unknown}")
    return (in_range(df, date, start, end) if date else df).select(*wanted)


PROFILE = "id string, provider string, rows bigint, columns int, date_column string, symbol_column string, start date, end date, available boolean, message string"


def profile(df: DataFrame, name: str, provider: str = "parquet") -> DataFrame:
    """One row: size, key columns and date range."""
    date, symbol = c.alias_of(df.columns, c.DATE_ALIASES), c.alias_of(df.columns, c.SYMBOL_ALIASES)
    day = (c.parse_date(F.col(date)) if date else F.lit(None).cast("date"))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("start"), F.max(day).alias("end"))
    return facts.select(F.lit(name).alias("id"), F.lit(provider).alias("provider"), "rows", F.lit(len(df.columns)).alias("columns"),
                        F.lit(date).cast("string").alias("date_column"), F.lit(symbol).cast("string").alias("symbol_column"),
                        "start", "end", F.lit(True).alias("available"), F.lit("").alias("message"))


def provider_of(source: str) -> str:
    """Kind of source by scheme or suffix."""
    text = source.lower().rstrip("/")
    if "://" in text and text.split("://", 1)[0] not in ("file", "hdfs", "s3", "s3a", "abfss", "gs"):
        return text.split("://", 1)[0]
    for suffix, kind in ((".csv", "csv"), (".csv.gz", "csv"), (".parquet", "parquet"), (".pq", "parquet")):
        if text.endswith(suffix):
            return kind
    raise ValueError(f"cannot tell the kind of {source}")


@dataclass
class Catalog:
    """Named sources; one that cannot be read is listed as unavailable."""

    spark: SparkSession
    sources: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, source: str) -> Catalog:
        if not name:
            raise ValueError("a source needs a name")
        self.sources[name] = source
        return self

    def get(self, name: str) -> DataFrame:
        if name not in self.sources:
            raise KeyError(name)
        provider = provider_of(self.sources[name])
        if provider not in ("csv", "parquet"):
            raise ValueError(f"no reader for {provider}")
        return read_any(self.spark, self.sources[name])

    def profiles(self) -> DataFrame:
        out = self.spark.createDataFrame([], PROFILE)
        for name, source in self.sources.items():
            try:
                row = profile(self.get(name), name, provider_of(source))
            except Exception as exc:  # noqa: BLE001 - any unreadable source becomes a row
                row = self.spark.createDataFrame([(name, source.split("://")[0] if "://" in source else "unknown", None, None, None,
                                                   None, None, None, False, type(exc).__name__)], PROFILE)
            out = out.unionByName(row)
        return out

    def frequencies(self) -> DataFrame:
        return self.spark.createDataFrame([(n, FREQUENCIES.get(n, "custom")) for n in self.sources], "id string, frequency string")


def factor_catalog(df: DataFrame, source: str) -> DataFrame:
    """(ordinal, name, source) of a panel's factors, with how many values each has."""
    names = factor_names(df)
    ordinal = F.create_map(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), F.lit(i))])
    counts = df.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "name", "values")
    return counts.select(ordinal[F.col("name")].alias("ordinal"), "name", F.lit(source).alias("source"), "values")


def available_signals(spark: SparkSession, factor_path: str | None = None, model_folder: str | None = None,
                      upload_folder: str | None = None) -> DataFrame:
    """(key, label) of every factor, model folder and uploaded file. Files are listed, not read."""
    out = spark.createDataFrame([], "key string, label string")
    if factor_path:
        names = factor_names(spark.read.parquet(factor_path))
        rows = [(f"factor:{n}", f"factor: {n}") for n in names]
        rows += [("default_factor", f"default factor ({names[0]})")] if names else []
        out = out.unionByName(spark.createDataFrame(rows, "key string, label string"))

    def listed(folder: str, pattern: str) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        return reader.load(folder).select("path")

    if model_folder:
        models = listed(model_folder, "*.csv").select(F.element_at(F.split("path", "/"), -2).alias("key")).distinct()
        out = out.unionByName(models.select("key", F.concat(F.lit("model: "), "key").alias("label")))
    if upload_folder:
        files = listed(upload_folder, "*.{csv,parquet}").select(F.element_at(F.split("path", "/"), -1).alias("file"))
        out = out.unionByName(files.select(F.concat(F.lit("upload:"), "file").alias("key"),
                                           F.concat(F.lit("upload: "), F.regexp_replace("file", r"\.[^.]+$", "")).alias("label")))
    return out


def read_industry(spark: SparkSession, path: str) -> DataFrame:
    """Static or dated mapping; blank names, unparsable dates and conflicting rows fail the job."""
    raw = read_any(spark, path)
    lower = {n.strip().lower(): n for n in raw.columns}
    symbol, industry, date = (next((lower[a] for a in names if a in lower), None)
                              for names in (INDUSTRY_SYMBOLS, INDUSTRY_NAMES, INDUSTRY_DATES))
    if symbol is None or industry is None:
        raise ValueError("industry file needs a code and an industry column")
    name = F.trim(F.col(industry).cast("string"))
    bad_name = F.raise_error(F.lit("industry file has an empty code or industry")).cast("string")
    code = c.normal_symbol(F.col(symbol))
    blank = (F.coalesce(name, F.lit("")) == "") | (F.coalesce(F.trim(F.col(symbol).cast("string")), F.lit("")) == "")
    rows = {"symbol": code, "industry": F.when(blank, bad_name).otherwise(name)}
    keys = ["symbol"]
    if date:
        day = c.parse_date(F.col(date))
        rows["d"] = F.when(day.isNull(), F.raise_error(F.lit("industry file has an unparsable date")).cast("date")).otherwise(day)
        keys.append("d")
    parsed = raw.select(*[v.alias(k) for k, v in rows.items()])
    one = parsed.groupBy(*keys).agg(F.min("industry").alias("_low"), F.max("industry").alias("_high"))
    clash = F.raise_error(F.concat(F.lit("conflicting industries for "), "symbol")).cast("string")
    return one.select(*keys, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(clash).alias("industry"))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Open dates of a calendar file (calendarDate, isOpen)."""
    raw = spark.read.option("header", True).csv(path)
    if not {"calendarDate", "isOpen"} <= set(raw.columns):
        raise ValueError("calendar needs calendarDate and isOpen")
    return raw.where(F.lower("isOpen").isin(*OPEN_FLAGS)).select(c.parse_date(F.col("calendarDate")).alias("d")).distinct()


def read_benchmark(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    """Single series: the only value column, else the first numeric one."""
    raw = spark.read.parquet(path)
    others = [(n, k) for n, k in raw.dtypes if n != date]
    value = others[0][0] if len(others) == 1 else next(n for n, k in others if k in c.NUMERIC_TYPES)
    return raw.select(c.parse_date(F.col(date)).alias("d"), F.col(value).cast("double").alias("value")).where("d IS NOT NULL")


def ingest_factors(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Check a factor file, write it as parquet, and report rows, features and range.

    Bad keys and repeated keys fail the job before anything can read the target.
    """
    raw = read_any(spark, path)
    if not {"date", "ticker"} <= set(raw.columns):
        if not {"factor_date", "symbol"} <= set(raw.columns):
            raise ValueError("factor file needs date and ticker, or factor_date and symbol")
        raw = raw.withColumnsRenamed({"factor_date": "date", "symbol": "ticker"})
    features = c.reject_lookahead(c.feature_columns(raw.drop("date", "ticker")))
    if not features:
        raise ValueError("factor file has no numeric factor")
    day = c.parse_date(F.col("date"))
    code = c.normal_symbol(F.col("ticker"))
    bad = F.raise_error(F.lit("factor file has a row without date or code"))
    rows = raw.select(F.coalesce(day, bad.cast("date")).alias("date"), F.coalesce(code, bad.cast("string")).alias("ticker"), *features)
    copies = rows.groupBy("date", "ticker").count().where("count > 1").limit(1).count()
    if copies:
        raise ValueError("factor file repeats a date and code")
    rows.write.parquet(target)
    written = spark.read.parquet(target)
    return written.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(features)).alias("features"),
                       F.min("date").alias("start"), F.max("date").alias("end"))
