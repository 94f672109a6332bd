"""Price, factor, industry and ledger panels derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factorloom.operators.calendar import sessions
from factorloom.operators.ranking import needs_slices
from factorloom.session import materialise


def padded(c: Column) -> Column:
    return F.lpad(c.cast("string"), 6, "0")


def month_of(c: Column) -> Column:
    return F.trunc(c.cast("date"), "month")


class Panels:
    """Lazy frames over one data folder; every frame is unique on (d, symbol)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._slices: int | None = None
        self._sessions: DataFrame | None = None
        self._monthly: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def monthly(self) -> DataFrame:
        """Supplier by month sums, written once: prices, factors, calendar and sizes all come from this table.

        The lines are summed map-side, so a supplier with a third of them still sends one row per task and month.
        """
        if self._monthly is None:
            lines = self.table("lineitem").select(
                "l_suppkey", month_of(F.col("l_shipdate")).alias("d"), "l_extendedprice", "l_discount", "l_quantity", "l_tax",
                F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("returned"))
            sums = lines.groupBy("l_suppkey", "d").agg(
                F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("disc"),
                F.avg("l_tax").alias("tax"), F.avg("returned").alias("ret"))
            self._monthly = materialise(sums)
        return self._monthly

    def slices(self) -> int:
        """Slices ranking by month needs, measured once."""
        if self._slices is None:
            self._slices = needs_slices(self.monthly(), ["d"])
        return self._slices

    def sessions(self) -> DataFrame:
        """The monthly calendar, written once."""
        if self._sessions is None:
            self._sessions = sessions(self.monthly())
        return self._sessions

    def px(self) -> DataFrame:
        # sevenths of the mean unit price: no value sits on a decimal rounding boundary
        return self.monthly().select(padded(F.col("l_suppkey")).alias("symbol"), "d",
                                     (F.col("value") / F.col("quantity") / 7).alias("price"))

    def px_day(self) -> DataFrame:
        lines = self.table("lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("d"), "l_extendedprice", "l_quantity")
        sums = lines.groupBy("l_suppkey", "d").agg((F.sum("l_extendedprice") / F.sum("l_quantity") / 7).alias("price"))
        return sums.select(padded(F.col("l_suppkey")).alias("symbol"), "d", "price")

    def fx(self) -> DataFrame:
        gap = (F.col("l_suppkey") + F.month("d")) % 17 == 0
        return self.monthly().select(
            padded(F.col("l_suppkey")).alias("symbol"), "d", F.when(~gap, F.round("disc", 10)).alias("f_disc"),
            F.col("quantity").alias("f_qty"), F.round("tax", 10).alias("f_tax"), F.round("ret", 10).alias("f_ret"))

    def industry(self) -> DataFrame:
        return self.table("supplier").select(padded(F.col("s_suppkey")).alias("symbol"),
                                             (F.col("s_nationkey") % 5).alias("industry"))

    def industry_dated(self) -> DataFrame:
        """One row per symbol and year: effective 1 January."""
        years = self.table("lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "year").alias("d"),
                                              F.col("l_suppkey").alias("s_suppkey")).distinct()
        return years.join(self.table("supplier"), "s_suppkey").select(
            "d", padded(F.col("s_suppkey")).alias("symbol"),
            ((F.col("s_nationkey") + F.year("d")) % 5).alias("industry"))

    def ledger(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("d"),
            padded(F.col("o_custkey")).alias("symbol"),
            F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("side"),
            F.col("o_totalprice").alias("gross"))

    def adj(self) -> DataFrame:
        """Adjustment factor that steps each year for a third of the symbols."""
        keys = self.px().select("symbol", "d")
        steps = 1 + 0.1 * (F.year("d") - 1991)
        return keys.withColumn("adj", F.when(F.col("symbol").cast("int") % 3 == 0, steps).otherwise(F.lit(1.0)))

    def st(self) -> DataFrame:
        return self.fx().select("symbol", "d", (F.col("f_ret") > 0.5).alias("st"))

    def pool(self) -> DataFrame:
        """Point-in-time membership: quantity at or above the month's mean."""
        fx = self.fx().select("symbol", "d", "f_qty")
        level = fx.groupBy("d").agg(F.avg("f_qty").alias("level"))
        return fx.join(F.broadcast(level), "d").select("symbol", "d", (F.col("f_qty") >= F.col("level")).alias("member"))

    def sparse(self) -> DataFrame:
        """Quarter-end months only, dated on the 15th, which is no session of the monthly calendar."""
        return (self.fx().where(F.month("d") % 3 == 0)
                .withColumn("d", F.date_add("d", 14)))

    def benchmark(self) -> DataFrame:
        return self.px().groupBy("d").agg(F.avg("price").alias("value"))
