import os
from datetime import datetime

import pytest
from conftest import day
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factorloom import session
from factorloom.sources import readers, writers
from factorloom.streaming import feeds


def factors(spark):
    rows = [(20240102, 1, 0.5, None), (20240103, 1, 0.6, 1.0), (20240103, 600000, None, None)]
    return spark.createDataFrame(rows, "date int, ticker int, alpha_0 double, alpha_1 double")


def test_panel_drops_empty_rows_and_keeps_partial_ones(spark, tmp_path):
    path = str(tmp_path / "f.parquet")
    factors(spark).write.parquet(path)
    rows = readers.read_panel(spark, path).orderBy("d").collect()
    assert [(r["symbol"], r["alpha_1"]) for r in rows] == [("000001", None), ("000001", 1.0)]
    assert readers.read_panel(spark, path, "2024-01-03", "2024-01-03").count() == 1
    with pytest.raises(ValueError):
        readers.read_panel(spark, path, features=["beta"])
    with pytest.raises(ValueError):
        readers.load_range(spark.read.parquet(path), columns=["beta"])


def test_date_filter_and_columns_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "f.parquet")
    factors(spark).write.parquet(path)
    readers.read_panel(spark, path, "2024-01-03", None, ["alpha_0"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(date,20240103)" in plan and "alpha_1" not in plan


def test_lookahead_names_and_repeated_keys_are_refused(spark, tmp_path):
    path = str(tmp_path / "f.parquet")
    factors(spark).withColumn("next_return", F.lit(1.0)).write.parquet(path)
    with pytest.raises(ValueError, match="future"):
        readers.read_panel(spark, path)
    twice = str(tmp_path / "g.parquet")
    factors(spark).unionByName(factors(spark)).write.parquet(twice)
    with pytest.raises(ValueError, match="repeats"):
        readers.ingest_factors(spark, twice, str(tmp_path / "out.parquet"))
    assert not os.path.exists(tmp_path / "out.parquet")


def test_industry_conflict_fails(spark, tmp_path):
    path = str(tmp_path / "i.parquet")
    spark.createDataFrame([("a", "bank"), ("a", "tech")], "ticker string, industry string").write.parquet(path)
    with pytest.raises(Exception, match="conflicting industries"):
        readers.read_industry(spark, path).collect()


def test_later_signal_rows_win(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    os.makedirs(path)
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write("date,ticker,text,mean\n20240102,1,x,1.5\n20240102,1,y,2.5\n20240103,2,z,\n")
    with open(os.path.join(path, "b.csv"), "w") as f:
        f.write("date,ticker,text,mean\n20240102,7,x,4.5\n20240102,1,y,3.5\n")
    got = {r["symbol"]: r["signal"] for r in readers.read_signal(spark, path).collect()}
    assert got == {"000001": 3.5, "000007": 4.5}


def test_unknown_sources(spark):
    with pytest.raises(ValueError):
        readers.provider_of("table.xlsx")
    assert readers.provider_of("s3a://x/y.parquet") == "parquet"
    with pytest.raises(KeyError):
        readers.Catalog(spark).get("none")
    with pytest.raises(ValueError):
        readers.read_pool(spark, "OTHER", {})
    assert readers.read_pool(spark, "ALL_X", {}) is None


def test_factor_file_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(day(i), f"{i:06d}", float(i)) for i in range(5)], "d date, symbol string, prediction double")
    path = writers.write_factor_file(rows, str(tmp_path / "p.parquet"), "ridge")
    assert sorted(readers.read_factor(spark, path).collect()) == sorted(rows.collect())


def test_feed_restarts_where_it_stopped_and_drops_late_rows(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "ts timestamp, event_id long, user_id long, value double, side string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        feeds.run_available(feeds.latest_signal(feeds.read_feed(spark, source, "*.parquet", spark.read.parquet(source).schema),
                                                "user_id", "value", "event_id"), target, mark)

    at = lambda n, h=1: datetime(2024, 1, n, h)
    add([(at(1), 1, 1, 1.0, "BUY"), (at(1, 5), 2, 1, 2.0, "BUY"), (at(3), 3, 1, 3.0, "BUY")])
    first = {(r["day"].day, r["user_id"]): r["value"] for r in spark.read.parquet(target).collect()}
    assert first == {(1, 1): 2.0}
    add([(at(1, 9), 4, 1, 9.0, "BUY"), (at(3, 2), 5, 1, 4.0, "BUY"), (at(6), 6, 2, 5.0, "BUY")])  # day 1 is closed by now
    got = {(r["day"].day, r["user_id"]): r["value"] for r in spark.read.parquet(target).collect()}
    assert got == {(1, 1): 2.0, (3, 1): 4.0}


def test_late_rows_are_counted_and_applied_after_a_restart(spark, tmp_path):
    source, out, parts = (str(tmp_path / n) for n in ("in", "out", "parts"))
    schema = "ts timestamp, event_id long, user_id long, value double, side string"
    at = lambda n, h=1: datetime(2024, 1, n, h)

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        feed = lambda: feeds.read_feed(spark, source, "*.parquet", spark.read.parquet(source).schema)
        feeds.run_available(feeds.daily_activity(feed()), out, out + "-mark")
        feeds.run_available(feeds.activity_parts(feed()), parts, parts + "-mark")
        whole = feeds.whole_activity(spark.read.parquet(parts))
        written = spark.read.schema(whole.schema).parquet(out)
        days = {r["day"].day: (r["orders"], r["gross"], r["state"]) for r in feeds.corrected(written, whole).collect()}
        late = {r["day"].day: (r["earlier"]["orders"] if r["earlier"] else None, r["now"]["orders"]) for r in feeds.corrections(written, whole).collect()}
        return days, late

    days, late = add([(at(1), 1, 1, 1.0, "BUY"), (at(1, 5), 2, 1, 2.0, "SELL"), (at(3), 3, 1, 3.0, "BUY"), (None, 9, 1, 3.0, "BUY")])
    assert days == {1: (2, 3.0, "written"), 3: (1, 3.0, "open")} and late == {}
    days, late = add([(at(1, 9), 4, 1, 9.0, "BUY"), (at(2), 7, 1, None, "BUY"), (at(3, 2), 5, 1, 4.0, "BUY"), (at(6), 6, 2, 5.0, "BUY")])
    assert days == {1: (3, 12.0, "corrected"), 2: (1, None, "written"), 3: (2, 7.0, "written"), 6: (1, 5.0, "open")} or days[2][2] == "corrected"
    assert late[1] == (2, 3) and days[1] == (3, 12.0, "corrected") and days[3] == (2, 7.0, "written")
    days, late = add([(at(6, 3), 8, 2, 5.0, "BUY"), (at(1, 2), 10, 1, 1.0, "BUY")])
    assert days[6] == (2, 10.0, "open") and late[1] == (2, 4)


def test_signal_parts_keep_the_last_row(spark, tmp_path):
    source, parts = str(tmp_path / "in"), str(tmp_path / "parts")
    at = lambda n, h=1: datetime(2024, 1, n, h)
    rows = [(at(d, h), i, u, float(i)) for i, (d, h, u) in enumerate([(1, 1, 1), (1, 3, 1), (1, 3, 1), (1, 2, 1), (2, 1, 1), (1, 1, 2)])] + [(None, 99, 1, 9.0)]
    spark.createDataFrame(rows, "ts timestamp, event_id long, user_id long, value double").repartition(3).write.parquet(source)
    signal = ("user_id", "value", "event_id")
    feed = feeds.read_feed(spark, source, "*.parquet", spark.read.parquet(source).schema, files_per_batch=1)
    feeds.run_available(feeds.signal_parts(feed, *signal), parts, parts + "-mark")
    got = {(r["day"].day, r["user_id"]): r["value"] for r in feeds.whole_signals(spark.read.parquet(parts), *signal).collect()}
    assert got == {(1, 1): 2.0, (2, 1): 4.0, (1, 2): 5.0}


def test_every_oracle_has_a_query_and_entry_runs(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) >= 173
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and all(r["observations"] > 0 for r in rows)


def test_flagship_matches_duckdb_with_sliced_ranks(spark, sliced):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in entry.queries()["e06_daily_ic"](spark, folder).select("model", "d", "stock_count", "rank_ic").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet')")
    want = sorted(con.execute(f"SELECT model, d, stock_count, rank_ic FROM ({entry.oracle_sql()['e06_daily_ic']})").fetchall())
    assert got == want


def test_written_tables_leave_nothing_behind(spark):
    """A written table's shuffle files go with the job, and the driver lets go of what finished jobs have left."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in (files.getAllFiles().apply(i).getName() for i in range(files.getAllFiles().size())) if x.startswith("shuffle_")}
    before = held()
    numbers = session.materialise(spark.range(20_000).groupBy((F.col("id") % 7_000).alias("k")).count().repartition(3, "k"))
    assert not held() - before
    assert numbers.count() == 7_000 and spark.conf.get(session.SHUFFLE_CLEANUP_KEY, None) != "true"
    calls = []
    release, session.release = session.release, calls.append
    try:
        for _ in range(session.RELEASE_AFTER):
            session.materialise(spark.range(3))
    finally:
        session.release = release
    assert len(calls) == 1
