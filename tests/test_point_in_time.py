"""As-of joins, adjustment, sectors, universe, calendar, ingest."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from factorlake.operators import adjust, asof, calendar, sectors, universe
from factorlake.sources import ingest, shared, sinks
from factorlake.streaming import bars as streams

D = dt.date


def test_asof_takes_whole_rows(spark):
    left = spark.createDataFrame([("a", D(2020, 1, 5)), ("a", D(2020, 1, 10)), ("a", D(2020, 1, 1))], "instrument_id string, date date")
    right = spark.createDataFrame([("a", D(2020, 1, 2), 1.0, 1.0), ("a", D(2020, 1, 10), None, 2.0)], "instrument_id string, date date, x double, y double")
    got = [(r.x, r.y) for r in asof.asof(left, right, ["x", "y"]).orderBy("date").collect()]
    assert got == [(None, None), (1.0, 1.0), (None, 2.0)]


def test_adjustment_directions(spark):
    rows = [("a", D(2020, 1, 1), 10.0, 10.0, 10.0, 10.0, 5, 0.5), ("a", D(2020, 1, 2), 6.0, 6.0, 6.0, 6.0, 10, 1.0)]
    df = spark.createDataFrame(rows, "instrument_id string, date date, open double, high double, low double, close double, volume bigint, adj_factor double")
    close = lambda mode: [r.close for r in adjust.adjusted(df, mode).orderBy("date").collect()]
    assert close("forward") == [5.0, 6.0] and close("backward") == [10.0, 12.0] and close("raw") == [10.0, 6.0]
    assert adjust.adjusted(df.drop("open"), "forward").orderBy("date").first().close == 10.0
    with pytest.raises(ValueError):
        adjust.adjusted(df, "sideways")


def test_sector_changes(spark):
    s = spark.createDataFrame([("a", D(2020, 1, 1), "x", "X"), ("a", D(2020, 6, 1), "y", "Y")], "instrument_id string, date date, sector string, sector_name string")
    at = lambda day: [r.sector for r in sectors.members_at(s, day).collect()]
    assert at("2019-12-31") == [] and at("2020-05-31") == ["x"] and at("2020-06-01") == ["y"]


def test_halts_end_exclusive(spark):
    e = spark.createDataFrame([("a", D(2020, 1, 1), "IPO"), ("a", D(2020, 2, 1), "HALT"), ("a", D(2020, 2, 15), "RESUME"), ("b", D(2020, 2, 1), "HALT")], "instrument_id string, date date, event string")
    rows = spark.createDataFrame([("a", D(2020, 2, 1)), ("a", D(2020, 2, 14)), ("a", D(2020, 2, 15)), ("b", D(2021, 1, 1))], "instrument_id string, date date")
    assert [(r.instrument_id, r.date) for r in universe.not_halted(rows, e).collect()] == [("a", D(2020, 2, 15))]
    flags = {(r.instrument_id, r.date): r.is_active for r in universe.active(rows, e).collect()}
    assert flags[("a", D(2020, 2, 15))] and not flags[("a", D(2020, 2, 1))]


def test_calendar(spark):
    years = spark.createDataFrame([(2023,), (2024,)], "y int")
    assert {r.d for r in years.select(calendar.good_friday(F.col("y")).alias("d")).collect()} == {D(2023, 4, 7), D(2024, 3, 29)}
    holidays = spark.createDataFrame([(D(2024, 1, 1),)], "date date")
    cal = calendar.calendar(spark, "2024-01-01", "2024-01-14", holidays)
    assert [r.week_ordinal for r in cal.orderBy("date").collect()] == [0, 1, 2, 3, 4, 0, 0, 1, 2, 3, 4, 5, 0, 0]
    first = calendar.neighbours(cal).orderBy("date").first()
    assert first.next_trading == D(2024, 1, 2) and first.previous_trading is None


def bars(spark, rows):
    return spark.createDataFrame([(i, d, i, 1.0, 1.0, 1.0, float(c), 1, 1.0) for i, d, c in rows], ingest.BARS)


def test_upsert_merges_and_keeps_the_last(spark, tmp_path):
    path = str(tmp_path / "bars")
    ingest.upsert(spark, bars(spark, [("a", D(2020, 1, 1), 1), ("a", D(2021, 1, 1), 2)]), path)
    ingest.upsert(spark, bars(spark, [("a", D(2020, 1, 1), 9), ("a", D(2020, 1, 2), 3)]), path)
    got = {(r.date, r.close) for r in spark.read.parquet(path).collect()}
    assert got == {(D(2020, 1, 1), 9.0), (D(2020, 1, 2), 3.0), (D(2021, 1, 1), 2.0)}


def test_absent_path_is_empty(spark, tmp_path):
    assert ingest.scan(spark, str(tmp_path / "none"), ingest.BARS).count() == 0


def test_schema_problems(spark):
    df = spark.createDataFrame([("a", 1)], "instrument_id string, volume int")
    assert "missing column date" in ingest.problems(df.schema) and not any("volume" in p for p in ingest.problems(df.schema))


def test_stream_upsert(spark, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "out")
    bars(spark, [("a", D(2020, 1, 1), 1)]).write.parquet(landing)
    streams.upsert_stream(spark, landing, path, str(tmp_path / "cp")).awaitTermination()
    bars(spark, [("a", D(2020, 1, 1), 5), ("b", D(2020, 1, 1), 2)]).write.mode("append").parquet(landing)
    streams.upsert_stream(spark, landing, path, str(tmp_path / "cp")).awaitTermination()
    assert {(r.instrument_id, r.close) for r in spark.read.parquet(path).collect()} == {("a", 5.0), ("b", 2.0)}


def test_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "bars")
    ingest.upsert(spark, bars(spark, [(i, D(y, 1, k), k) for i in ("a", "b") for y in (2020, 2021) for k in (1, 2)]), path, replace=True)
    df = ingest.read_partition(spark, path, ingest.BARS, "b", 2021)
    assert [(r.instrument_id, r.date) for r in df.collect()] == [("b", D(2021, 1, 1)), ("b", D(2021, 1, 2))]
    plan = df._jdf.queryExecution().toString()
    assert "(year#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "EqualTo(instrument_id,b)" in plan.split("PushedFilters:")[1]
    assert ingest.read_partition(spark, path, ingest.BARS, "a").count() == 4
    assert ingest.read_partition(spark, str(tmp_path / "none"), ingest.BARS, "a").count() == 0


def test_last_intraday_bar_stays(spark):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [("x", "1h", t, 1.0, 1), ("x", "1h", t, 2.0, 3), ("x", "1h", t, 9.0, 2), ("x", "5m", t, 7.0, 4)]
    df = spark.createDataFrame([(i, v, at, c, c, c, c, 1, b) for i, v, at, c, b in rows], "ticker string, interval string, datetime timestamp, open double, high double, low double, close double, volume bigint, batch int")
    assert [(r.instrument_id, r.close) for r in ingest.intraday_bars(df).collect()] == [("X", 2.0)]


def test_mapped_ingest_goes_on_after_the_last_day(spark, tmp_path):
    path = str(tmp_path / "sectors")
    source = spark.createDataFrame([("a", "2020-01-01", "x", "X"), ("a", "2020-06-01", "y", "Y"), ("b", "2020-06-01", "x", "X")], "instrument_id string, assign_date string, sector_code string, sector_name string")
    only = ingest.all_instruments(source.where("instrument_id = 'a'"), source.where("instrument_id = 'a'"))
    ingest.mapped_ingest(spark, source.where("assign_date < '2020-03-01'"), "US", "sectors", path, only)
    ingest.mapped_ingest(spark, source.withColumn("sector_code", F.lit("z")), "US", "sectors", path, only)
    assert {(r.instrument_id, str(r.date), r.sector) for r in spark.read.parquet(path).collect()} == {("a", "2020-01-01", "x"), ("a", "2020-06-01", "z")}
    with pytest.raises(ValueError):
        ingest.mapped_ingest(spark, source, "US", "nonsense", path)


def test_bad_values(spark):
    df = spark.createDataFrame([("a", "2020-01-01", "x"), ("a", "soon", "5"), ("b", None, None)], "instrument_id string, date string, volume string")
    found = {r.problem: r.n_bad for r in ingest.bad_values(df).collect()}
    assert found["column date is string, not date"] == 1 and found["column volume is string, not bigint"] == 1 and found["missing column close"] == 3
    assert ingest.bad_values(bars(spark, [])).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.5), ("a", None)], "name string, x double")
    for kind in ("csv", "json", "parquet", "markdown"):
        sinks.write(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).schema(df.schema).csv(str(tmp_path / "csv")).count() == 2
    assert {tuple(r) for r in spark.read.schema(df.schema).json(str(tmp_path / "json")).collect()} == {("b", 2.5), ("a", None)}
    (file,) = (tmp_path / "markdown").glob("part-*")
    assert file.read_text() == "| name | x |\n| --- | --- |\n| a |  |\n| b | 2.5 |\n"


def test_kept_tables_go(spark):
    t = shared.kept(spark.range(3), "t")
    assert t.count() == 3
    shared.discard(t, spark.range(2))
    assert not os.path.exists(t.kept_path.removeprefix("file://"))
