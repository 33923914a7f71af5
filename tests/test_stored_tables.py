"""Upserts by arrival into touched partitions, kept summaries, and bars from a running stream."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from factorlake.sources import ingest
from factorlake.streaming import bars as streams

D = dt.date
T0 = dt.datetime(2024, 1, 1)


def bars(spark, rows):
    return spark.createDataFrame([(i, d, i, 1.0, 1.0, 1.0, float(c), 1, 1.0) for i, d, c in rows], ingest.BARS)


def files(path):
    """Data files below a path with what tells whether they were written again."""
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet") and "/_" not in d}


def closes(spark, path):
    return {(r.instrument_id, r.date): r.close for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize("stream", [False, True])
def test_the_last_to_land_stays(spark, tmp_path, stream):
    """Two rows of one file, and two files: not the larger value but the later one."""
    landing, path = str(tmp_path / "in"), str(tmp_path / "out")
    bars(spark, [("a", D(2020, 1, 1), 9), ("a", D(2020, 1, 1), 5), ("b", D(2020, 1, 1), 7)]).coalesce(1).write.parquet(landing)
    time.sleep(0.01)
    bars(spark, [("b", D(2020, 1, 1), 3)]).coalesce(1).write.mode("append").parquet(landing)
    if stream:
        streams.upsert_stream(spark, landing, path, str(tmp_path / "cp")).awaitTermination()
    else:
        ingest.upsert(spark, ingest.landed(spark, landing, ingest.BARS), path)
    assert closes(spark, path) == {("a", D(2020, 1, 1)): 5.0, ("b", D(2020, 1, 1)): 3.0}
    assert "arrival" not in spark.read.parquet(path).columns


def test_a_callers_column_orders_arrivals(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = bars(spark, [("a", D(2020, 1, 1), 9), ("a", D(2020, 1, 1), 5)]).withColumn("came", F.when(F.col("close") == 9, 1).otherwise(2))
    ingest.upsert(spark, rows, path, arrival=["came"])
    assert closes(spark, path) == {("a", D(2020, 1, 1)): 5.0} and "came" not in spark.read.parquet(path).columns


def test_untouched_files_stay(spark, tmp_path):
    path = str(tmp_path / "bars")
    many = [(f"i{k}", D(y, 1, 2), k) for k in range(40) for y in (2020, 2021, 2022)]
    ingest.upsert(spark, bars(spark, many), path, buckets=8)
    before = files(path)
    assert len({os.path.dirname(f) for f in before}) == 24
    ingest.upsert(spark, bars(spark, [("i3", D(2021, 1, 5), 100)]), path, buckets=4)  # the table's own number of buckets holds
    after = files(path)
    gone, come = {os.path.dirname(f) for f in before.keys() - after.keys()}, {os.path.dirname(f) for f in after.keys() - before.keys()}
    assert len(gone) == 1 and gone == come and "year=2021" in next(iter(come))
    assert all(after[f] == before[f] for f in before.keys() & after.keys())
    assert closes(spark, path) == {(i, d): float(c) for i, d, c in [*many, ("i3", D(2021, 1, 5), 100)]}


def test_replace_spares_other_instruments_and_years(spark, tmp_path):
    path = str(tmp_path / "bars")
    ingest.upsert(spark, bars(spark, [(i, D(y, 1, k), k) for i in "abc" for y in (2020, 2021) for k in (1, 2)]), path, buckets=1)
    ingest.upsert(spark, bars(spark, [("a", D(2020, 1, 2), 50)]), path, replace=True)
    got = closes(spark, path)
    assert len(got) == 11 and got["a", D(2020, 1, 2)] == 50.0 and ("a", D(2020, 1, 1)) not in got


def test_kept_state_is_that_of_a_rescan(spark, tmp_path):
    path = str(tmp_path / "bars")
    loads = [[(f"i{k}", D(2020, 1, 1 + k % 9), k) for k in range(300)], [(f"i{k}", D(2020 + k % 3, 2, 1), k) for k in range(200, 500)], [("i7", D(2021, 2, 1), 1), (None, D(2021, 2, 1), 1), ("i8", None, 1)]]
    for rows in loads:
        ingest.upsert(spark, bars(spark, rows), path, buckets=4)
        stored = spark.read.parquet(path)
        kept, whole = ingest.stored_state(spark, path).first(), ingest.dataset_state(stored).first()
        assert (kept.n_rows, kept.first_date, kept.last_date) == (whole.n_rows, whole.first_date, whole.last_date)
        assert abs(kept.n_instruments - whole.n_instruments) <= 0.04 * whole.n_instruments
        assert set(ingest.stored_marks(spark, path).collect()) == set(ingest.high_water(stored).collect())
    assert all("/_state/" in f for f in ingest.stored_state(spark, path).inputFiles())
    none = ingest.stored_state(spark, str(tmp_path / "none")).first()
    assert (none.n_rows, none.last_date, none.n_instruments) == (0, None, 0)


def ticks(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), n, float(p)) for n, (i, m, p) in enumerate(rows)], streams.TICKS)


def test_ticks_late_within_and_beyond_tolerance_over_restarts(spark, tmp_path):
    """Each lot is a run of its own, from the checkpoint: open hours go on, closed ones take no more ticks."""
    landing, path, marks = (str(tmp_path / x) for x in ("in", "out", "cp"))
    lots = [
        [("a", 10, 1), ("a", 50, 2), ("b", 55, 9)],
        [("a", 65, 3), ("a", 58, 7)],  # 58 comes 7 minutes late: its hour is open still
        [("a", 130, 4), ("b", 30, 5)],  # 30 is more than 10 minutes late but no batch has closed its hour
        [("a", 40, 100), ("a", 185, 6)],  # the first hour closed with 130 - 10 > 60: 40 is left out
        [("c", 400, 1)],
    ]
    for lot in lots:
        ticks(spark, lot).coalesce(1).write.mode("append").parquet(landing)
        streams.bars_stream(spark, landing, path, marks, late="10 minutes").awaitTermination()
    hour = lambda h: T0 + dt.timedelta(hours=h)
    got = {(r.instrument_id, r.datetime): (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(path).collect()}
    assert got == {
        ("a", hour(0)): (1.0, 7.0, 1.0, 7.0, 3), ("b", hour(0)): (5.0, 9.0, 5.0, 9.0, 2), ("a", hour(1)): (3.0, 3.0, 3.0, 3.0, 1),
        ("a", hour(2)): (4.0, 4.0, 4.0, 4.0, 1), ("a", hour(3)): (6.0, 6.0, 6.0, 6.0, 1),
    }


def test_instruments_are_counted_exactly(spark, tmp_path):
    """More instruments than a sketch tells apart, in years that share some of them and come out of order."""
    path, part = str(tmp_path / "bars"), lambda lo, hi, y: spark.range(lo, hi).select(F.format_string("i%05d", "id").alias("instrument_id"), F.lit(D(y, 1, 2)).alias("date"), F.lit(1.0).alias("close"))
    for lo, hi, y in ((0, 9000, 2021), (5000, 13007, 2019), (200, 300, 2021), (13007, 13010, 2020)):
        ingest.upsert(spark, part(lo, hi, y), path, replace=lo == 200)
    got = ingest.stored_state(spark, path).first()
    assert (got["n_rows"], got["n_instruments"]) == (9000 + 8007 + 3, 13010)
