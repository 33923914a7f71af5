"""Steps that once sorted a whole table in one task, sorted twice, or read the bars several times."""

import datetime as dt
import pathlib

import duckdb
from pyspark.sql import functions as F

from factorlake.functions.series import average_rank
from factorlake.plans import bindings, catalog, evaluate
from factorlake.sources import shared as shared_tables
from factorlake.sources import sinks
from test_bindings import lines as write_lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_markdown_in_order_over_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write(spark.range(1000).select(F.format_string("k%04d", "id").alias("key")).repartition(3), str(tmp_path / "md"), "markdown")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [p.read_text() for p in sorted((tmp_path / "md").glob("part-*"))]
    assert sum(map(bool, parts)) > 1
    assert "".join(parts) == "| key |\n| --- |\n" + "".join(f"| k{k:04d} |\n" for k in range(1000))


def test_average_rank_by_one_sort(spark):
    df = spark.createDataFrame([("d", x) for x in (3.0, 1.0, None, 1.0, None, 2.0, 0.0, -0.0)], "date string, x double").select("x", average_rank("x", "date").alias("r"))
    assert plan(df).count("Sort [") == 1
    assert sorted((r.x, r.r) for r in df.collect() if r.x is not None) == [(0.0, 1.5), (0.0, 1.5), (1.0, 3.5), (1.0, 3.5), (2.0, 5.0), (3.0, 6.0)]
    assert all(r.r is None for r in df.collect() if r.x is None)


def test_windows_keep_their_dates(spark):
    days = spark.createDataFrame([("a", dt.date(2020, 1, d)) for d in (1, 2, 3, 4, 5)], "instrument_id string, date date")
    out = evaluate.windows(days, 2)
    assert "Scan parquet" in plan(out) and sorted((r.date.day, r.window_id) for r in out.collect()) == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 1)]


def test_saved_results_leave_little_on_the_disk(spark, tmp_path, monkeypatch):
    """Results are worked out once, bars are read once, and nothing stays but compressed texts: no shuffle files, no kept tables."""
    folder = write_lines(spark, tmp_path, [(s, dt.date(1996, 1, 1 + k), 2 + k % 3, 100 + s, 0.1, 0.0) for s in range(40) for k in range(25)])
    orders = [(k, k % 70, 100.0 + k, dt.datetime(1996, 1, 1 + k % 20)) for k in range(500)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp").write.parquet(folder + "/orders.parquet")
    db = duckdb.connect()
    for t in ("lineitem", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    local = pathlib.Path(spark.conf.get("spark.local.dir"))
    shuffled = lambda: {f.name for f in local.glob("blockmgr-*/*/shuffle_*")}
    shared = tmp_path / "shared"
    monkeypatch.setattr(shared_tables, "shared_dir", lambda spark: f"file://{shared}")
    before, reads = shuffled(), []
    bars = bindings.bars
    monkeypatch.setattr(bindings, "bars", lambda *x: (reads.append(x), bars(*x))[1])
    rows = catalog.queries()["s30_sinks"](spark, folder)
    assert len(reads) == 1 and not shuffled() - before
    assert len(list(shared.iterdir())) == 12 and {f.suffix for f in shared.glob("*/part-*")} == {".gz"}
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, db.execute(catalog.oracle_sql()["s30_sinks"]).fetchall()))
