"""Logical tables from the driver's tables, on rows that make denominators 0 or sums end on a limit."""

import datetime as dt
import math
import random

import duckdb

from factorlake.functions import factors
from factorlake.plans import bindings, catalog, screens

SCHEMA = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"


def lines(spark, folder, rows):
    """A lineitem table of (supplier, day, quantity, price, discount, tax); the folder."""
    data = [(k, k, s, 1, float(q), float(p), d, t, dt.datetime.combine(day, dt.time())) for k, (s, day, q, p, d, t) in enumerate(rows)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


def both(spark, folder, name):
    """The rows of a query and of its SQL, in order of letters."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.queries()[name](spark, folder).collect()]
    return sorted(map(repr, got)), sorted(map(repr, db.execute(catalog.oracle_sql()[name]).fetchall()))


def test_quarters_without_discounts(spark, tmp_path):
    """A quarter of undiscounted lines has no debt: ratios to it are infinite, as in the SQL, and nothing fails."""
    day = dt.date(1996, 2, 1)
    folder = lines(spark, tmp_path, [(1, day, 2, 100, 0.0, 0.02), (1, dt.date(1996, 5, 1), 2, 100, 0.1, 0.02), (1, dt.date(1996, 8, 1), 1, 50, 0.0, 0.0), (2, day, 2, 100, 0.0, 1.0), (2, dt.date(1996, 6, 1), 1, 10, 0.05, 0.0)])
    quarters = {(r.instrument_id, r.end_date.month): r for r in bindings.fundamentals(spark, folder).collect()}
    assert quarters["S000001", 3].ocf_to_debt == math.inf and quarters["S000001", 3].debt_to_eqt == 0
    assert math.isnan(quarters["S000002", 3].ocf_to_debt)  # 0 / 0
    for name in ("n1_quality", "n4_leverage", "n5_cashflow", "j2_enrich", "n11_revenue_qoq", "n14_roe_trend_4q"):
        got, want = both(spark, folder, name)
        assert got == want, name


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_over_instruments_sort_twice_and_in_bounded_parts(spark, tmp_path, monkeypatch):
    """What a task sorts goes by a fixed number of rows, and by two sorts however many averages there are."""
    monkeypatch.setattr(bindings, "TASK_ROWS", 25)
    folder = lines(spark, tmp_path, [(s, dt.date(1996, 1, 1) + dt.timedelta(days=k), 1, 10 + k, 0.1, 0.0) for s in range(20) for k in range(10)])
    rows = bindings.bars(spark, folder)
    assert rows.rdd.getNumPartitions() == 8  # 200 lines
    for df in (factors.ema_alignment(rows), factors.clenow_momentum(rows), screens.pivot_columns(rows).select("instrument_id", "ema_10", "ema_200")):
        text = plan(df)
        assert text.count("Exchange") == 1, text
    for df in (factors.ema_alignment(rows), factors.clenow_momentum(rows)):
        assert plan(df).count("Sort [") == 2


def test_suppliers_whose_short_ids_coincide_keep_their_own_bars(spark, tmp_path):
    """lpad cuts ids of seven digits: two suppliers of one id stay two bars, as in the SQL."""
    folder = lines(spark, tmp_path, [(1_000_000, dt.date(1996, 1, 1), 1, 10, 0.1, 0.0), (100_000, dt.date(1996, 1, 1), 2, 50, 0.1, 0.0)])
    assert sorted(r["close"] for r in bindings.bars(spark, folder).collect()) == [10.0, 25.0]


def test_means_that_are_a_limit_are_summed_in_the_order_of_the_files(spark, tmp_path):
    """Where an average of 0.03, or the difference of two equal ones, comes out a little more or less by the order of its sum, the files' order counts, as in the SQL with one thread; only queries of the means sort for it."""
    rng = random.Random(3)
    rates = [0.0, 0.01, 0.01, 0.02, 0.04, 0.06, 0.07]
    rows = [(s, dt.date(1996, 1, 1 + k), 1, 10, x, y) for s in range(400) for k, (x, y) in enumerate(zip(rng.sample(rates, 7), rng.sample(rates, 7), strict=True))]
    rows += [(s, dt.date(1996, 2, 1), 1, 10, 0.1, 0.0) for s in range(400)]
    rng.shuffle(rows)
    one = spark.read.parquet(lines(spark, tmp_path / "one", rows) + "/lineitem.parquet").collect()
    spark.createDataFrame(spark.sparkContext.parallelize(one, 5), SCHEMA).write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect(config={"threads": 1})
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("n7_pe_ttm", "n8_pb_ps"):
        got, want = (sorted(map(repr, x)) for x in (map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()), db.execute(catalog.oracle_sql()[name]).fetchall()))
        assert got == want and 0 < sum(", 0.0" in x for x in got) < 400, name
    sorts = [plan(catalog.queries()[name](spark, str(tmp_path))).count("max_by(") > 0 for name in ("n7_pe_ttm", "n6_size", "n1_quality")]
    assert sorts == [True, False, False]
