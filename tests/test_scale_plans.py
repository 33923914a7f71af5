"""Operators whose plans must not grow with products, pairs or the number of specs: results against brute force, and the plans."""

import bisect
import datetime as dt
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factorlake.functions import indicators
from factorlake.functions.series import own
from factorlake.operators import asof, next_event, quantiles, universe
from factorlake.plans import bindings, combo, evaluate, screens, study_queries
from test_bindings import both
from test_bindings import lines as write_lines

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# next events


def test_first_exits_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(next_event, "BLOCK_DAYS", 7)
    rng = random.Random(2)
    bars = {i: [(k, rng.choice([None, math.nan, *range(20)]) if rng.random() < 0.1 else rng.randint(0, 40)) for k in range(n) if rng.random() < 0.8] for i, n in (("a", 100), ("b", 60), ("c", 3), ("d", 0))}
    rows = [(i, day(k), None if v is None else float(v), k % 11 == 3) for i, x in bars.items() for k, v in x]
    panel = spark.createDataFrame(rows, "instrument_id string, date date, low double, odd boolean")
    asked = [(i, k, rng.choice([None, *range(-1, 25)])) for i in ("a", "b", "c", "d", "e") for k in range(-3, 105, 2)] * 2
    entries = spark.createDataFrame([(i, day(k), None if x is None else float(x)) for i, k, x in asked], "instrument_id string, entry_date date, entry_low double")
    got = screens.first_exit(entries, panel, {"level": ("low", F.col("entry_low"))}, {"odd": F.col("odd")}).collect()

    def first(i, k, x):
        for at, v in bars.get(i, []):
            if at > k:
                if x is not None and v is not None and v <= x:
                    return day(at), "level"
                if at % 11 == 3:
                    return day(at), "odd"
        return None, None

    key = lambda r: tuple(map(str, r))
    want = [(i, day(k), None if x is None else float(x), *first(i, k, x)) for i, k, x in asked]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_ten_thousand_entries_on_one_instrument_of_a_hundred_thousand_bars(spark):
    """No row for a pair of entry and bar: joins put out one row per entry."""
    n = 100_000
    value = F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double")
    panel = spark.range(n).select(F.lit("a").alias("instrument_id"), F.date_add(F.lit(dt.date(1800, 1, 1)), F.col("id").cast("int")).alias("date"), value.alias("low")).persist()
    entries = panel.where(F.dayofyear("date") % 10 == 0).select("instrument_id", F.col("date").alias("entry_date"), (F.col("low") / 50).alias("entry_low")).limit(10_000).persist()
    found = next_event.next_at_or_under(entries, panel, "low", F.col("entry_low"), "day")
    assert all("Nested" not in x and "Cartesian" not in x for x in plan(found).split("\n"))
    got = {r.entry_date: r.day for r in found.collect()}
    low = [(r.date, r.low) for r in panel.orderBy("date").collect()]
    dates, values = [d for d, _ in low], np.array([v for _, v in low])
    for r in entries.sample(0.02, 1).collect():
        at = bisect.bisect_right(dates, r.entry_date)
        hits = np.flatnonzero(values[at:] <= r.entry_low)
        assert got[r.entry_date] == (dates[at + hits[0]] if len(hits) else None)
    assert len(got) == entries.count() > 9_000
    panel.unpersist()


def test_exits_keep_only_days_up_to_an_entrys_first_event(spark):
    """And a day's two rows of one id both count, in any order."""
    rows = [("a", day(k), k % 10 == 0, k == 23) for k in range(100)] + [("a", day(30), False, False), ("b", day(5), False, False)]
    df = spark.createDataFrame(rows, "instrument_id string, date date, odd boolean, entry boolean")
    left = next_event.open_days(df, F.col("entry"), F.col("odd"), own())
    assert sorted((r.date - DAY).days for r in left.collect()) == [*range(23, 31), 30]
    assert left.columns == df.columns


def test_next_days_add_one_row_at_a_time(spark):
    """A window up to the last following row is worked out anew for each row: quadratic in an instrument's rows."""
    df = spark.createDataFrame([("a", day(1), True)], "instrument_id string, date date, odd boolean")
    assert "unboundedfollowing" not in plan(next_event.next_days(df.select("instrument_id", F.col("date").alias("entry_date")), df, {"n": F.col("odd")})).lower()


def test_pivots_and_their_exits_by_one_reading_of_the_lines(spark, tmp_path, monkeypatch):
    """One scan, one shuffle and two sorts for pivots and exits, and the same rows as the SQL and as exits of given entries."""
    rng = random.Random(5)
    days = [(s, day(k), 10_000 * 1.01**k * (1 + 0.2 * rng.random())) for s in range(4) for k in range(320) if rng.random() < 0.9]
    lines = [(s, d, 1, round(price * f, 2), 0.1, 0.0) for s, d, price in days for f in (1, 1.01 + 0.02 * rng.random())]
    folder = write_lines(spark, tmp_path, lines)
    kept, seen = next_event.kept, []
    monkeypatch.setattr(next_event, "kept", lambda df, name: (seen.append(plan(df)), kept(df, name))[1])
    got, want = both(spark, folder, "m8_pivot_exits")
    assert got == want and len(got) > 20 and any("pivot low" in r for r in got) and any("average" in r for r in got)
    text = "".join(seen)
    assert [text.count(x) for x in ("Scan parquet", "Exchange", "Sort [")] == [1, 1, 2], text
    bars = bindings.bars(spark, folder)
    entries = screens.gap_pivot(bars, **study_queries.PIVOT_PARAMS).select("instrument_id", F.col("date").alias("entry_date"), F.col("low").alias("entry_low"))
    apart = screens.pivot_exits(entries, bars).select("instrument_id", "entry_date", "exit_date", "exit_rule")
    assert sorted(repr(tuple(r)) for r in apart.collect()) == got
    assert "".join(seen[1:]).count("Scan parquet") == 2  # one of the entries, one of the bars


# quantiles


@pytest.mark.parametrize("kind", ["normal", "ties", "equal", "wide", "one", "two"])
def test_quantiles_of_awkward_tables(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "PARTS", 8)
    monkeypatch.setattr(quantiles, "FETCHED", 20)
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 5, 3000) / 3, "equal": np.full(500, 7.25), "wide": rng.choice([-1, 1], 2000) * 10 ** rng.uniform(-300, 308, 2000), "one": np.array([3.0]), "two": np.array([1.0, 2.0])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "x double").repartition(5)
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    assert quantiles.exact_quantiles(df, "x", shares) == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)


def test_quantiles_of_nothing_and_of_infinity(spark):
    df = spark.createDataFrame([(None,), (math.nan,)], "x double")
    assert quantiles.exact_quantiles(df, "x", [0.5]) == [None]
    with pytest.raises(ValueError, match="infinite"):
        quantiles.exact_quantiles(spark.createDataFrame([(math.inf,)], "x double"), "x", [0.5])


# regressions


def test_fits_keep_their_digits_on_a_million_rows(spark, tmp_path):
    n, p = 1_000_000, 90
    rng = np.random.default_rng(6)
    logs = np.cumsum(rng.normal(0.00002, 0.01, n))
    closes = np.exp(logs)
    pq.write_table(pa.table({"instrument_id": ["a"] * n, "date": np.arange(n), "close": closes}), tmp_path / "bars.parquet")
    out = indicators.clenow_score(spark.read.parquet(str(tmp_path / "bars.parquet")), p).where(F.col("date") >= n - 50_000).select("date", "CLENOW_SLOPE", "CLENOW_R2").orderBy("date").toPandas()
    y = np.lib.stride_tricks.sliding_window_view(np.log(closes), p)[n - 50_000 - p + 1 :]
    y = y - y.mean(axis=1, keepdims=True)
    k = np.arange(p) - (p - 1) / 2
    slope = y @ k / (k @ k)
    r2 = (y @ k) ** 2 / ((k @ k) * (y * y).sum(axis=1))
    assert np.abs(out.CLENOW_R2 - r2).max() < 1e-9 and np.abs(out.CLENOW_SLOPE - slope).max() < 1e-12


def test_fits_with_gaps_and_flats(spark):
    rng = random.Random(7)
    closes = [None if rng.random() < 0.02 else rng.choice([0.0, -1.0]) if rng.random() < 0.01 else 5.0 if 100 < k < 130 else 100 * math.exp(rng.gauss(0, 0.1)) for k in range(400)]
    df = spark.createDataFrame([("a", day(k), c) for k, c in enumerate(closes)], "instrument_id string, date date, close double")
    got = {r.date: r.CLENOW_R2 for r in indicators.clenow_r2(df, 7).collect()}
    for k in range(400):
        window = closes[max(0, k - 6) : k + 1]
        whole = len(window) == 7 and all(c is not None and c > 0 for c in window) and len(set(window)) > 1
        want = np.corrcoef(np.arange(7), np.log(window))[0, 1] ** 2 if whole else None
        assert got[day(k)] == (want if want is None else pytest.approx(want, abs=1e-9))


# as-of joins, sweeps, batches


def test_one_exchange_for_all_sides(spark):
    panel = spark.createDataFrame([("a", day(k), float(k)) for k in range(10)], "instrument_id string, date date, close double")
    f = spark.createDataFrame([("a", day(2), day(0), 1.0), ("a", day(2), day(1), 2.0), ("a", None, day(9), 9.0)], "instrument_id string, date date, end_date date, roe double")
    v = spark.createDataFrame([("a", day(4), 5.0, None), ("a", day(7), None, 1.0)], "instrument_id string, date date, pb double, roe double")
    out = asof.enrich(panel, f, v)
    assert len(re.findall(r"Exchange hashpartitioning", plan(out))) == 1
    assert [(r.roe, r.pb) for r in out.orderBy("date").collect()] == [(None, None)] * 2 + [(2.0, None)] * 2 + [(2.0, 5.0)] * 3 + [(2.0, None)] * 3


def test_membership_sweep(spark):
    rng = random.Random(8)
    kinds = ["IPO", "DELIST", "HALT", "RESUME", "SP500_ADD"]
    rows = [(f"i{k}", day(rng.randint(0, 30)), rng.choice(kinds)) for k in range(60) for _ in range(rng.randint(1, 6))]
    events = spark.createDataFrame(rows, "instrument_id string, date date, event string")
    days = spark.createDataFrame([(day(k),) for k in range(-2, 34, 3)] + [(None,)], "date date")
    out = universe.listed(events, days)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    want = set()
    for i in {r[0] for r in rows}:
        own = sorted((d, e) for j, d, e in rows if j == i)
        last = {k: max((d for d, e in own if e == k), default=None) for k in ("IPO", "DELIST")}
        halts = [(d, min((x for n, (x, y) in enumerate(own) if n > m and y == "RESUME"), default=None)) for m, (d, e) in enumerate(own) if e == "HALT"]
        for k in range(-2, 34, 3):
            d = day(k)
            if (last["IPO"] is None or last["IPO"] <= d) and (last["DELIST"] is None or last["DELIST"] > d) and not any(a <= d and (b is None or d < b) for a, b in halts):
                want.add((i, d))
    got = [(r.instrument_id, r.date) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


def test_turnover_where_an_ordinal_holds_nothing(spark):
    held = spark.createDataFrame([("a", 0), ("b", 0), ("a", 1), ("a", 3), ("c", 4)], "instrument_id string, ordinal int")
    out = combo.turnover(held)
    assert len(re.findall("Exchange", plan(out))) == 2
    assert sorted((r.ordinal, r.instrument_id, r.action) for r in out.collect()) == [(0, "a", "BUY"), (0, "b", "BUY"), (1, "b", "SELL"), (3, "a", "BUY"), (4, "a", "SELL"), (4, "c", "BUY")]


def momentum(p, **more):
    return combo.Term("momentum", params={"period": p}, **more)


def test_different_scorings_in_one_plan(spark, tmp_path):
    """Each against its own combo.scores(); the panel's scans don't grow with them."""
    rng = random.Random(9)
    rows = [(f"i{k}", day(d), 100 + 20 * rng.random(), 100.0 + 20 * rng.random(), rng.randint(1, 90)) for k in range(14) for d in range(30) if rng.random() < 0.95]
    spark.createDataFrame(rows, "instrument_id string, date date, open double, close double, volume bigint").write.parquet(str(tmp_path / "bars"))
    panel = spark.read.parquet(str(tmp_path / "bars"))
    sectors = spark.createDataFrame([(f"i{k}", day(-5), "xyz"[k % 3]) for k in range(13)], "instrument_id string, date date, sector string")
    some = {
        "one": combo.Spec((momentum(3),), top_k=1),
        "two": combo.Spec((momentum(3, direction="low", weight=0.5), momentum(5), combo.Term("gap", weight=2.0)), top_k=1, winsorize_pct=0.1),
        "grouped": combo.Spec((momentum(5),), top_k=1, group_by={"g": ["x"], "h": ["y", "z"]}, overrides={"i13": "g", "i0": "h"}),
        "sectors": combo.Spec((momentum(3),), top_k=1, sector_filter=("x", "z")),
        "filtered": combo.Spec((momentum(3),), top_k=1, filters=(combo.Filter("momentum", ">", -5.0, {"period": 1}), combo.Filter("intraday_return", "<", 0.1))),
    }
    got = evaluate.ranked_scorings(panel, some, sectors)
    found = {(r.scoring, r._group, r.instrument_id, r.date): (r.combo_score, r.rank) for r in got.collect()}
    want = {}
    for n, s in some.items():
        whole = combo.Spec(s.factors, top_pct=1.0, filters=s.filters, group_by=s.group_by, overrides=s.overrides, sector_filter=s.sector_filter, winsorize_pct=s.winsorize_pct)
        rows = combo.selected(combo.scores(panel, s, sectors), whole, sectors=sectors).collect()
        want |= {(n, r._group, r.instrument_id, r.date): (pytest.approx(r.combo_score, abs=1e-12), r.rank) for r in rows}
    assert found == want and len({k[0] for k in want}) == len(some)
    scans = lambda n: len(re.findall("FileScan", plan(evaluate.ranked_scorings(panel, dict(list(some.items())[:n]), sectors))))
    assert scans(2) == 1 and scans(5) == scans(3)
