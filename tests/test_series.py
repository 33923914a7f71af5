"""Hand values and invariants of the building blocks."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.functions import factors, indicators
from factorlake.functions.registry import FACTORS, INDICATORS, Registry
from factorlake.functions.series import average_rank, clipped, half_life_alpha, span_alpha, standardised, with_ema

DAY = dt.date(2020, 1, 1)


def panel(spark, closes, **more):
    rows = [(i, DAY + dt.timedelta(days=k), float(c), float(c) + 1, float(c) - 1, float(c), 100 + k) for i, series in closes.items() for k, c in enumerate(series)]
    return spark.createDataFrame(rows, "instrument_id string, date date, open double, high double, low double, close double, volume bigint")


def column(df, name, who="a"):
    return [r[name] for r in df.where(F.col("instrument_id") == who).orderBy("date").collect()]


def test_momentum_and_no_leak(spark):
    df = panel(spark, {"a": [1, 2, 4, 8], "b": [10, 10, 10, 10]})
    out = factors.momentum(df, 2)
    assert column(out, "momentum") == [None, None, 300.0, 300.0]
    assert column(out, "momentum", "b")[2:] == [0.0, 0.0]


def test_rolling_needs_a_full_window(spark):
    out = indicators.ma(panel(spark, {"a": [1, 2, 3, 4]}), 3)
    assert column(out, "MA_3") == [None, None, 2.0, 3.0]


def test_no_look_ahead(spark):
    closes = [float(x) for x in range(10, 60)]
    long, short = panel(spark, {"a": closes}), panel(spark, {"a": closes[:30]})
    for name in ("RSI", "MACD", "ATR", "BB", "OBV", "RUMI"):
        a, b = (indicators.compute(d, name).orderBy("date").limit(30).toPandas() for d in (long, short))
        pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("alpha", [span_alpha(120), 0.3, 0.97, 1.0])
@pytest.mark.parametrize("adjusted", [False, True])
def test_ema_is_the_recursion(spark, alpha, adjusted):
    x = [100 + 10 * math.sin(i / 3) + i % 7 for i in range(700)]
    out = with_ema(panel(spark, {"a": x}), {"e": ("close", alpha, adjusted)})
    want = pd.Series(x).ewm(alpha=alpha, adjust=adjusted).mean().tolist()
    assert column(out, "e") == pytest.approx(want, rel=1e-10)


def test_half_life():
    assert (1 - half_life_alpha(5)) ** 5 == pytest.approx(0.5)


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 2.0), ("d", 2.0), ("d", None)], "date string, x double")
    got = sorted((r.x is None, r.x, r.r) for r in df.select("x", average_rank("x", "date").alias("r")).collect() if r.x is not None)
    assert [g[2] for g in got] == [1.0, 2.5, 2.5]


def test_clip_takes_nearest_rank(spark):
    df = spark.createDataFrame([("d", float(i)) for i in range(11)] + [("d", None)], "date string, x double")
    got = [r.c for r in clipped(df, "x", 0.1, ["date"], "c").orderBy("x").collect()]
    assert got == [None, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 9.0]


def test_standardised_without_variance_is_null(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 1.0)], "date string, x double")
    assert [r.z for r in df.select(standardised("x", ["date"]).alias("z")).collect()] == [None, None]


def test_wma_weights(spark):
    df = panel(spark, {"a": [1, 2, 4]})
    assert column(indicators.wma(df, 3), "WMA_3")[2] == pytest.approx((3 * 1 + 2 * 2 + 1 * 4) / 6)
    assert column(indicators.wma(df, 3, newest_heaviest=True), "WMA_3")[2] == pytest.approx((1 * 1 + 2 * 2 + 3 * 4) / 6)


def test_division_by_zero_is_null(spark):
    assert column(factors.momentum(panel(spark, {"a": [0, 1, 2]}), 1), "momentum") == [None, None, 100.0]


def test_quarterly_shift(spark):
    rows = [("a", DAY + dt.timedelta(days=30 * k), dt.date(2020 + (k // 4), 3 * (k % 4) + 3, 28), 100.0 * 1.1**k) for k in range(5)]
    df = spark.createDataFrame(rows, "instrument_id string, date date, end_date date, total_revenue double")
    got = column(factors.FACTORS.find("fund_revenue_qoq")(df), "fund_revenue_qoq")
    assert got[0] is None and got[1:] == pytest.approx([0.1] * 4)
    gap = df.where("month(end_date) <> 6")
    assert column(factors.FACTORS.find("fund_revenue_qoq")(gap), "fund_revenue_qoq")[1] is None


def test_registry():
    assert len(INDICATORS) == 26 and len(FACTORS) >= 50
    own = Registry("thing")
    own("x")(len)
    with pytest.raises(ValueError):
        own("x")(len)
    with pytest.raises(ValueError):
        own.find("y")


def test_shuffled_rows_give_the_same(spark):
    df = panel(spark, {"a": [float(i * i % 13 + 5) for i in range(40)], "b": [float(i % 7 + 3) for i in range(40)]})
    one = factors.clenow_momentum(df, 10).orderBy("instrument_id", "date").toPandas()
    two = factors.clenow_momentum(df.repartition(7, "volume"), 10).orderBy("instrument_id", "date").toPandas()
    pd.testing.assert_frame_equal(one, two)


def test_regression_against_least_squares(spark):
    import numpy as np

    x = [100 * math.exp(0.01 * i + 0.1 * math.sin(i)) for i in range(60)] + [50.0] * 30 + [-1.0] + [60.0 + i for i in range(30)]
    got = column(indicators.clenow_score(panel(spark, {"a": x}), 20), "CLENOW_SLOPE")
    for t in range(len(x)):
        w = x[max(0, t - 19) : t + 1]
        if len(w) < 20 or min(w) <= 0 or len(set(w)) == 1:
            assert got[t] is None
        else:
            assert got[t] == pytest.approx(np.polyfit(range(20), np.log(w), 1)[0], abs=1e-10)
