"""Technical indicators: each adds its columns to a panel of instrument_id, date, open, high, low, close, volume."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.registry import INDICATORS
from factorlake.functions.series import average_rank, change, col, count_in, lag, own, ratio, rolling, so_far, span_alpha, with_ema

#: Trading days of a year.
YEAR = 252


def compute(df: DataFrame, name: str, **params) -> DataFrame:
    return INDICATORS.find(name)(df, **params)


@INDICATORS("MA", "SMA")
def ma(df: DataFrame, period: int = 20, column: str = "close") -> DataFrame:
    """Mean of the last rows."""
    return df.withColumn(f"MA_{period}", rolling(F.avg, column, period))


@INDICATORS("EMA")
def ema(df: DataFrame, period: int = 20, column: str = "close", smoothing: float = 2.0) -> DataFrame:
    """Recursive exponential average, seeded by the first value."""
    return with_ema(df, {f"EMA_{period}": (column, span_alpha(period, smoothing))})


def weighted(x: str | Column, period: int, newest_heaviest: bool) -> Column:
    """Linear weights over the last rows, 1..period: heaviest on the newest or on the oldest."""
    terms = [(period - k if newest_heaviest else k + 1) * (lag(x, k) if k else col(x)) for k in range(period)]
    return sum(terms[1:], terms[0]) / (period * (period + 1) / 2)


@INDICATORS("WMA")
def wma(df: DataFrame, period: int = 20, column: str = "close", newest_heaviest: bool = False) -> DataFrame:
    """Linearly weighted mean; the oldest row weighs most unless newest_heaviest."""
    return df.withColumn(f"WMA_{period}", weighted(column, period, newest_heaviest))


@INDICATORS("RSI")
def rsi(df: DataFrame, period: int = 14, column: str = "close") -> DataFrame:
    """Relative strength by averages with alpha 1/period; the first change counts as 0; without losses 100."""
    step = F.coalesce(F.col(column) - lag(column), F.lit(0.0))
    df = df.withColumns({"__gain": F.greatest(step, F.lit(0.0)), "__loss": F.greatest(-step, F.lit(0.0))})
    df = with_ema(df, {"__g": ("__gain", 1 / period), "__l": ("__loss", 1 / period)})
    value = F.when(F.col("__l") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("__g", "__l")))
    return df.withColumn(f"RSI_{period}", value).drop("__gain", "__loss", "__g", "__l")


@INDICATORS("MACD")
def macd(df: DataFrame, fast_period: int = 12, slow_period: int = 26, signal_period: int = 9) -> DataFrame:
    """Difference of two averages, its own average, and what is between them."""
    fast, slow = f"EMA_{fast_period}", f"EMA_{slow_period}"
    df = with_ema(df, {fast: ("close", span_alpha(fast_period)), slow: ("close", span_alpha(slow_period))})
    df = with_ema(df.withColumn("MACD_line", F.col(fast) - F.col(slow)), {"MACD_signal": ("MACD_line", span_alpha(signal_period))})
    return df.withColumn("MACD_hist", F.col("MACD_line") - F.col("MACD_signal"))


def true_range() -> Column:
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


@INDICATORS("ATR")
def atr(df: DataFrame, period: int = 14) -> DataFrame:
    """Average true range with alpha 1/period; the first range is high - low."""
    return with_ema(df.withColumn("__range", true_range()), {f"ATR_{period}": ("__range", 1 / period)}).drop("__range")


@INDICATORS("BB")
def bollinger(df: DataFrame, period: int = 20, std_dev: float = 2.0) -> DataFrame:
    """Mean and bands of std_dev sample deviations, their relative width, and the close's place between them."""
    df = df.withColumns({"BB_middle": rolling(F.avg, "close", period), "__sd": rolling(F.stddev_samp, "close", period)})
    df = df.withColumns({"BB_upper": F.col("BB_middle") + std_dev * F.col("__sd"), "BB_lower": F.col("BB_middle") - std_dev * F.col("__sd")})
    span = F.col("BB_upper") - F.col("BB_lower")
    return df.withColumns({"BB_width": F.try_divide(span, F.col("BB_middle")), "BB_pct": F.try_divide(F.col("close") - F.col("BB_lower"), span)}).drop("__sd")


@INDICATORS("ROC")
def roc(df: DataFrame, period: int = 10) -> DataFrame:
    """Percent change over the period."""
    before = lag("close", period)
    return df.withColumn(f"ROC_{period}", ratio(F.col("close") - before, before) * 100)


@INDICATORS("MOM")
def mom(df: DataFrame, period: int = 10) -> DataFrame:
    """Difference over the period."""
    return df.withColumn(f"MOM_{period}", F.col("close") - lag("close", period))


@INDICATORS("STD")
def std(df: DataFrame, period: int = 20, column: str = "close") -> DataFrame:
    """Sample deviation of the last rows."""
    return df.withColumn(f"STD_{period}", rolling(F.stddev_samp, column, period))


@INDICATORS("VOL")
def vol(df: DataFrame, period: int = 20) -> DataFrame:
    """Sample deviation of simple returns, a year's."""
    df = df.withColumn("__ret", change("close"))
    return df.withColumn(f"VOL_{period}", rolling(F.stddev_samp, "__ret", period) * math.sqrt(YEAR)).drop("__ret")


@INDICATORS("VMA")
def vma(df: DataFrame, period: int = 20) -> DataFrame:
    """Mean volume."""
    return df.withColumn(f"VMA_{period}", rolling(F.avg, "volume", period))


@INDICATORS("SMA_VOLUME")
def sma_volume(df: DataFrame, period: int = 50) -> DataFrame:
    """Mean volume under another name."""
    return df.withColumn(f"SMA_VOLUME_{period}", rolling(F.avg, "volume", period))


@INDICATORS("OBV")
def obv(df: DataFrame) -> DataFrame:
    """Volume added on rises and taken off on falls; the first row adds 0."""
    step = F.col("close") - lag("close")
    df = df.withColumn("__v", F.when(step > 0, F.col("volume")).when(step < 0, -F.col("volume")).otherwise(F.lit(0)))
    return df.withColumn("OBV", F.sum("__v").over(so_far())).drop("__v")


@INDICATORS("MAX")
def highest(df: DataFrame, period: int = 20, column: str = "high") -> DataFrame:
    """Greatest of the last rows."""
    return df.withColumn(f"MAX_{period}", rolling(F.max, column, period))


@INDICATORS("MIN")
def lowest(df: DataFrame, period: int = 20, column: str = "low") -> DataFrame:
    """Least of the last rows."""
    return df.withColumn(f"MIN_{period}", rolling(F.min, column, period))


@INDICATORS("HH")
def hh(df: DataFrame, period: int = 63) -> DataFrame:
    """Greatest close of the last rows."""
    return df.withColumn(f"HH_{period}", rolling(F.max, "close", period))


@INDICATORS("LL")
def ll(df: DataFrame, period: int = 20) -> DataFrame:
    """Least low of the last rows."""
    return df.withColumn(f"LL_{period}", rolling(F.min, "low", period))


@INDICATORS("MIN_DAILY_RETURN")
def min_daily_return(df: DataFrame, period: int = 90) -> DataFrame:
    """Worst simple return of the last rows."""
    return df.withColumn("__ret", change("close")).withColumn(f"MIN_DAILY_RETURN_{period}", rolling(F.min, "__ret", period)).drop("__ret")


@INDICATORS("ADR_PCT")
def adr_pct(df: DataFrame, period: int = 20) -> DataFrame:
    """Mean of (high - low) / close."""
    return df.withColumn(f"ADR_PCT_{period}", rolling(F.avg, ratio(F.col("high") - F.col("low"), "close"), period))


@INDICATORS("ADV")
def adv(df: DataFrame, period: int = 20) -> DataFrame:
    """Mean of close * volume."""
    return df.withColumn(f"ADV_{period}", rolling(F.avg, F.col("close") * F.col("volume"), period))


def _with_regression(df: DataFrame, period: int) -> DataFrame:
    """Add __slope, __r2 and __score of the regression of ln(close) on the row number over the last rows.

    Rows lie in blocks of `period`, and a window is the end of one block and the start of the
    next. So its sums are a running sum from the block's start and, of the row `period` before,
    what followed that one in its block: none holds more than `period` rows, and prices count from
    the earlier block's first, so that digits don't wear off however long the series is. A row
    costs the same for any period. Null with fewer rows, a close of 0 or less in the window, or no
    change in it.
    """
    place = F.row_number().over(own()) - 1
    df = df.withColumns({"__ln": F.when(F.col("close") > 0, F.ln("close")), "__at": place % period, "__block": F.floor(place / period)})
    df = df.withColumn("__moved", F.coalesce((F.col("__ln") != lag("__ln")).cast("int"), F.lit(0)))
    block = Window.partitionBy("instrument_id", "__block").orderBy("date")
    # blocks follow each other in time: this is the order of own(), by the sort that the blocks need
    in_blocks = Window.partitionBy("instrument_id").orderBy("__block", "date")
    earlier = lambda c, n: F.lag(c, n).over(in_blocks)
    df = df.withColumn("__o", F.first("__ln", ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    df = df.withColumn("__before", F.coalesce(earlier("__o", period), F.col("__o")))
    i = F.col("__at").cast("double")
    y0, y1 = (F.coalesce(F.col("__ln") - F.col(o), F.lit(0.0)) for o in ("__o", "__before"))
    ahead, so_far_ = block.rowsBetween(1, Window.unboundedFollowing), block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # what follows a row in its block, as seen from the next block
    rest = {"__r1": F.count("__ln"), "__ry": F.sum(y0), "__ryy": F.sum(y0 * y0), "__riy": F.sum(i * y0), "__rm": F.sum("__moved")}
    df = df.withColumns({c: zero(f.over(ahead)) for c, f in rest.items()})
    start = {"__s1": F.count("__ln"), "__sy": F.sum(y1), "__syy": F.sum(y1 * y1), "__siy": F.sum(i * y1), "__sm": F.sum("__moved")}
    df = df.withColumns({c: f.over(so_far_) for c, f in start.items()})
    df = df.withColumns({c: zero(earlier(c, period)) for c in rest})
    both = lambda c: F.col(f"__s{c}") + F.col(f"__r{c}")
    # changes inside the window: that into its first row is none of them
    full = (both("1") == period) & (both("m") - zero(earlier("__moved", period - 1)) > 0)
    mean = both("y") / period
    # places count from the window's first row: the earlier block's rows lie before the later one's
    sum_ky = F.col("__siy") + (period - 1 - i) * F.col("__sy") + F.col("__riy") - (i + 1) * F.col("__ry")
    var_k = (period * period - 1) / 12.0
    df = df.withColumns({"__cov": F.when(full, sum_ky / period - (period - 1) / 2.0 * mean), "__vy": F.when(full, both("yy") / period - mean * mean)})
    df = df.withColumns({"__slope": F.col("__cov") / var_k, "__r2": F.when(F.col("__vy") > 0, F.least(F.lit(1.0), F.try_divide(F.col("__cov") * F.col("__cov"), F.lit(var_k) * F.col("__vy"))))})
    df = df.withColumn("__score", (F.exp(F.col("__slope") * YEAR) - 1) * 100 * F.col("__r2"))
    return df.drop("__ln", "__at", "__block", "__moved", "__o", "__before", *rest, *start, "__cov", "__vy")


@INDICATORS("CLENOW_SCORE")
def clenow_score(df: DataFrame, period: int = 90) -> DataFrame:
    """A year's exponential slope of the log price, in percent, times its R2."""
    names = {"__slope": "CLENOW_SLOPE", "__r2": "CLENOW_R2", "__score": "CLENOW_SCORE"}
    return _with_regression(df, period).withColumnsRenamed(names)


@INDICATORS("CLENOW_R2")
def clenow_r2(df: DataFrame, period: int = 90) -> DataFrame:
    """R2 of the regression of the log price on time."""
    return _with_regression(df, period).drop("__slope", "__score").withColumnRenamed("__r2", "CLENOW_R2")


@INDICATORS("RS_RATING")
def rs_rating(df: DataFrame, period: int = 252) -> DataFrame:
    """Percentile within the date of a weighted sum of returns over 63, 126, 189 and 252 rows (fixed)."""
    raw = (2 * ratio("close", lag("close", 63)) + ratio("close", lag("close", 126)) + ratio("close", lag("close", 189)) + ratio("close", lag("close", 252))) / 5
    df = df.withColumn("__raw", raw)
    return df.withColumn("RS_RATING", F.try_divide(average_rank("__raw", "date"), count_in(["date"], "__raw")) * 100).drop("__raw")


@INDICATORS("RUMI")
def rumi(df: DataFrame, fast: int = 3, slow: int = 50, smooth: int = 30) -> DataFrame:
    """Mean of (fast simple mean - slow weighted mean, newest heaviest)."""
    df = df.withColumn("RUMI_DIFF", rolling(F.avg, "close", fast) - weighted("close", slow, newest_heaviest=True))
    return df.withColumn("RUMI", rolling(F.avg, "RUMI_DIFF", smooth))
