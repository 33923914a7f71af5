"""Trading calendars as tables. Holidays are an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def good_friday(year: Column) -> Column:
    """Two days before Easter, by the Gregorian computus, as integer columns."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, F.lit(100)), year % 100
    d, e = div(b, F.lit(4)), b % 4
    f = div(b + 8, F.lit(25))
    g = div(b - f + 1, F.lit(3))
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, F.lit(4)), c % 4
    m7 = (32 + 2 * e + 2 * i - h - k) % 7
    m = div(a + 11 * h + 22 * m7, F.lit(451))
    x = h + m7 - 7 * m + 114
    return F.date_sub(F.make_date(year, div(x, F.lit(31)), x % 31 + 1), 2)


def calendar(spark: SparkSession, first: str, last: str, holidays: DataFrame | None = None, with_good_friday: bool = False) -> DataFrame:
    """date, is_trading and week_ordinal (place among the trading days of the ISO week, else 0)."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS date")
    open_ = F.dayofweek("date").between(2, 6)
    if with_good_friday:
        open_ = open_ & (F.col("date") != good_friday(F.year("date")))
    if holidays is not None:
        days = days.join(holidays.select(F.col("date").alias("__h")).distinct(), F.col("date") == F.col("__h"), "left")
        open_ = open_ & F.col("__h").isNull()
    days = days.select("date", open_.alias("is_trading"))
    w = Window.partitionBy(F.date_trunc("week", "date")).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.withColumn("week_ordinal", F.when(F.col("is_trading"), F.sum(F.col("is_trading").cast("int")).over(w)).otherwise(0).cast("int"))


def trading_days(cal: DataFrame, first: str, last: str) -> DataFrame:
    """The trading days from first to last, both included."""
    return cal.where(F.col("is_trading") & F.col("date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).select("date")


def neighbours(cal: DataFrame, within: int = 10) -> DataFrame:
    """date, next_trading, previous_trading: strictly after and before; null if over `within` days away.

    One task orders the calendar: a few thousand rows whatever the panel.
    """
    w = Window.orderBy("date")
    day = F.when(F.col("is_trading"), F.col("date"))
    after = F.first(day, ignorenulls=True).over(w.rowsBetween(1, within))
    before = F.last(day, ignorenulls=True).over(w.rowsBetween(-within, -1))
    return cal.select("date", after.alias("next_trading"), before.alias("previous_trading"))
