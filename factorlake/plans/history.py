"""What followed past signals, per instrument, kept up to date by merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.functions.series import lead, ratio

HORIZONS = (1, 3, 5, 10, 20)


def with_returns(signals: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Signals (instrument_id, date) that have a bar, with the return 1, 3, 5, 10 and 20 bars on."""
    ahead = bars.select("instrument_id", "date", *((ratio(lead("close", h), "close") - 1).alias(f"ret_{h}") for h in horizons))
    return signals.join(ahead, ["instrument_id", "date"])


def aggregate(returns: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """instrument_id, n, last_signal, mean_ret_h of each horizon, hit rates at 5 and 20; nulls don't count."""
    hit = lambda h: F.avg(F.when(F.col(f"ret_{h}").isNotNull(), (F.col(f"ret_{h}") > 0).cast("double"))).alias(f"hit_rate_{h}")
    return returns.groupBy("instrument_id").agg(F.count("*").alias("n"), F.max("date").alias("last_signal"), *(F.avg(f"ret_{h}").alias(f"mean_ret_{h}") for h in horizons), hit(5), hit(20))


def next_window(history: DataFrame, as_of: str, settle_days: int = 45) -> DataFrame:
    """One row: start (the day after the last signal; null at first) and end (as_of less the days that returns need)."""
    return history.agg(F.date_add(F.max("last_signal"), 1).alias("start")).withColumn("end", F.date_sub(F.to_date(F.lit(as_of)), settle_days))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two aggregates as one: counts add, means weigh by counts (a null mean as 0), the later signal stays.

    Instruments of one side pass as they are; columns that one side lacks are null there.
    """
    means = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c.startswith(("mean_", "hit_"))]
    pad = lambda df: df.select("instrument_id", "n", "last_signal", *((F.col(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in means))
    a, b = pad(old).alias("a"), pad(new).alias("b")
    both = a.join(b, "instrument_id", "full")
    na, nb = F.coalesce("a.n", F.lit(0)), F.coalesce("b.n", F.lit(0))
    zero = F.lit(0.0)

    def mean(c: str) -> F.Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        weighed = F.try_divide(na * F.coalesce(x, zero) + nb * F.coalesce(y, zero), na + nb)
        return F.when(F.col("b.n").isNull(), x).when(F.col("a.n").isNull(), y).otherwise(weighed).alias(c)

    return both.select("instrument_id", (na + nb).alias("n"), F.greatest("a.last_signal", "b.last_signal").alias("last_signal"), *(mean(c) for c in means))


def save(history: DataFrame, path: str, strategy: str, market: str) -> None:
    """Replace one strategy's and market's part of the stored table."""
    out = history.withColumns({"strategy": F.lit(strategy), "market": F.lit(market)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "market").parquet(path)


def status(stored: DataFrame) -> DataFrame:
    """strategy, market, n_rows, first_signal, last_signal of a stored table."""
    return stored.groupBy("strategy", "market").agg(F.count("*").alias("n_rows"), F.min("last_signal").alias("first_signal"), F.max("last_signal").alias("last_signal"))
