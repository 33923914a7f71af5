"""Crossover study: signals, paired trades, their statistics, screens and a bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.functions.series import lag, own, ratio, span_alpha, with_ema
from factorlake.operators.quantiles import exact_quantiles


def adv_daily(bars: DataFrame, as_of: str, days: int = 30, rows: int = 20) -> DataFrame:
    """instrument_id, adv: mean of the last `rows` volumes times the last close, within `days` before as_of."""
    day = F.to_date(F.lit(as_of))
    near = bars.where((F.col("date") <= day) & (F.col("date") >= F.date_sub(day, days)))
    last = near.withColumn("__r", F.row_number().over(Window.partitionBy("instrument_id").orderBy(F.desc("date"))))
    return last.groupBy("instrument_id").agg((F.avg(F.when(F.col("__r") <= rows, F.col("volume"))) * F.max_by("close", "date")).alias("adv"))


def ema_cross(bars: DataFrame, short: int = 60, long: int = 120) -> DataFrame:
    """instrument_id, date, close, ema_s, ema_l, signal (golden, death or null), without the first long + 1 rows.

    The rows go before the comparison with the row before, so the first kept row never signals.
    """
    df = with_ema(bars.select("instrument_id", "date", "close"), {"ema_s": ("close", span_alpha(short)), "ema_l": ("close", span_alpha(long))})
    df = df.withColumn("__n", F.row_number().over(own())).where(F.col("__n") > long + 1).drop("__n")
    s, l = F.col("ema_s"), F.col("ema_l")  # noqa: E741
    golden = (lag("ema_s") <= lag("ema_l")) & (s > l)
    death = (lag("ema_s") >= lag("ema_l")) & (s < l)
    return df.withColumn("signal", F.when(golden, "golden").when(death, "death"))


def pair_trades(cross: DataFrame, mfe_window: int = 20) -> DataFrame:
    """Trades from each golden, when flat, to the next death: entry, exit, ret, bars_held, mfe, win.

    Opening when flat and closing when open is pairing the changes of the signal: of signals that
    repeat only the first counts, and a first death counts for nothing. mfe is the best close of
    the window after the entry, which may pass the exit.
    """
    ahead = own().rowsBetween(0, mfe_window)
    marked = cross.withColumns({"__i": F.row_number().over(own()), "__top": F.max("close").over(ahead)}).where("signal IS NOT NULL")
    w = own()
    before = F.lag("signal").over(w)
    changes = marked.where("true").withColumn("__b", before).where(F.when(F.col("__b").isNull(), F.col("signal") == "golden").otherwise(F.col("signal") != F.col("__b")))
    trades = changes.select(
        "instrument_id", "signal", F.col("date").alias("entry_date"), F.col("close").alias("entry_close"),
        F.lead("date").over(w).alias("exit_date"), F.lead("close").over(w).alias("exit_close"), (F.lead("__i").over(w) - F.col("__i")).alias("bars_held"), "__top",
    ).where("signal = 'golden' AND exit_date IS NOT NULL")
    ret = ratio("exit_close", "entry_close") - 1
    return trades.select("instrument_id", "entry_date", "entry_close", "exit_date", "exit_close", ret.alias("ret"), "bars_held", (ratio("__top", "entry_close") - 1).alias("mfe"), (ret > 0).alias("win"))


def overall(trades: DataFrame) -> DataFrame:
    """One row: trades, win rate, mean win and loss, profit factor (null without losses), mean bars held."""
    win, loss = F.when(F.col("win"), F.col("ret")), F.when(~F.col("win"), F.col("ret"))
    s = trades.agg(F.count("*").alias("total_trades"), F.avg(F.col("win").cast("double")).alias("win_rate"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.sum(win).alias("w"), F.sum(loss).alias("l"), F.avg("bars_held").alias("avg_bars_held"))
    return s.select("total_trades", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("win_rate", "avg_win", "avg_loss")), F.try_divide(F.coalesce("w", F.lit(0.0)), F.abs("l")).alias("profit_factor"), F.coalesce("avg_bars_held", F.lit(0.0)).alias("avg_bars_held"))


def per_instrument(trades: DataFrame) -> DataFrame:
    """Statistics of each instrument's trades."""
    win, loss = F.when(F.col("win"), F.col("ret")), F.when(~F.col("win"), F.col("ret"))
    return trades.groupBy("instrument_id").agg(
        F.count("*").alias("total_trades"), F.avg(F.col("win").cast("double")).alias("win_rate"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.min("ret").alias("worst"),
        F.median("ret").alias("median_ret"), F.median("bars_held").alias("median_bars"), F.median("mfe").alias("median_mfe"), F.sum("ret").alias("total_return"),
    )


def current_screen(cross: DataFrame) -> DataFrame:
    """Instruments that are above at the last row, with a golden as the last signal: bars since it and the return."""
    marked = cross.withColumn("__i", F.row_number().over(own()))
    event = F.when(F.col("signal").isNotNull(), F.col("__i"))
    last = marked.groupBy("instrument_id").agg(
        F.max("__i").alias("n"), F.max_by(F.col("ema_s") > F.col("ema_l"), "__i").alias("above"), F.max_by("close", "__i").alias("close"),
        F.max_by("signal", event).alias("s"), F.max(event).alias("at"), F.max_by("close", event).alias("c"),
    )
    return last.where("above AND s = 'golden'").select("instrument_id", (F.col("n") - F.col("at")).alias("bars_since"), "close", (ratio("close", "c") - 1).alias("unrealized_ret"))


def recent_golden(cross: DataFrame, stats: DataFrame, adv: DataFrame, max_bars_since: int = 20, min_adv: float = 0.0, min_samples: int = 3) -> DataFrame:
    """Recent goldens that are liquid enough, with their instrument's history; histories of a few trades go."""
    screen = current_screen(cross).where(F.col("bars_since") <= max_bars_since)
    if min_adv > 0:
        screen = screen.join(adv.where(F.col("adv") >= min_adv), "instrument_id", "left_semi")
    both = screen.join(stats.withColumnRenamed("total_trades", "n"), "instrument_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    both = both.withColumns({"progress_pct": ratio("bars_since", "median_bars"), "overheat_pct": ratio("unrealized_ret", "median_mfe")})
    return both.where((F.col("n") == 0) | (F.col("n") >= min_samples))


def bootstrap(trades: DataFrame, spark: SparkSession, sims: int, seed: int = 7, capital: float = 1000.0) -> DataFrame:
    """sim, ret, pnl: trades drawn with replacement, by the md5 of (seed, sim) modulo their number.

    Trades are numbered inside their instrument, after those of the instruments before it; only
    the counts, one row an instrument, pass through one task.
    """
    counts = trades.groupBy("instrument_id").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("instrument_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("instrument_id").orderBy("entry_date")) - 1
    numbered = trades.withColumn("__i", inside).join(counts.select("instrument_id", before.alias("__before")), "instrument_id").select((F.col("__before") + F.col("__i")).cast("bigint").alias("k"), "ret")
    n = trades.count()
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint") % max(n, 1)
    return spark.range(sims).select(F.col("id").alias("sim"), draw.alias("k")).join(numbered, "k").select("sim", "ret", (F.col("ret") * capital).alias("pnl"))


def bootstrap_summary(draws: DataFrame) -> DataFrame:
    """One row: mean, median, best, worst, share of wins, population deviation, total, mean return."""
    (median,) = exact_quantiles(draws, "pnl", [0.5])
    return draws.agg(
        F.avg("pnl").alias("mean_pnl"), F.lit(median).cast("double").alias("median_pnl"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.stddev_pop("pnl").alias("std_pnl"), F.sum("pnl").alias("total_pnl"), F.avg("ret").alias("mean_ret"),
    )


def percentiles(df: DataFrame, x: str, points: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """One row: linear percentiles p5, p25, ... of the whole table, exact; null without values."""
    found = exact_quantiles(df, x, [p / 100 for p in points])
    return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"p{p} double" for p in points))


def histogram(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """bin, n: equal widths between least and greatest, the last closed; one bin where these are equal."""
    ends = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    step = (F.col("__hi") - F.col("__lo")) / bins
    place = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col(x) - F.col("__lo"), step)), F.lit(bins - 1)))
    # the ends are one row
    return df.where(F.col(x).isNotNull()).join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def study(bars: DataFrame, daily: DataFrame, as_of: str, short: int = 60, long: int = 120) -> dict[str, DataFrame]:
    """All tables of the study: cross, trades, overall, per_instrument, recent."""
    cross = ema_cross(bars, short, long)
    trades = pair_trades(cross)
    stats = per_instrument(trades)
    return {"cross": cross, "trades": trades, "overall": overall(trades), "per_instrument": stats, "recent": recent_golden(cross, stats, adv_daily(daily, as_of))}
