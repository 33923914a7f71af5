"""Screens over all dates at once: each returns signal rows (instrument_id, date, ...) without positions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from factorlake.functions import indicators as ind
from factorlake.functions.registry import SCREENS
from factorlake.functions.series import by_blocks, lag, own, ratio, span_alpha, with_ema
from factorlake.operators.asof import asof
from factorlake.operators.next_event import first_exits


@SCREENS("regression_momentum")
def regression_momentum(panel: DataFrame, universe: DataFrame | None = None, sectors: DataFrame | None = None, top: int = 20, max_per_sector: int | None = None, period: int = 90, trend: int = 200, worst: float = -0.15, risk: float = 0.001, nav: float = 1_000_000.0, stop: float = 3.0) -> DataFrame:
    """Steady climbers: above the long mean, no crash, positive regression score; the best by score.

    Adds what a list shows: shares by ATR risk, deviation from the mean, drawdown from the 63-row
    high, volume multiple, stop price and alerts. Rows without a usable ATR or size go after ranking.
    """
    df = panel
    for f, p in ((ind.ma, trend), (ind.min_daily_return, period), (ind.clenow_score, period), (ind.atr, 20), (ind.hh, 63), (ind.vma, 20)):
        df = f(df, p)
    df = df.where((F.col("close") > F.col(f"MA_{trend}")) & (F.col(f"MIN_DAILY_RETURN_{period}") >= worst) & (F.col("CLENOW_SCORE") > 0))
    if universe is not None:
        df = df.join(universe.select("instrument_id", "date"), ["instrument_id", "date"], "left_semi")
    best = [F.desc("CLENOW_SCORE"), F.col("instrument_id")]
    if max_per_sector is not None:
        df = asof(df, sectors, ["sector"]) if sectors is not None else df.withColumn("sector", F.lit(None).cast("string"))
        df = df.withColumn("__s", F.row_number().over(Window.partitionBy("date", "sector").orderBy(*best))).where(F.col("__s") <= max_per_sector).drop("__s")
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(*best))).where(F.col("rank") <= top)
    atr = F.col("ATR_20")
    df = df.withColumns({
        "shares": F.floor(F.try_divide(F.lit(nav * risk), atr)).cast("bigint"), "deviation_pct": (ratio("close", f"MA_{trend}") - 1) * 100,
        "drawdown_pct": (ratio("close", "HH_63") - 1) * 100, "volume_multiple": ratio("volume", "VMA_20"), "stop_price": F.col("close") - stop * atr,
    })
    df = df.where((atr > 0) & (F.col("shares") >= 1))
    notes = F.array(F.when(F.col("deviation_pct") > 50, "extended"), F.when(F.col("drawdown_pct") < -15, "pulled back"), F.when(F.col("volume_multiple") > 3, "volume spike"))
    return df.withColumn("alerts", F.array_join(F.filter(notes, lambda x: x.isNotNull()), ","))


def regime_days(benchmark: DataFrame, regime: int | None) -> DataFrame:
    """date, bench, regime_ok: whether the benchmark is above its own mean of `regime` rows, or that mean is unknown or not asked for."""
    bench = benchmark.select("date", F.col("close").alias("bench"))
    if not regime:
        return bench.withColumn("regime_ok", F.lit(True))
    w = Window.orderBy("date").rowsBetween(1 - regime, 0)  # one row a date
    mean = F.when(F.count("bench").over(w) == regime, F.avg("bench").over(w))
    return bench.withColumn("regime_ok", F.coalesce(F.col("bench") > mean, F.lit(True)))


@SCREENS("relative_strength")
def relative_strength(panel: DataFrame, benchmark: DataFrame, fast: int = 60, slow: int = 120, min_adv: float = 0.0, top: int = 10, regime: int | None = 200) -> DataFrame:
    """Rising ratio to a benchmark (date, close): fast over slow average of the ratio, the best by their distance.

    Days without the benchmark drop out. With `regime`, a day counts only where the benchmark is
    above its own mean of so many rows, or that mean is unknown.
    """
    df = panel.join(regime_days(benchmark, regime), "date").withColumn("rs", ratio("close", "bench")).where("rs IS NOT NULL")
    df = with_ema(df, {"rs_fast": ("rs", span_alpha(fast)), "rs_slow": ("rs", span_alpha(slow))})
    df = ind.adv(df, 20).withColumn("__n", F.row_number().over(own()))
    keep = (F.col("__n") > slow) & (F.col("rs_fast") > F.col("rs_slow")) & (F.col("ADV_20") >= min_adv) & F.col("regime_ok")
    df = df.where(keep).withColumn("score", ratio("rs_fast", "rs_slow") - 1)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "instrument_id"))).where(F.col("rank") <= top).drop("__n")


def weekly_asof(panel: DataFrame, weekly: DataFrame, period: int = 20, back: int = 1) -> DataFrame:
    """The panel with the weekly average at the last weekly bar up to the date, and `back` bars before it."""
    w = with_ema(weekly.select("instrument_id", "date", "close"), {"week_ema": ("close", span_alpha(period))})
    return asof(panel, w.withColumn("week_ema_before", lag("week_ema", back)), ["week_ema", "week_ema_before"])


@SCREENS("cluster_pullback")
def cluster_pullback(panel: DataFrame, weekly: DataFrame, benchmark: DataFrame | None = None, cluster: float = 0.04, near: float = 0.025, back: int = 20, min_adv: float = 0.0, confirm: int = 1, regime: int | None = None) -> DataFrame:
    """Averages of 20, 60 and 120 rows close together and rising, the close near the weekly average, `confirm` rows long.

    With a benchmark, days without its close drop out; with `regime`, so do days on which it is
    not above its mean of so many rows.
    """
    df = with_ema(panel, {f"ema_{p}": ("close", span_alpha(p)) for p in (20, 60, 120)})
    df = ind.adv(df, 20).withColumn("ema_120_before", lag("ema_120", back))
    df = weekly_asof(df, weekly)
    if benchmark is not None:
        df = df.join(regime_days(benchmark, regime).where("regime_ok").select("date"), "date", "left_semi")
    low, high = F.least("ema_20", "ema_60", "ema_120"), F.greatest("ema_20", "ema_60", "ema_120")
    ok = (
        (ratio(high - low, low) < cluster) & (F.abs(ratio(F.col("close") - F.col("week_ema"), "week_ema")) < near)
        & (F.col("ema_120") > F.col("ema_120_before")) & (F.col("week_ema") > F.col("week_ema_before")) & (F.col("ADV_20") >= min_adv)
    )
    df = df.withColumn("all_ok", F.coalesce(ok, F.lit(False)).cast("int"))
    w = own().rowsBetween(1 - confirm, 0)
    return df.withColumn("__c", F.when(F.count("all_ok").over(w) == confirm, F.min("all_ok").over(w))).where("__c = 1").drop("__c", "all_ok")


def first_exit(entries: DataFrame, panel: DataFrame, levels: dict[str, tuple[str, Column]], events: dict[str, Column]) -> DataFrame:
    """entries (instrument_id, entry_date, ...) with exit_date and exit_rule: the first later day that a rule holds.

    `levels`: name -> (a column of the panel, the entry's level), a rule that holds at or under the
    level; `events`: name -> a condition on the panel alone. Of rules on one day the first named
    counts, levels first. No entry is joined with its later bars, and panel and entries are read
    once: of their union the days up to an entry's first event are kept; there events are a
    window's least day ahead, levels are searched through blocks.
    """
    values = sorted({value for value, _ in levels.values()})
    flags = {n: f"__event{k}" for k, n in enumerate(events)}
    days = panel.select("instrument_id", "date", *values, *(c.alias(flags[n]) for n, c in events.items()))
    asked = entries.select("instrument_id", F.col("entry_date").alias("date"), F.struct(*entries.columns).alias("__asked"))
    rows = days.unionByName(asked, allowMissingColumns=True)
    return _ruled(rows, F.col("__asked"), F.col("__asked").isNotNull(), levels, {n: F.col(c) for n, c in flags.items()}, own())


def _ruled(rows: DataFrame, asked: Column, entry: Column, levels: dict[str, tuple[str, Column]], events: dict[str, Column], order: WindowSpec) -> DataFrame:
    """first_exits with the first of their days, and the rule that it is of."""
    out = first_exits(rows, asked, entry, {f"__{n}": x for n, x in levels.items()}, {f"__{n}": c for n, c in events.items()}, order)
    days = [f"__{n}" for n in (*levels, *events)]
    first = F.least(*days) if len(days) > 1 else F.col(days[0])
    out = out.withColumn("exit_date", first)
    return out.withColumn("exit_rule", F.coalesce(*(F.when(F.col(d) == F.col("exit_date"), d[2:]) for d in days))).drop(*days)


def pullback_exits(entries: DataFrame, panel: DataFrame, stop: float = 0.92, below_days: int = 3) -> DataFrame:
    """Exits of cluster pullbacks: a close at or under the stop, or under the 60-row average for some days."""
    df = with_ema(panel.select("instrument_id", "date", "close"), {"ema_60": ("close", span_alpha(60))})
    under = (F.col("close") < F.col("ema_60")).cast("int")
    w = own().rowsBetween(1 - below_days, 0)
    df = df.withColumn("__u", F.sum(under).over(w))
    return first_exit(entries, df, {"stop": ("close", F.col("entry_close") * stop)}, {"trend": F.col("__u") == below_days})


def _pivot_rows(panel: DataFrame) -> DataFrame:
    """What the gap pivot looks at, as columns, with `__block`: all windows share two sorts."""
    c = F.col
    before = own().rowsBetween(-20, -1)
    value = c("close") * c("volume")
    # the mean of the 20 rows before is the row before's mean of 20
    df = ind.adv(panel, 20).withColumns({
        "__range": ind.true_range(), "gap": ratio("open", lag("close")) - 1, "adv_before": F.when(F.count(value).over(before) == 20, F.avg(value).over(before)),
        "dollar_volume": value, "close_place": ratio(c("close") - c("low"), c("high") - c("low")),
    })
    averages = {f"ema_{p}": ("close", span_alpha(p)) for p in (10, 50, 200)} | {f"ATR_{p}": ("__range", 1 / p) for p in (10, 30)}
    df = with_ema(df, averages, blocks=True).drop("__range")
    return df.withColumns({f"atr{p}_before": F.lag(f"ATR_{p}").over(by_blocks()) for p in (10, 30)})


def pivot_columns(panel: DataFrame) -> DataFrame:
    """What the gap pivot looks at, as columns."""
    return _pivot_rows(panel).drop("__block")


def pivot_filters(min_gap: float = 0.05, volume_multiple: float = 3.0, place: float = 0.8, contraction: float | None = None, min_adv: float = 20e6, off: tuple[str, ...] = ()) -> dict[str, Column]:
    """The pivot's filters in their order; `off` switches some off."""
    c = F.col
    filters = {
        "gap": c("gap") >= min_gap, "volume": c("dollar_volume") >= volume_multiple * c("adv_before"), "close_place": c("close_place") >= place,
        "trend": (c("close") > c("ema_50")) & (c("ema_50") > c("ema_200")), "liquidity": c("adv_before") >= min_adv,
    }
    if contraction is not None:
        filters["contraction"] = c("atr10_before") < contraction * c("atr30_before")
    return {k: F.coalesce(v, F.lit(False)) for k, v in filters.items() if k not in off}


@SCREENS("gap_pivot")
def gap_pivot(panel: DataFrame, **params) -> DataFrame:
    """Gap up on volume that closes near its high in an uptrend."""
    df = pivot_columns(panel)
    for keep in pivot_filters(**params).values():
        df = df.where(keep)
    return df


def rejection_funnel(panel: DataFrame, **params) -> DataFrame:
    """reason, n: rows by the first filter that they fail; `passed` for those that fail none."""
    reason = F.coalesce(*(F.when(~keep, name) for name, keep in pivot_filters(**params).items()), F.lit("passed"))
    return pivot_columns(panel).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def pivot_rules() -> tuple[dict[str, tuple[str, Column]], dict[str, Column]]:
    """Levels and events that end a gap pivot."""
    return {"pivot low": ("low", F.col("entry_low"))}, {"average": F.col("close") < F.col("ema_10")}


def pivot_exits(entries: DataFrame, panel: DataFrame) -> DataFrame:
    """Exits of gap pivots: a low at or under the pivot day's low, or a close under the 10-row average."""
    df = with_ema(panel.select("instrument_id", "date", "close", "low"), {"ema_10": ("close", span_alpha(10))})
    return first_exit(entries, df, *pivot_rules())


def pivots_with_exits(panel: DataFrame, **params) -> DataFrame:
    """instrument_id, entry_date, entry_low, exit_date, exit_rule: the pivots of gap_pivot with their pivot_exits, by one reading of the panel."""
    entry = reduce(and_, pivot_filters(**params).values())
    asked = F.struct("instrument_id", F.col("date").alias("entry_date"), F.col("low").alias("entry_low"))
    return _ruled(_pivot_rows(panel), asked, entry, *pivot_rules(), by_blocks())


@SCREENS("rumi")
def rumi(panel: DataFrame, changes_only: bool = False, **params) -> DataFrame:
    """BUY where the indicator is positive, SELL where negative; `changes_only` keeps the rows where that turns."""
    df = ind.rumi(panel, **params).withColumn("direction", F.when(F.col("RUMI") > 0, "BUY").when(F.col("RUMI") < 0, "SELL")).where("direction IS NOT NULL")
    if changes_only:
        df = df.withColumn("__b", lag("direction")).where("__b IS NULL OR __b <> direction").drop("__b")
    return df


def report(signals: DataFrame, history: DataFrame, sector_names: DataFrame | None = None) -> DataFrame:
    """Signals with their instrument's history, percentages rounded to 2 places, stars by its number, and a fit label."""
    h = history.select("instrument_id", F.col("n").alias("n_history"), F.round(F.col("mean_ret_20") * 100, 2).alias("mean_ret_20_pct"), F.round(F.col("hit_rate_20") * 100, 2).alias("hit_rate_20_pct"))
    out = signals.join(h, "instrument_id", "left").withColumn("n_history", F.coalesce("n_history", F.lit(0)))
    n = F.col("n_history")
    out = out.withColumn("stars", F.when(n >= 10, 3).when(n >= 5, 2).when(n > 0, 1).otherwise(0))
    if "CLENOW_R2" in signals.columns:
        r = F.col("CLENOW_R2")
        out = out.withColumn("fit", F.when(r >= 0.85, "excellent").when(r >= 0.75, "good").when(r >= 0.65, "fair").otherwise("weak"))
    return out.join(sector_names, "sector", "left") if sector_names is not None and "sector" in signals.columns else out


def direction_counts(signals: DataFrame) -> DataFrame:
    """direction, n."""
    return signals.groupBy("direction").agg(F.count("*").alias("n"))
