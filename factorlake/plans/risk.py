"""Constraints on a day's signals, tested against the day's opening snapshot.

A rule is a Boolean Column that is true where a signal is rejected, over the columns
direction, price, shares (the order), held_value, cash, equity, n_positions (the snapshot) and
whatever else its docstring names. Rules run in order and the first that is true gives its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.registry import RULES
from factorlake.functions.series import lag, rolling


def _buy() -> Column:
    return F.col("direction") == "BUY"


def _order() -> Column:
    return F.col("price") * F.col("shares")


@RULES("universe")
def universe() -> Column:
    """Outside the universe (in_universe), either side."""
    return ~F.coalesce("in_universe", F.lit(False))


@RULES("duplicate")
def duplicate() -> Column:
    """A buy of what is held."""
    return _buy() & (F.col("held_value") > 0)


@RULES("position_size")
def position_size(pct: float = 0.1) -> Column:
    """Holding and order over a share of equity."""
    return _buy() & (F.try_divide(F.col("held_value") + _order(), F.col("equity")) > pct)


@RULES("order_size")
def order_size(pct: float = 0.1) -> Column:
    """The order alone over a share of equity."""
    return _buy() & (F.try_divide(_order(), F.col("equity")) > pct)


@RULES("max_positions")
def max_positions(most: int = 20, exempt_held: bool = False) -> Column:
    """As many positions as allowed; exempt_held lets more of what is held through."""
    full = _buy() & (F.col("n_positions") >= most)
    return full & (F.col("held_value") <= 0) if exempt_held else full


@RULES("min_capital")
def min_capital(reserve: float = 0.0) -> Column:
    """Cash under the order, or what is left under the reserve."""
    return _buy() & ((F.col("cash") < _order()) | (F.col("cash") - _order() < reserve))


@RULES("sector_concentration")
def sector_concentration(pct: float = 0.3) -> Column:
    """The sector's weight (sector_weight) and the order over a share of equity."""
    return _buy() & (F.coalesce("sector_weight", F.lit(0.0)) + F.try_divide(_order(), F.col("equity")) > pct)


@RULES("liquidity")
def liquidity(min_volume: float = 0.0, min_turnover: float = 0.0, use_adv: bool = False) -> Column:
    """Volume (or adv_volume), or its worth, under a least; unknown fails."""
    v = F.col("adv_volume" if use_adv else "volume")
    return F.coalesce((v < min_volume) | (v * F.col("price") < min_turnover), F.lit(True))


@RULES("price_limit")
def price_limit(limit: float = 0.10, tolerance: float = 0.001, exempt: bool = False) -> Column:
    """A buy at the upper or a sell at the lower limit of the close before (prev_close)."""
    if exempt:
        return F.lit(False)
    move = F.try_divide("price", "prev_close") - 1
    return F.coalesce(F.when(_buy(), move >= limit - tolerance).otherwise(move <= -limit + tolerance), F.lit(False))


@RULES("sector_neutral")
def sector_neutral(deviation: float = 0.05) -> Column:
    """Sector weight and order further from the benchmark's (bench_weight) than allowed."""
    now = F.coalesce("sector_weight", F.lit(0.0)) + F.try_divide(_order(), F.col("equity"))
    return _buy() & (F.abs(now - F.coalesce("bench_weight", F.lit(0.0))) > deviation)


@RULES("drawdown_halt")
def drawdown_halt() -> Column:
    """A buy while the book is halted (halted)."""
    return _buy() & F.coalesce("halted", F.lit(False))


def gate(signals: DataFrame, rules: list[tuple[str, dict]]) -> DataFrame:
    """signals with reject_rule: the first rule that rejects, or null. The snapshot isn't updated between signals."""
    return signals.withColumn("reject_rule", F.coalesce(*(F.when(RULES.find(name)(**params), name) for name, params in rules), F.lit(None).cast("string")))


def gate_stats(gated: DataFrame) -> DataFrame:
    """One row: signals, rejected, their share and the most common rule (ties by name)."""
    by = gated.groupBy("reject_rule").agg(F.count("*").alias("n"))
    rejected = F.when(F.col("reject_rule").isNotNull(), F.col("n"))
    return by.agg(F.sum("n").alias("total"), F.coalesce(F.sum(rejected), F.lit(0)).alias("rejected"), F.coalesce(F.try_divide(F.sum(rejected), F.sum("n")), F.lit(0.0)).alias("rejection_rate"), F.min_by("reject_rule", F.when(F.col("reject_rule").isNotNull(), F.struct(-F.col("n"), F.col("reject_rule")))).alias("most_common"))


def with_market(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """signals with the day's volume, prev_close and 20-row mean volume of their instrument."""
    m = bars.select("instrument_id", "date", "volume", lag("close").alias("prev_close"), rolling(F.avg, "volume", 20).alias("adv_volume"))
    return signals.join(m, ["instrument_id", "date"], "left")


def benchmark_weights(sector_weights: DataFrame) -> DataFrame:
    """date, sector, bench_weight: equal over the sectors present."""
    return sector_weights.select("date", "sector", (1.0 / F.count("*").over(Window.partitionBy("date"))).alias("bench_weight"))


def halts(drawdowns: DataFrame, keys: list[str], halt: float = 0.10, resume: float = 0.05) -> DataFrame:
    """drawdowns (keys, date, drawdown) with halted: from over `halt` until `resume` or less, every day."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("drawdown") > halt, True).when(F.col("drawdown") <= resume, False)
    return drawdowns.withColumn("halted", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))
