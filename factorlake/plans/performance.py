"""Analytics over given net-value and trade tables, per key (a book, a strategy, or none)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.series import ratio
from factorlake.operators.asof import asof

YEAR = 252


def _order(keys: list[str]):  # noqa: ANN202
    """A key's days in order. Net values are one row a day and key."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")


def _upto(keys: list[str]):  # noqa: ANN202
    return _order(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def daily_returns(nav: DataFrame, keys: list[str], initial: float) -> DataFrame:
    """nav with daily_return (the first day against the initial capital) and cumulative_return."""
    before = F.coalesce(F.lag("nav").over(_order(keys)), F.lit(initial))
    return nav.withColumns({"daily_return": F.try_divide("nav", before) - 1, "cumulative_return": F.col("nav") / initial - 1})


def total_return(nav: DataFrame, keys: list[str], initial: float) -> DataFrame:
    """keys, total_return, annual_return by the number of days."""
    s = nav.groupBy(*keys).agg((F.max_by("nav", "date") / initial - 1).alias("total_return"), F.count("*").alias("n"))
    return s.select(*keys, "total_return", F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), YEAR / F.col("n")) - 1).alias("annual_return"))


def drawdowns(nav: DataFrame, keys: list[str], initial: float) -> DataFrame:
    """nav with peak (at least the initial capital), drawdown, peak_date and days since the peak.

    Until a first new peak the date is null and the days 0.
    """
    w = _upto(keys)
    df = nav.withColumn("peak", F.greatest(F.max("nav").over(w), F.lit(initial)))
    earlier = F.greatest(F.coalesce(F.max("nav").over(_order(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(initial)), F.lit(initial))
    df = df.withColumn("__new", F.when(F.col("nav") > earlier, F.col("date")))
    df = df.withColumn("peak_date", F.last("__new", ignorenulls=True).over(w)).drop("__new")
    return df.withColumns({"drawdown": (F.col("peak") - F.col("nav")) / F.col("peak"), "days_since_peak": F.coalesce(F.datediff("date", "peak_date"), F.lit(0))})


def max_drawdown(nav: DataFrame, keys: list[str], initial: float) -> DataFrame:
    """keys, max_drawdown, its first date, and the current drawdown."""
    s = drawdowns(nav, keys, initial).groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"), F.max_by("date", F.struct("drawdown", -F.unix_date("date"))).alias("max_drawdown_date"), F.max_by("drawdown", "date").alias("current_drawdown"))
    return s


def underwater(nav: DataFrame, keys: list[str], initial: float) -> DataFrame:
    """keys, start, end, depth of each stretch under the peak; an open one ends on the last date."""
    df = drawdowns(nav, keys, initial).withColumn("__u", F.col("drawdown") > 0)
    edge = (F.col("__u") != F.coalesce(F.lag("__u").over(_order(keys)), F.lit(False))).cast("int")
    df = df.withColumn("__e", edge).withColumn("__island", F.sum("__e").over(_upto(keys))).withColumn("__next", F.lead("date").over(_order(keys)))
    s = df.where("__u").groupBy(*keys, "__island").agg(F.min("date").alias("start"), F.max(F.coalesce("__next", "date")).alias("end"), F.max("drawdown").alias("depth"))
    return s.drop("__island")


def sharpe(returns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sharpe: a year's mean over deviation of all daily returns; null with 10 or fewer."""
    r = "daily_return"
    s = returns.groupBy(*keys).agg(F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.count(r).alias("n"))
    return s.select(*keys, F.when(F.col("n") > 10, F.try_divide(F.col("m") * YEAR, F.col("s") * math.sqrt(YEAR))).alias("sharpe"))


def sharpe_excess(returns: DataFrame, keys: list[str], risk_free: float = 0.03) -> DataFrame:
    """keys, sharpe_excess: of returns over a yearly rate, without days of no return; null with 10 or fewer."""
    r = returns.where("daily_return <> 0").withColumn("x", F.col("daily_return") - risk_free / YEAR)
    s = r.groupBy(*keys).agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("x").alias("n"))
    return s.select(*keys, F.when(F.col("n") > 10, F.try_divide(F.col("m"), F.col("s")) * math.sqrt(YEAR)).alias("sharpe_excess"))


def longest_deepening(nav: DataFrame, keys: list[str], initial: float) -> DataFrame:
    """keys, max_days: the longest time from the last point at which the running worst drawdown deepened to a later day before a new peak."""
    w = _upto(keys)
    df = drawdowns(nav, keys, initial)
    df = df.withColumn("__worst", F.max("drawdown").over(w))
    deeper = F.col("__worst") > F.coalesce(F.max("drawdown").over(_order(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("__d", F.when(deeper, F.col("date"))).withColumn("__new", (F.col("nav") >= F.col("peak")).cast("int"))
    df = df.withColumn("__peaks", F.sum("__new").over(w))
    inside = Window.partitionBy(*keys, "__peaks").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__since", F.last("__d", ignorenulls=True).over(inside))
    return df.groupBy(*keys).agg(F.coalesce(F.max(F.datediff("date", "__since")), F.lit(0)).alias("max_days"))


def curve_summary(returns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, first and last date, greatest and least net value, mean daily return."""
    return returns.groupBy(*keys).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("nav").alias("max_nav"), F.min("nav").alias("min_nav"), F.avg("daily_return").alias("avg_return"))


def compare(summary: DataFrame, by: str = "total_return", key: str = "book") -> DataFrame:
    """Strategies with their place by a measure, the unknown ones last; drawdown counts downwards."""
    order = F.col(by).asc_nulls_last() if by == "max_drawdown" else F.col(by).desc_nulls_last()
    return summary.withColumn("place", F.row_number().over(Window.orderBy(order, key)))  # one row a strategy


def trade_value() -> Column:
    return F.col("price") * F.col("shares")


def trade_summary(trades: DataFrame, keys: list[str], market: str = "US") -> DataFrame:
    """keys, trades by side, sum, mean, greatest and least value, sum of cost."""
    t = costs(trades, market)
    side = lambda s: F.count_if(F.col("side") == s)
    return t.groupBy(*keys).agg(F.count("*").alias("n"), side("BUY").alias("n_buy"), side("SELL").alias("n_sell"), F.sum("value").alias("sum_value"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value"), F.sum("cost").alias("sum_cost"))


def realised(trades: DataFrame, keys: list[str]) -> DataFrame:
    """keys, instrument_id, n_sells, winners, losers, pnl of sells against the mean price of all buys of the key and instrument.

    Without buys the signal price counts, or else the sell's own price (pnl 0).
    """
    own = [*keys, "instrument_id"]
    buys = trades.where("side = 'BUY'").groupBy(*own).agg((F.sum(trade_value()) / F.sum("shares")).alias("avg_cost"))
    signal = F.col("signal_price") if "signal_price" in trades.columns else F.col("price")
    sells = trades.where("side = 'SELL'").join(buys, own, "left").withColumn("pnl", (F.col("price") - F.coalesce("avg_cost", signal, "price")) * F.col("shares"))
    return sells.groupBy(*own).agg(F.count("*").alias("n_sells"), F.count_if(F.col("pnl") > 0).alias("winners"), F.count_if(F.col("pnl") < 0).alias("losers"), F.sum("pnl").alias("pnl"))


def slippage_stats(sells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, win_rate, avg_profit, avg_loss, profit_ratio of sell prices against signal prices."""
    d = ratio("price", "signal_price") - 1
    s = sells.withColumn("d", d).groupBy(*keys).agg(F.avg((F.col("d") > 0).cast("double")).alias("win_rate"), F.avg(F.when(F.col("d") > 0, F.col("d"))).alias("avg_profit"), F.avg(F.when(F.col("d") < 0, -F.col("d"))).alias("avg_loss"))
    return s.withColumn("profit_ratio", F.try_divide("avg_profit", "avg_loss"))


#: Commission rate and least commission, stamp duty on sells, transfer fee, per market.
RATES = {"CN": (0.0003, 5.0, 0.001, 0.00001), "US": (0.0005, 0.0, 0.0, 0.0), "HK": (0.0005, 0.0, 0.001, 0.0), "NONE": (0.0, 0.0, 0.0, 0.0)}


def costs(trades: DataFrame, market: str = "CN", rates: tuple[float, float, float, float] | None = None) -> DataFrame:
    """trades with value, commission, stamp, transfer and cost; a value of 0 or less costs nothing."""
    rate, least, stamp, transfer = rates or RATES[market.upper()]
    v = F.col("value")
    paid = lambda c: F.when(v > 0, c).otherwise(F.lit(0.0))
    df = trades.withColumn("value", trade_value())
    df = df.withColumns({"commission": paid(F.greatest(v * rate, F.lit(least))), "stamp": paid(F.when(F.col("side") == "SELL", v * stamp).otherwise(F.lit(0.0))), "transfer": paid(v * transfer)})
    return df.withColumn("cost", F.col("commission") + F.col("stamp") + F.col("transfer"))


def fills(orders: DataFrame, bars: DataFrame, rule: str = "open", slippage_bps: float = 0.0, lag_days: int = 1) -> DataFrame:
    """orders (instrument_id, date, side, limit_price) with fill_date, fill_price and status.

    The bar is the one `lag_days` bars after the order's day (0: the same day). rule: `open`,
    `close` or `limit` (a buy fills if low <= limit, a sell if high >= limit). Slippage goes
    against the side. Without a bar on its day, or that many later, an order is rejected.
    """
    w = Window.partitionBy("instrument_id").orderBy("date")
    ahead = lambda c: F.lead(c, lag_days).over(w) if lag_days else F.col(c)
    quotes = bars.select("instrument_id", "date", ahead("date").alias("fill_date"), *(ahead(c).alias(f"__{c}") for c in ("open", "high", "low", "close")))
    df = orders.join(quotes, ["instrument_id", "date"], "left")
    buy = F.col("side") == "BUY"
    if rule == "limit":
        reached = F.when(buy, F.col("__low") <= F.col("limit_price")).otherwise(F.col("__high") >= F.col("limit_price"))
        price = F.when(reached, F.col("limit_price"))
    elif rule in ("open", "close"):
        price = F.col(f"__{rule}")
    else:
        raise ValueError("rule is open, close or limit")
    price = price * F.when(buy, 1 + slippage_bps / 1e4).otherwise(1 - slippage_bps / 1e4)
    status = F.when(F.col("fill_date").isNull(), "rejected").when(price.isNull(), "unfilled").otherwise("filled")
    return df.withColumns({"fill_price": price, "status": status}).drop("__open", "__high", "__low", "__close")


def positions(trades: DataFrame, keys: list[str]) -> DataFrame:
    """trades with shares_after (running, sells negative) of the key and instrument."""
    w = Window.partitionBy(*keys, "instrument_id").orderBy("date", "trade_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trades.withColumn("shares_after", F.sum(F.when(F.col("side") == "BUY", F.col("shares")).otherwise(-F.col("shares"))).over(w))


def book_value(trades: DataFrame, prices: DataFrame, keys: list[str], initial: float) -> DataFrame:
    """keys, date, cash, position_value, nav after each trading day of a key.

    Cash is the initial capital and all signed flows so far; each instrument the key ever traded
    by then is valued at its last close. Nothing is rejected, and lots don't matter.
    """
    signed = F.when(F.col("side") == "BUY", F.col("shares")).otherwise(-F.col("shares"))
    days = trades.groupBy(*keys, "date").agg(F.sum(-signed * F.col("price")).alias("flow"))
    cash = days.withColumn("cash", F.lit(initial) + F.sum("flow").over(_upto(keys)))
    moves = trades.groupBy(*keys, "instrument_id", "date").agg(F.sum(signed).alias("d"))
    held = moves.select(*keys, "instrument_id").distinct().join(days.select(*keys, "date"), keys)
    w = Window.partitionBy(*keys, "instrument_id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = held.join(moves, [*keys, "instrument_id", "date"], "left").withColumn("shares", F.sum(F.coalesce("d", F.lit(0))).over(w))
    valued = asof(shares.select(*keys, "instrument_id", "date", "shares"), prices.select("instrument_id", "date", "close"), ["close"])
    total = valued.groupBy(*keys, "date").agg(F.sum(F.col("shares") * F.coalesce("close", F.lit(0.0))).alias("position_value"))
    return cash.join(total, [*keys, "date"]).select(*keys, "date", "cash", "position_value", (F.col("cash") + F.col("position_value")).alias("nav"))


def sector_weights(holdings: DataFrame, sectors: DataFrame) -> DataFrame:
    """date, sector (`Unknown` without one), weight of the holdings' (instrument_id, date, value) total."""
    df = asof(holdings, sectors, ["sector"]).withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    s = df.groupBy("date", "sector").agg(F.sum("value").alias("v"))
    return s.select("date", "sector", F.try_divide("v", F.sum("v").over(Window.partitionBy("date"))).alias("weight"))


def largest_position(holdings: DataFrame) -> DataFrame:
    """date, largest_pct: the greatest holding's share of the total."""
    return holdings.groupBy("date").agg(F.try_divide(F.max("value"), F.sum("value")).alias("largest_pct"))
