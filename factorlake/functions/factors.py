"""Named factors over a panel. Each returns the panel with one more column.

Price factors need the bar columns; fundamental ones the columns that operators.asof.enrich adds
(a column that is absent counts as null); sector ones a table of sector assignments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions import indicators
from factorlake.functions.registry import FACTORS
from factorlake.functions.series import average_rank, change, count_in, half_life_alpha, lag, own, ratio, rolling, span_alpha, with_ema


def compute(df: DataFrame, name: str, **params) -> tuple[DataFrame, str]:
    """The panel with the factor's column, and the column's name."""
    out = FACTORS.find(name)(df, **params)
    return out, next(c for c in reversed(out.columns) if c not in df.columns or c == name)


def present(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def _volatility(df: DataFrame, period: int, out: str) -> DataFrame:
    df = df.withColumn("__ret", change("close"))
    return df.withColumn(out, rolling(F.stddev_samp, "__ret", period) * math.sqrt(indicators.YEAR)).drop("__ret")


@FACTORS("momentum")
def momentum(df: DataFrame, period: int = 10) -> DataFrame:
    """Percent change of the close over the period."""
    return df.withColumn("momentum", change("close", period) * 100)


@FACTORS("returns")
def returns(df: DataFrame) -> DataFrame:
    """Percent change from row to row."""
    return df.withColumn("returns", change("close") * 100)


@FACTORS("volatility")
def volatility(df: DataFrame, period: int = 20) -> DataFrame:
    """Sample deviation of simple returns, a year's."""
    return _volatility(df, period, "volatility")


@FACTORS("volume_ratio")
def volume_ratio(df: DataFrame, period: int = 20) -> DataFrame:
    """Volume over its mean."""
    return df.withColumn(f"volume_ratio_{period}", ratio("volume", rolling(F.avg, "volume", period)))


@FACTORS("price_range")
def price_range(df: DataFrame) -> DataFrame:
    """(high - low) / close."""
    return df.withColumn("price_range", ratio(F.col("high") - F.col("low"), "close"))


@FACTORS("gap")
def gap(df: DataFrame) -> DataFrame:
    """Open against the close before, a fraction."""
    return df.withColumn("gap", ratio(F.col("open") - lag("close"), lag("close")))


@FACTORS("intraday_return")
def intraday_return(df: DataFrame) -> DataFrame:
    """Close against the open, a fraction."""
    return df.withColumn("intraday_return", ratio(F.col("close") - F.col("open"), "open"))


@FACTORS("overnight_return")
def overnight_return(df: DataFrame) -> DataFrame:
    """The gap in percent."""
    return df.withColumn("overnight_return", ratio(F.col("open") - lag("close"), lag("close")) * 100)


@FACTORS("turnover")
def turnover(df: DataFrame) -> DataFrame:
    """The turnover column, 0 without one."""
    return df.withColumn("turnover", F.col("turnover") if "turnover" in df.columns else F.lit(0.0))


@FACTORS("relative_strength")
def relative_strength(df: DataFrame, period: int = 20) -> DataFrame:
    """Percent change over the period; screens.relative_strength has the ratio to a benchmark."""
    return df.withColumn("relative_strength", change("close", period) * 100)


@FACTORS("max_drawdown")
def max_drawdown(df: DataFrame, period: int = 20) -> DataFrame:
    """Close against the rolling highest close, 0 or less."""
    top = rolling(F.max, "close", period)
    return df.withColumn("max_drawdown", ratio(F.col("close") - top, top))


@FACTORS("sharpe_proxy")
def sharpe_proxy(df: DataFrame, return_period: int = 10, vol_period: int = 20) -> DataFrame:
    """Change over one period by the deviation of returns over another."""
    df = df.withColumn("__ret", change("close"))
    return df.withColumn("sharpe_proxy", ratio(change("close", return_period), rolling(F.stddev_samp, "__ret", vol_period))).drop("__ret")


@FACTORS("price_momentum")
def price_momentum(df: DataFrame, period: int = 10) -> DataFrame:
    """Percent change under a name with its period."""
    return df.withColumn(f"momentum_{period}", change("close", period) * 100)


def _rank_of_all(df: DataFrame, value: str, out: str, ascending: bool) -> DataFrame:
    """Average rank within the date over the count of all its rows; ascending turns it round."""
    r = ratio(average_rank(value, "date"), count_in(["date"]))
    return df.withColumn(out, 1 - r if ascending else r)


@FACTORS("momentum_rank")
def momentum_rank(df: DataFrame, period: int = 10, ascending: bool = False) -> DataFrame:
    """Rank of the momentum within the date."""
    df = df.withColumn("__m", change("close", period) * 100)
    return _rank_of_all(df, "__m", f"momentum_rank_{period}", ascending).drop("__m")


@FACTORS("price_volatility")
def price_volatility(df: DataFrame, period: int = 20) -> DataFrame:
    """Volatility under a name with its period."""
    return _volatility(df, period, f"volatility_{period}")


@FACTORS("volatility_rank")
def volatility_rank(df: DataFrame, period: int = 20, ascending: bool = False) -> DataFrame:
    """Rank of the volatility within the date."""
    return _rank_of_all(_volatility(df, period, "__v"), "__v", f"volatility_rank_{period}", ascending).drop("__v")


@FACTORS("clenow_momentum")
def clenow_momentum(df: DataFrame, period: int = 90) -> DataFrame:
    """The regression momentum score."""
    out = indicators.clenow_score(df, period).drop("CLENOW_SLOPE", "CLENOW_R2")
    return out.withColumnRenamed("CLENOW_SCORE", f"clenow_momentum_{period}")


@FACTORS("turnover_rate")
def turnover_rate(df: DataFrame) -> DataFrame:
    """Volume over shares outstanding."""
    return df.withColumn("turnover_rate", ratio("volume", present(df, "shares_outstanding")))


@FACTORS("ma_bias")
def ma_bias(df: DataFrame, period: int = 20, ma_type: str = "SMA") -> DataFrame:
    """Close against its mean, simple or exponential (by half-life, adjusted weights)."""
    out = f"ma_bias_{period}_{ma_type}"
    if ma_type == "SMA":
        return df.withColumn(out, ratio("close", rolling(F.avg, "close", period)) - 1)
    df = with_ema(df, {"__e": ("close", half_life_alpha(period), True)})
    return df.withColumn(out, ratio("close", "__e") - 1).drop("__e")


@FACTORS("ema_alignment")
def ema_alignment(df: DataFrame, fast: int = 20, mid: int = 60, slow: int = 120) -> DataFrame:
    """Least of close over fast, fast over mid and mid over slow average, each less 1 (by span, adjusted weights)."""
    df = with_ema(df, {"__f": ("close", span_alpha(fast), True), "__m": ("close", span_alpha(mid), True), "__s": ("close", span_alpha(slow), True)})
    least = F.least(ratio("close", "__f") - 1, ratio("__f", "__m") - 1, ratio("__m", "__s") - 1)
    return df.withColumn(f"ema_alignment_{fast}_{mid}_{slow}", least).drop("__f", "__m", "__s")


def _by_sector(df: DataFrame, sectors: DataFrame | None) -> DataFrame:
    """The panel with each row's sector as of its date."""
    from factorlake.operators.sectors import with_sector

    return with_sector(df, sectors) if sectors is not None else df.withColumn("sector", F.lit(None).cast("string"))


def _middle(x: str, aggregation: str) -> Column:
    """Mean or median of a column among the rows of a date and sector; null without a sector."""
    if aggregation not in ("mean", "median"):
        raise ValueError("aggregation is mean or median")
    w = Window.partitionBy("date", "sector")
    return F.when(F.col("sector").isNotNull(), (F.avg if aggregation == "mean" else F.median)(x).over(w))


@FACTORS("sector_momentum")
def sector_momentum(df: DataFrame, period: int = 10, aggregation: str = "mean", sectors: DataFrame | None = None) -> DataFrame:
    """Mean or median momentum of a row's sector on its date, for every member."""
    df = _by_sector(df.withColumn("__m", change("close", period) * 100), sectors)
    return df.withColumn(f"sector_momentum_{period}", _middle("__m", aggregation)).drop("__m", "sector")


@FACTORS("sector_relative_strength")
def sector_relative_strength(df: DataFrame, period: int = 10, aggregation: str = "mean", sectors: DataFrame | None = None) -> DataFrame:
    """Own momentum less the sector's."""
    df = _by_sector(df.withColumn("__m", change("close", period) * 100), sectors)
    return df.withColumn(f"sector_relative_strength_{period}", F.col("__m") - _middle("__m", aggregation)).drop("__m", "sector")


def _base(df: DataFrame, factor_name: str) -> DataFrame:
    """A factor with its default parameters as __base; null for names that aren't registered."""
    if factor_name not in FACTORS:
        return df.withColumn("__base", F.lit(None).cast("double"))
    out, name = compute(df, factor_name)
    return out.withColumnRenamed(name, "__base")


@FACTORS("rank_within_sector")
def rank_within_sector(df: DataFrame, factor_name: str = "momentum", ascending: bool = False, sectors: DataFrame | None = None) -> DataFrame:
    """Average rank of a factor in its date and sector over the count of its values there; the highest first unless ascending."""
    df = _by_sector(_base(df, factor_name), sectors)
    r = ratio(average_rank("__base", "date", "sector", descending=not ascending), count_in(["date", "sector"], "__base"))
    return df.withColumn(f"rank_within_sector_{factor_name}", F.when(F.col("sector").isNotNull(), r)).drop("__base", "sector")


@FACTORS("demean_by_sector")
def demean_by_sector(df: DataFrame, factor_name: str = "momentum", method: str = "mean", sectors: DataFrame | None = None) -> DataFrame:
    """A factor less its mean or median in the date and sector."""
    df = _by_sector(_base(df, factor_name), sectors)
    return df.withColumn(f"demean_{factor_name}", F.col("__base") - _middle("__base", method)).drop("__base", "sector")


#: Factors that pass a column on.
PASSED = {
    "fund_roe": "roe", "fund_roic": "roic", "fund_net_margin": "net_margin", "fund_op_margin": "op_margin",
    "fund_revenue_yoy": "revenue_yoy", "fund_net_income_yoy": "net_income_yoy",
    "fund_debt_to_assets": "debt_to_assets", "fund_current_ratio": "current_ratio", "fund_quick_ratio": "quick_ratio", "fund_debt_to_eqt": "debt_to_eqt",
    "fund_ocf_to_debt": "ocf_to_debt", "fund_ocf_to_shortdebt": "ocf_to_shortdebt", "fund_q_ocf_to_sales": "q_ocf_to_sales", "fund_fcff": "fcff",
    "fund_total_mv": "total_mv", "fund_circ_mv": "circ_mv", "fund_turnover_rate": "turnover_rate", "fund_total_revenue": "total_revenue",
}
#: Factors that pass a column on where it is positive.
POSITIVE = {"fund_pb": "pb", "fund_ps_ttm": "ps_ttm"}


def _register_columns() -> None:
    for names, positive in ((PASSED, False), (POSITIVE, True)):
        for name, source in names.items():

            def f(df: DataFrame, name: str = name, source: str = source, positive: bool = positive) -> DataFrame:
                x = present(df, source)
                return df.withColumn(name, F.when(x > 0, x) if positive else x)

            f.__doc__ = f"The column {source}" + (" where it is positive." if positive else ".")
            FACTORS(name)(f)


_register_columns()


@FACTORS("fund_revenue_yoy_band")
def revenue_yoy_band(df: DataFrame, center: float = 17.5) -> DataFrame:
    """Nearness of the revenue growth (percent) to a centre."""
    return df.withColumn("fund_revenue_yoy_band", -F.abs(present(df, "revenue_yoy") - center))


@FACTORS("fund_pe_ttm")
def pe_ttm(df: DataFrame) -> DataFrame:
    """pe_ttm where positive; without that column close / eps_ttm where eps_ttm is."""
    if "pe_ttm" in df.columns:
        value = F.when(F.col("pe_ttm") > 0, F.col("pe_ttm").cast("double"))
    else:
        eps = present(df, "eps_ttm")
        value = F.when(eps > 0, ratio("close", eps))
    return df.withColumn("fund_pe_ttm", value)


def quarterly_series(df: DataFrame, period: str = "end_date") -> DataFrame:
    """The panel's rows where a new fiscal period begins: first rows, changes and unknown comparisons."""
    before = F.lag(period).over(own())
    new = df.withColumn("__new", F.coalesce(F.col(period) != before, F.lit(True)))
    return new.where("__new").drop("__new")


def quarterly_shift(df: DataFrame, source: str, out: str, n: int, months: tuple[int, int], mode: str, anchor: int = 0, years: float = 1.0) -> DataFrame:
    """A value against the one n quarters before, given to every day until the next quarter.

    Valid where the two fiscal periods lie months[0]..months[1] apart. mode: `ratio` (c - b) / |b|,
    `cagr` (c / b)^(1 / years) - 1 for b > 0, `diff` c - b. Without fiscal periods the column is null.
    The quarterly rows are marked in the panel itself, so that the values come back by windows
    over the same instrument partitions, without a join.
    """
    period = next((c for c in ("end_date", "period_end") if c in df.columns), None)
    if period is None or source not in df.columns:
        return df.withColumn(out, F.lit(None).cast("double"))
    df = df.withColumn("__q", F.coalesce(F.col(period) != F.lag(period).over(own()), F.lit(True)))
    # windows over the quarterly rows alone: days of a quarter fall into another partition
    rows = Window.partitionBy("instrument_id", "__q").orderBy("date")
    c, b = (F.lag(source, k).over(rows) if k else F.col(source) for k in (anchor, anchor + n))
    c_at, b_at = (F.lag(period, k).over(rows) if k else F.col(period) for k in (anchor, anchor + n))
    apart = (F.year(c_at) - F.year(b_at)) * 12 + F.month(c_at) - F.month(b_at)
    if mode == "ratio":
        value = F.try_divide(c - b, F.abs(b))
    elif mode == "cagr":
        value = F.when((b > 0) & (c / F.when(b > 0, b) > 0), F.pow(c / F.when(b > 0, b), F.lit(1.0 / years)) - 1)
    elif mode == "diff":
        value = c - b
    else:
        raise ValueError("mode is ratio, cagr or diff")
    df = df.withColumn("__v", F.when(F.col("__q"), F.struct(F.when(apart.between(*months), value).alias("v"))))
    upto = own().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last("__v", ignorenulls=True).over(upto)["v"]).drop("__q", "__v")


#: The quarterly comparisons: column, quarters apart, months between, mode, anchor, years.
QUARTERLY = {
    "fund_revenue_qoq": ("total_revenue", 1, (2, 4), "ratio", 0, 1.0),
    "fund_revenue_qoq_prev": ("total_revenue", 1, (2, 4), "ratio", 1, 1.0),
    "fund_net_income_qoq": ("net_income", 1, (2, 4), "ratio", 0, 1.0),
    "fund_net_income_qoq_prev": ("net_income", 1, (2, 4), "ratio", 1, 1.0),
    "fund_revenue_cagr_3y": ("total_revenue", 12, (34, 38), "cagr", 0, 3.0),
    "fund_roe_trend_4q": ("roe", 4, (10, 14), "diff", 0, 1.0),
}


def _register_quarterly() -> None:
    for name, (source, n, months, mode, anchor, years) in QUARTERLY.items():

        def f(df: DataFrame, a: tuple = (source, name, n, months, mode, anchor, years)) -> DataFrame:
            return quarterly_shift(df, *a)

        f.__doc__ = f"{source} against {n} quarter(s) before ({mode})."
        FACTORS(name)(f)


_register_quarterly()
