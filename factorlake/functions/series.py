"""Building blocks over an instrument x date panel: windows, safe division, ranks, quantiles, recursive averages.

Null rules: a rolling value is null until its window holds as many non-null values as its
period; division by zero gives null; ranks of nulls are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "instrument_id", "date"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def own() -> WindowSpec:
    """Rows of one instrument in the order of time."""
    return Window.partitionBy(KEY).orderBy(TIME)


def so_far() -> WindowSpec:
    return own().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_rows(period: int) -> WindowSpec:
    return own().rowsBetween(1 - period, Window.currentRow)


def rolling(f: Callable[[Column], Column], x: str | Column, period: int) -> Column:
    """f over the last `period` rows, once they hold that many values."""
    x = col(x)
    w = last_rows(period)
    return F.when(F.count(x).over(w) == period, f(x).over(w))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(own())


def lead(x: str | Column, n: int = 1) -> Column:
    return F.lead(col(x), n).over(own())


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def change(x: str | Column, n: int = 1) -> Column:
    """x over its value n rows before, less 1."""
    return ratio(x, lag(x, n)) - 1


def average_rank(x: str, *keys: str, descending: bool = False) -> Column:
    """Rank from 1 among the non-null values of the keys' rows; equal values share their mean rank."""
    order = F.col(x).desc_nulls_last() if descending else F.col(x).asc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.rank().over(w)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(x).isNotNull(), first + (ties - 1) / 2)


def count_in(keys: list[str], x: str | None = None) -> Column:
    return F.count(F.lit(1) if x is None else F.col(x)).over(Window.partitionBy(*keys))


def clipped(df: DataFrame, x: str, pct: float | Column, keys: list[str], out: str) -> DataFrame:
    """x clipped to its nearest-rank quantiles pct and 1 - pct among the keys' rows; pct is a number or, one per keys, a column.

    The quantile q of n sorted non-null values is the one at place round(q * (n - 1)), half up.
    """
    by_value = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    df = df.withColumns({"__at": F.row_number().over(by_value) - 1, "__n": count_in(keys, x)})
    whole = Window.partitionBy(*keys)
    pick = lambda q: F.max(F.when(F.col("__at") == F.floor(q * (F.col("__n") - 1) + 0.5), F.col(x))).over(whole)
    low = pct if isinstance(pct, Column) else F.lit(pct)
    high = 1 - pct if isinstance(pct, Column) else F.lit(1 - pct)
    df = df.withColumns({"__lo": pick(low), "__hi": pick(high)})
    value = F.when(F.col(x).isNotNull(), F.greatest(F.least(x, "__hi"), "__lo"))
    return df.withColumn(out, value).drop("__at", "__n", "__lo", "__hi")


def standardised(x: str, keys: list[str]) -> Column:
    """(x - mean) / sample deviation among the keys' rows; null where the deviation is 0 or unknown."""
    w = Window.partitionBy(*keys)
    return F.try_divide(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w))


def span_alpha(period: float, smoothing: float = 2.0) -> float:
    return smoothing / (1.0 + period)


def half_life_alpha(period: float) -> float:
    return 1.0 - math.exp(-math.log(2.0) / period)


def by_blocks() -> WindowSpec:
    """Rows of one instrument in the order of time, by the sort that with_ema's blocks need; for its result with `blocks`."""
    return Window.partitionBy(KEY).orderBy("__block", TIME)


def with_ema(df: DataFrame, specs: dict[str, tuple], blocks: bool = False) -> DataFrame:
    """Add exponential averages: name -> (column, alpha) or (column, alpha, True) for adjusted weights.

    y0 = x0, y = alpha * x + (1 - alpha) * y before; adjusted divides by the weights so far. The
    recursion is a blocked scan: inside a block of rows a running sum of x scaled by powers of
    1 - alpha, then the ends of the blocks before are folded and added. So it needs windows over
    the instrument only, and no row of Python. All averages share the blocks, and with
    them one sort. Inputs must not be null (a null gives null there). With `blocks` the column
    `__block` stays, so that windows over by_blocks() need no further sort.
    """
    todo = {name: (F.col(x).cast("double"), alpha, bool(adjusted and adjusted[0])) for name, (x, alpha, *adjusted) in specs.items()}
    df = df.withColumns({name: x for name, (x, alpha, _) in todo.items() if alpha >= 1})
    todo = {name: spec for name, spec in todo.items() if spec[1] < 1}
    if not todo:
        return df.withColumn("__block", F.lit(0)) if blocks else df
    size = max(1, min(256, *(int(600 / -math.log(1.0 - alpha)) for _, alpha, _ in todo.values())))
    df = df.withColumn("__t", F.row_number().over(own()) - 1).withColumn("__block", F.floor(F.col("__t") / size))
    at = F.col("__t") % size
    inside = Window.partitionBy(KEY, "__block").orderBy(TIME).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # blocks follow each other in time: this is the order of own()
    before = by_blocks().rowsBetween(Window.unboundedPreceding, -1)
    power = lambda d, k: F.pow(F.lit(d), k.cast("double"))
    folded = lambda ends, d: F.aggregate(ends, F.lit(0.0), lambda acc, e: acc * (d**size) + e)
    local, value = {}, {}
    for k, (name, (x, alpha, adjusted)) in enumerate(todo.items()):
        d = 1.0 - alpha
        weight = F.when(F.col("__t") == 0, alpha if adjusted else 1.0).otherwise(alpha)
        local[f"__local{k}"] = F.sum(weight * x * power(d, -at)).over(inside) * power(d, at)
        ends = F.collect_list(F.when(at == size - 1, F.col(f"__local{k}"))).over(before)
        whole = F.col(f"__local{k}") + folded(ends, d) * power(d, at + 1)
        value[name] = F.when(x.isNotNull(), whole / (1 - power(d, F.col("__t") + 1)) if adjusted else whole)
    return df.withColumns(local).withColumns(value).drop("__t", *([] if blocks else ["__block"]), *local)
