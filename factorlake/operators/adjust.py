"""Price adjustment by the factors of the rows at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def adjusted(bars: DataFrame, mode: str = "forward") -> DataFrame:
    """Prices times adj_factor over its latest (`forward`) or earliest (`backward`) value; `raw` as they are.

    The base is taken from the rows given, so filter them first. Volume stays. Without all four
    prices the bars come back as they are.
    """
    if mode not in ("forward", "backward", "raw"):
        raise ValueError("mode is forward, backward or raw")
    if mode == "raw" or not set(PRICES) <= set(bars.columns):
        return bars
    w = Window.partitionBy("instrument_id")
    if mode == "forward":
        scale = F.try_divide(F.col("adj_factor"), F.max_by("adj_factor", "date").over(w))
    else:
        scale = F.try_divide(F.col("adj_factor"), F.min_by("adj_factor", "date").over(w))
    return bars.withColumn("__s", scale).withColumns({p: F.col(p) * F.col("__s") for p in PRICES}).drop("__s")
