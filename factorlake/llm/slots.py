"""Gapless numbering of rows inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one numbering block aims to hold.
BLOCK_ROWS = 200_000


def numbered(df: DataFrame, group: str, key: Column, out: str, rows: int, ties: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `out`: 0, 1, 2, ... inside each `group`, in the order of the random long `key`.

    The 64-bit key range is cut into equal blocks, so a block holds about the same share of
    every group. Rows are counted per (group, block), the counts give each block its first
    number, and rows are ranked inside their block only. The count table has one row per
    block_rows rows or per group, and joins as Spark's size check says.
    `ties` orders rows of equal key; rows equal in these too are interchangeable.
    """
    blocks = max(1, -(-rows // block_rows))
    keyed = df.withColumns({"__key": key, "__block": F.floor((F.shiftrightunsigned(key, 1) / F.lit(2.0**63)) * blocks).cast("int")})
    counts = keyed.groupBy(group, "__block").agg(F.count("*").alias("__n"))
    first = counts.withColumn("__first", F.sum("__n").over(Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.select(F.col(group).alias("__g"), F.col("__block").alias("__b"), F.coalesce("__first", F.lit(0)).alias("__first"))
    inside = Window.partitionBy(group, "__block").orderBy("__key", *(ties or []))
    ranked = keyed.withColumn("__rank", F.row_number().over(inside))
    joined = ranked.join(first, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b")))
    return joined.withColumn(out, (F.col("__first") + F.col("__rank") - 1).cast("long")).drop("__key", "__block", "__g", "__b", "__first", "__rank")
