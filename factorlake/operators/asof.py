"""Point-in-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY, TIME = "instrument_id", "date"


def asof_sides(left: DataFrame, sides: list[tuple[DataFrame, list[str], str | None]], key: str = KEY, time: str = TIME) -> DataFrame:
    """Give each left row the whole latest row of every side, of its key and with time <= the left time.

    A side is (table, columns to take, tie). A null inside its row stays null; of several of its
    rows at one time the last by its tie counts. Left and sides are one tagged union with one
    shuffle, one sort and one window: Spark has no as-of join of its own.
    """
    own = left.select(F.struct(*left.columns)).schema[0].dataType
    kinds = [side.select(F.struct(*columns)).schema[0].dataType for side, columns, _ in sides]
    empty = {"__left": F.lit(None).cast(own), **{f"__right{k}": F.lit(None).cast(t) for k, t in enumerate(kinds)}}

    def tagged(df: DataFrame, order: int, tie: str | None, **values) -> DataFrame:
        return df.select(F.col(key), F.col(time), F.lit(order).alias("__side"), (F.col(tie) if tie else F.lit(None)).cast("string").alias("__tie"), *(c.alias(n) for n, c in (empty | values).items()))

    rows = tagged(left, 1, None, __left=F.struct(*left.columns))
    for k, (side, columns, tie) in enumerate(sides):
        rows = rows.unionByName(tagged(side.where(F.col(time).isNotNull()), 0, tie, **{f"__right{k}": F.struct(*columns)}))
    w = Window.partitionBy(key).orderBy(F.col(time).asc_nulls_first(), "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumns({f"__right{k}": F.last(f"__right{k}", ignorenulls=True).over(w) for k in range(len(sides))}).where("__side = 1")
    return found.select("__left.*", *(F.col(f"__right{k}.{c}").alias(c) for k, (_, columns, _) in enumerate(sides) for c in columns))


def asof(left: DataFrame, right: DataFrame, columns: list[str], key: str = KEY, time: str = TIME, tie: str | None = None) -> DataFrame:
    """asof_sides() with one side."""
    return asof_sides(left, [(right, columns, tie)], key, time)


def enrich(panel: DataFrame, fundamentals: DataFrame | None, valuation: DataFrame | None) -> DataFrame:
    """The panel with the latest fundamentals and, on their own, the latest valuation; either may be absent."""
    known, sides = set(panel.columns), []
    for side, tie in ((fundamentals, "end_date"), (valuation, None)):
        if side is not None:
            columns = [c for c in side.columns if c not in known]
            known.update(columns)
            sides.append((side, columns, tie if tie in side.columns else None))
    return asof_sides(panel, sides) if sides else panel
