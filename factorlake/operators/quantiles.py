"""Exact quantiles of a whole table by counts in ever finer ranges."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.sources.shared import discard, kept

#: Parts that a range is cut into in one pass.
PARTS = 1024
#: Values of all wanted ranges together that are fetched in the end, at most, unless they are equal.
FETCHED = 20_000


@dataclass(frozen=True)
class _Range:
    """Values between two bounds, both included; `before` are smaller ones, n lie in it."""

    lo: float
    hi: float
    before: int
    n: int


def exact_quantiles(df: DataFrame, x: str, shares: list[float]) -> list[float | None]:
    """The quantiles of x at each share, linear between neighbours; null without values.

    Nulls and NaN take no part; infinite values raise.

    Every pass counts the values of the ranges that still hold a wanted place, in PARTS parts,
    with the least and greatest value of each part, and goes on with the parts that hold one: a
    place is found when its part's values are all equal, or few enough to be fetched. What a task
    or the driver sees is counts of parts, whatever the table's size; ties cost nothing.
    """
    values = kept(df.select(F.col(x).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")), "values")
    ends = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not ends["n"]:
        discard(values)
        return [None] * len(shares)
    if math.isinf(ends["lo"]) or math.isinf(ends["hi"]):
        discard(values)
        raise ValueError(f"{x} has infinite values")
    places = {p for s in shares for p in (math.floor(s * (ends["n"] - 1)), math.ceil(s * (ends["n"] - 1)))}
    found: dict[int, float] = {}
    open_ = [_Range(ends["lo"], ends["hi"], 0, ends["n"])]
    while True:
        for r in [r for r in open_ if r.lo == r.hi]:
            found |= {p: r.lo for p in places if r.before <= p < r.before + r.n}
        open_ = [r for r in open_ if r.lo < r.hi and any(r.before <= p < r.before + r.n for p in places)]
        if sum(r.n for r in open_) <= FETCHED:
            break
        open_ = [part for part in _parted(values, open_) if any(part.before <= p < part.before + part.n for p in places)]
    if open_:
        rows = values.where(_in_any(open_)).collect()  # FETCHED at most
        for r in open_:
            own = sorted(v for (v,) in rows if r.lo <= v <= r.hi)
            found |= {p: own[p - r.before] for p in places if r.before <= p < r.before + r.n}
    discard(values)
    out = []
    for s in shares:
        at = s * (ends["n"] - 1)
        lo, hi = found[math.floor(at)], found[math.ceil(at)]
        out.append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def _in_any(ranges: list[_Range]):
    some = F.lit(False)
    for r in ranges:
        some = some | F.col("v").between(r.lo, r.hi)
    return some


def _parted(values: DataFrame, ranges: list[_Range]) -> list[_Range]:
    """The parts of the ranges that hold values, by one pass; ranges are apart from each other."""
    which, part = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, r in enumerate(ranges):
        inside = F.col("v").between(r.lo, r.hi)
        which = F.when(inside, k).otherwise(which)
        # halves keep the width of a range finite
        share = (F.col("v") / 2 - r.lo / 2) / (r.hi / 2 - r.lo / 2)
        part = F.when(inside, F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")).otherwise(part)
    counted = values.where(_in_any(ranges)).groupBy(which.alias("k"), part.alias("p")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    out, before = [], {}
    for row in sorted(counted.collect(), key=lambda row: (row["k"], row["p"])):  # PARTS a range
        first = before.get(row["k"], ranges[row["k"]].before)
        out.append(_Range(row["lo"], row["hi"], first, row["n"]))
        before[row["k"]] = first + row["n"]
    return out
