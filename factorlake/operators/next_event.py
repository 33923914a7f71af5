"""The first later day on which something happens, without a row for every pair of days."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from factorlake.sources.shared import kept

KEY = "instrument_id"
#: Days of a block: a search looks into two blocks' days, and over the blocks' least values between them.
BLOCK_DAYS = 512


def next_days(entries: DataFrame, panel: DataFrame, events: dict[str, Column], at: str = "entry_date") -> DataFrame:
    """entries with, for each name, the first day after `at` on which the panel's row fulfils the condition; null where none does.

    One union with the panel and one window: the least such day of the rows that follow, which
    the window has before a row, so that it adds one row at a time.
    """
    rows = panel.select(F.col(KEY), F.col("date").alias("__day"), F.lit(0).alias("__entry"), *(F.when(c, F.col("date")).alias(n) for n, c in events.items()))
    rows = rows.where(F.coalesce(*events).isNotNull()).withColumn("__own", F.lit(None).cast(entries.select(F.struct(*entries.columns)).schema[0].dataType))
    asked = entries.select(F.col(KEY), F.col(at).alias("__day"), F.lit(1).alias("__entry"), *(F.lit(None).cast("date").alias(n) for n in events), F.struct(*entries.columns).alias("__own"))
    # a day's entries stand before its event, so it isn't among what is later than they
    ahead = Window.partitionBy(KEY).orderBy(F.desc("__day"), F.desc("__entry")).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.unionByName(asked).withColumns({n: F.min(n).over(ahead) for n in events}).where("__entry = 1")
    return both.select("__own.*", *events)


def next_at_or_under(entries: DataFrame, panel: DataFrame, value: str, level: Column, out: str, at: str = "entry_date") -> DataFrame:
    """entries with `out`: the first day after `at` whose `value` is at most the entry's `level`; null where none is.

    An instrument's days lie in blocks of BLOCK_DAYS with their least value. A search looks in the
    block of its own day, then for the first later block whose least value is low enough, and in
    this for the day: per entry, rows of one join by instrument and two by block.
    Null and NaN values are never at or under a level; nor is any under a null level.
    """
    ordered = Window.partitionBy(KEY).orderBy("date")
    days = panel.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(KEY, "date", F.col(value).cast("double").alias("v"))
    days = days.withColumn("block", F.floor((F.row_number().over(ordered) - 1) / BLOCK_DAYS).cast("int"))
    # at most BLOCK_DAYS of them
    blocks = days.groupBy(KEY, "block").agg(F.sort_array(F.collect_list(F.struct("date", "v"))).alias("days"))
    tops = blocks.select(KEY, F.struct("block", F.col("days")[0]["date"].alias("first"), F.array_min("days.v").alias("least")).alias("top"))
    tops = tops.groupBy(KEY).agg(F.sort_array(F.collect_list("top")).alias("__tops"))
    own = F.size(F.filter("__tops", lambda t: t["first"] <= F.col(at))) - 1
    asked = entries.withColumn("__level", level.cast("double")).join(tops, KEY, "left").withColumn("__block", own)
    later = F.filter("__tops", lambda t: (t["block"] > F.col("__block")) & (t["least"] <= F.col("__level")))
    asked = asked.withColumn("__next", F.try_element_at(later, F.lit(1))["block"]).drop("__tops")
    for name, where in (("__here", "__block"), ("__there", "__next")):
        side = blocks.select(F.col(KEY).alias("__key"), F.col("block").alias("__b"), F.col("days").alias("__days"))
        hit = F.try_element_at(F.filter("__days", lambda d: (d["date"] > F.col(at)) & (d["v"] <= F.col("__level"))), F.lit(1))["date"]
        joined = asked.join(side, (F.col(KEY) == F.col("__key")) & (F.col(where) == F.col("__b")), "left")
        asked = joined.withColumn(name, hit).drop("__key", "__b", "__days")
    return asked.withColumn(out, F.coalesce("__here", "__there")).select(*entries.columns, out)


def open_days(rows: DataFrame, entry: Column, event: Column, order: WindowSpec, day: str = "date") -> DataFrame:
    """Of rows that are an instrument's days, entries or both, the entries and all days after an entry up to its first later event.

    What is left holds every first day that next_days and next_at_or_under can find up to that
    event. `order` is an instrument's rows by day, in any order within a day, so some days of
    other entries may stay too.
    """
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__entered": F.max(F.when(entry, F.col(day))).over(before), "__ended": F.max(F.when(event, F.col(day))).over(before)})
    still = F.col("__ended").isNull() | (F.col("__ended") <= F.col("__entered")) | (F.col("__ended") == F.col(day))
    return rows.where(entry | (F.col("__entered").isNotNull() & still)).drop("__entered", "__ended")


def first_exits(rows: DataFrame, own: Column, entry: Column, levels: dict[str, tuple[str, Column]], events: dict[str, Column], order: WindowSpec) -> DataFrame:
    """`own`.* of the rows that are entries, with the first later day of each level and event, by name; levels are of `own`'s fields.

    Rows are read once: the days that can matter are kept as a table of few columns, and searched there.
    """
    c = {n: f"__event{k}" for k, n in enumerate(events)}
    values = sorted({value for value, _ in levels.values()})
    rows = open_days(rows, entry, reduce(or_, (F.coalesce(e, F.lit(False)) for e in events.values())), order)
    days = rows.select(KEY, "date", *values, *(events[n].alias(c[n]) for n in events), F.when(entry, own).alias("__own"))
    days = kept(days, "open_days")
    entries = days.where("__own IS NOT NULL").select("__own.*")
    out = next_days(entries, days, {n: F.col(c[n]) for n in events})
    for n, (value, level) in levels.items():
        out = next_at_or_under(out, days, value, level, n)
    return out
