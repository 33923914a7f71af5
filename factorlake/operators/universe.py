"""Who was tradable when: listing, halts and index events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_rows(events: DataFrame, *kinds: str, suffix: str | None = None) -> DataFrame:
    """Events of some kinds, or those whose kind ends in a suffix."""
    return events.where(F.col("event").endswith(suffix) if suffix else F.col("event").isin(*kinds))


def listings(events: DataFrame) -> DataFrame:
    """instrument_id, ipo, delist: the last event of each kind."""
    last = lambda kind: F.max(F.when(F.col("event") == kind, F.col("date"))).alias(kind.lower())
    return events.groupBy("instrument_id").agg(last("IPO"), last("DELIST"))


def halts(events: DataFrame) -> DataFrame:
    """instrument_id, halt, resume (exclusive; null: for ever): each HALT until the next RESUME."""
    w = Window.partitionBy("instrument_id").orderBy("date", "event").rowsBetween(1, Window.unboundedFollowing)
    ahead = F.min(F.when(F.col("event") == "RESUME", F.col("date"))).over(w)
    marked = event_rows(events, "HALT", "RESUME").withColumn("resume", ahead)
    return marked.where("event = 'HALT'").select("instrument_id", F.col("date").alias("halt"), "resume")


def _covered(rows: DataFrame, events: DataFrame) -> Column:
    return (F.col("__i") == rows["instrument_id"]) & (rows["date"] >= F.col("halt")) & (F.col("resume").isNull() | (rows["date"] < F.col("resume")))


def not_halted(rows: DataFrame, events: DataFrame) -> DataFrame:
    """The rows (instrument_id, date) outside halts."""
    h = halts(events).withColumnRenamed("instrument_id", "__i")
    return rows.join(h, _covered(rows, events), "left_anti")


def universe(bars: DataFrame, events: DataFrame, with_events: bool = True) -> DataFrame:
    """instrument_id, date of all tradable rows on days with bars.

    Members are those with a bar, of instruments with any event (if there are any), that aren't
    halted; listing dates don't count on days with bars.
    """
    rows = bars.select("instrument_id", "date").distinct()
    if with_events:
        known = events.select(F.col("instrument_id").alias("__k")).distinct()
        rows = rows.join(known, F.col("instrument_id") == F.col("__k"), "left_semi")
    return not_halted(rows, events)


def membership(events: DataFrame) -> DataFrame:
    """instrument_id, since, until (exclusive; null: open): when each instrument is listed and not halted; bars don't count.

    A sweep: listing and the end of a halt count up, delisting and the start of a halt down, and
    running sums over an instrument's days of change say what holds from each to the next. An
    instrument without a listing day is listed from the start.
    """
    span = listings(events)
    change = lambda day, listed, halted: F.struct(day.alias("date"), F.lit(listed).alias("listed"), F.lit(halted).alias("halted"))
    start = F.coalesce("ipo", F.lit("0001-01-01").cast("date"))
    listing = span.select("instrument_id", F.explode(F.array(change(start, 1, 0), change(F.col("delist"), -1, 0))).alias("c"))
    halting = halts(events).select("instrument_id", F.explode(F.array(change(F.col("halt"), 0, 1), change(F.col("resume"), 0, -1))).alias("c"))
    days = listing.unionByName(halting).select("instrument_id", "c.*").where("date IS NOT NULL").groupBy("instrument_id", "date").agg(F.sum("listed").alias("listed"), F.sum("halted").alias("halted"))
    w = Window.partitionBy("instrument_id").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = days.select("instrument_id", F.col("date").alias("since"), F.lead("date").over(w).alias("until"), F.sum("listed").over(upto).alias("listed"), F.sum("halted").over(upto).alias("halted"))
    return swept.where("listed > 0 AND halted = 0").select("instrument_id", "since", "until")


def listed(events: DataFrame, days: DataFrame) -> DataFrame:
    """instrument_id, date for days (date) without bars: listed by then or listing unknown, not delisted, not halted.

    `days` are the days that a query asks for, part of its text; each span of membership gives its
    own of them.
    """
    asked = [r["date"] for r in days.select("date").distinct().collect() if r["date"] is not None]
    every = F.array(*(F.lit(d) for d in sorted(asked))) if asked else F.array().cast("array<date>")
    own = F.filter(every, lambda d: (d >= F.col("since")) & (F.col("until").isNull() | (d < F.col("until"))))
    return membership(events).select("instrument_id", F.explode(own).alias("date"))


def ever_added(events: DataFrame, index: str | None = None) -> DataFrame:
    """Instruments that were ever added to an index, or to any."""
    kinds = F.col("event").endswith("_ADD") | F.col("event").endswith("_ADDED")
    return events.where(kinds & F.col("event").startswith(index) if index else kinds).select("instrument_id").distinct()


def active(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """pairs (instrument_id, date) with is_active: listed, not delisted and not halted; a bar isn't needed."""
    dates = listings(events).withColumnRenamed("instrument_id", "__i")
    h = halts(events).select(F.col("instrument_id").alias("__h"), "halt", "resume")
    on = (F.col("instrument_id") == F.col("__h")) & (F.col("date") >= F.col("halt")) & (F.col("resume").isNull() | (F.col("date") < F.col("resume")))
    halted = pairs.join(h, on, "left_semi").distinct().withColumn("__halted", F.lit(True))
    joined = pairs.join(dates, F.col("instrument_id") == F.col("__i"), "left").join(halted, ["instrument_id", "date"], "left")
    ok = (F.col("ipo").isNull() | (F.col("ipo") <= F.col("date"))) & (F.col("delist").isNull() | (F.col("delist") > F.col("date"))) & F.col("__halted").isNull()
    return joined.select("instrument_id", "date", (ok & F.col("__i").isNotNull()).alias("is_active"))


def active_by_last_event(events: DataFrame, day: str) -> DataFrame:
    """Instruments whose latest event up to a day isn't DELIST or HALT."""
    last = events.where(F.col("date") <= F.to_date(F.lit(day))).groupBy("instrument_id").agg(F.max_by("event", F.struct("date", "event")).alias("event"))
    return last.where(~F.col("event").isin("DELIST", "HALT"))


def sizes(members: DataFrame) -> DataFrame:
    """date, n_members."""
    return members.groupBy("date").agg(F.count("*").alias("n_members"))
