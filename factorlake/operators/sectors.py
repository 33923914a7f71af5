"""Sector membership as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.operators.asof import asof


def intervals(sectors: DataFrame) -> DataFrame:
    """instrument_id, sector, sector_name, valid_from, valid_to (exclusive; null: open) of the assignments."""
    w = Window.partitionBy("instrument_id").orderBy("date")
    return sectors.select("instrument_id", "sector", "sector_name", F.col("date").alias("valid_from"), F.lead("date").over(w).alias("valid_to"))


def with_sector(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    """The panel with each row's latest sector."""
    return asof(panel, sectors, ["sector"])


def members_at(sectors: DataFrame, day: str | Column, sector: str | None = None) -> DataFrame:
    """instrument_id, sector, sector_name of the assignments that hold on a day."""
    day = F.to_date(F.lit(day)) if isinstance(day, str) else day
    held = intervals(sectors).where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))))
    held = held.where(F.col("sector") == sector) if sector else held
    return held.select("instrument_id", "sector", "sector_name")


def names(sectors: DataFrame) -> DataFrame:
    """sector, sector_name: the latest name of each code."""
    return sectors.groupBy("sector").agg(F.max_by("sector_name", F.struct("date", "sector_name")).alias("sector_name"))


def grouped(panel: DataFrame, groups: dict[str, list[str]] | None, overrides: dict[str, str] | None = None) -> DataFrame:
    """Add _group: the instrument's own group, else its sector's; rows without one go. Without groups all rows are `_all`."""
    return panel.withColumn("_group", group_of(groups, overrides)).where("_group is not null")


def group_of(groups: dict[str, list[str]] | None, overrides: dict[str, str] | None = None, key: str = "instrument_id") -> Column:
    """The group of a row by its instrument (`key`), else its sector, else null; without groups `_all`.

    The map is part of the query's text, so it becomes a literal, and no join.
    """
    if groups is None:
        return F.lit("_all")

    def lookup(pairs: dict[str, str], key: str) -> Column:
        if not pairs:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), F.col(key))

    of_sector = {s: g for g, members in groups.items() for s in members}
    return F.coalesce(lookup(overrides or {}, key), lookup(of_sector, "sector"))
