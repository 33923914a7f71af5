"""Results as files: CSV, JSON, Parquet, and Markdown for tables that are read by people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.sources.shared import shuffle_cleanup


def markdown(df: DataFrame) -> DataFrame:
    """line, value: the lines of a Markdown table, its head first."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    first = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, head))).alias("line", "value"))
    return first.unionByName(df.select(F.lit(len(head)).alias("line"), cells.alias("value")))


def write(df: DataFrame, path: str, kind: str, compression: str | None = None) -> None:
    """Write rows as `csv` (with a header), `json`, `parquet` or `markdown`; the last is in order, its head first, over as many files as its size asks for.

    Without a compression each kind has Spark's own. Shuffle files go when the rows are written.
    """
    rows = markdown(df).orderBy("line", "value").select("value") if kind == "markdown" else df
    out = rows.write if compression is None else rows.write.option("compression", compression)
    with shuffle_cleanup(df.sparkSession):
        (out.option("header", True) if kind == "csv" else out).format("text" if kind == "markdown" else kind).save(path)
