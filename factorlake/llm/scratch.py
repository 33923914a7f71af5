"""What the operators share: tables kept between steps, and bounded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorlake.sources.shared import discard, kept, shared_dir, shuffle_cleanup

__all__ = ["bounded_batches", "discard", "kept", "shared_dir", "shuffle_cleanup", "table"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the given tables, with the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches to Python hold about `size` bytes, however long the texts are; holds for the session, since plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
