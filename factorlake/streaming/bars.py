"""Bars from streams: upserts of landing files, and hourly bars from ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factorlake.sources.ingest import BARS, landed, upsert

TICKS = T.StructType([T.StructField("instrument_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("price", T.DoubleType())])


def upsert_stream(spark: SparkSession, landing: str, path: str, checkpoint: str, schema: T.StructType = BARS, keys: list[str] | None = None) -> StreamingQuery:
    """Upsert each batch of new landing files into a table. Ends when all files are in.

    Of rows with one key the last to land stays: that of the later file, or further down in one
    file. A batch that runs again after a failure leaves the same table.
    """
    rows = landed(spark, landing, schema, stream=True)
    return rows.writeStream.foreachBatch(lambda df, _: upsert(df.sparkSession, df, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bars_stream(spark: SparkSession, landing: str, path: str, checkpoint: str, late: str = "10 minutes", schema: T.StructType = TICKS) -> StreamingQuery:
    """Hourly bars of landing tick files, upserted into a table as each hour closes. Ends when all files are in.

    An hour closes when a batch has seen a tick later than its end by more than `late`; its bar
    is then final. Ticks of a closed hour are left out. Open hours wait in the checkpoint's state,
    from which a later run goes on, on whatever machines.
    """
    closed = hourly_bars(spark.readStream.schema(schema).parquet(landing), late)
    keep = lambda df, _: upsert(df.sparkSession, df, path, ["instrument_id", "datetime"], time="datetime")
    return closed.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_bars(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """instrument_id, datetime, open, high, low, close, volume of ticks (instrument_id, ts, seq, price), batch or stream."""
    order = F.struct("ts", "seq")
    windowed = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    out = windowed.groupBy("instrument_id", F.window("ts", "1 hour").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume")
    )
    return out.select("instrument_id", F.col("w.start").alias("datetime"), "open", "high", "low", "close", "volume")
