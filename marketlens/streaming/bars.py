"""Bars of a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators.bars import ticks


def read_events(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def stream_ohlcv(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Hourly bars of a stream, as `bars` makes them; an hour is emitted once the watermark has passed its end."""
    rows = ticks(events).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    order = F.struct("ts", "seq")
    grouped = rows.groupBy("symbol", F.window("at", "1 hour")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("trades")
    )
    return grouped.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("bucket"), "open", "high", "low", "close", "volume", "trades")
