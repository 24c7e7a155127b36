"""Ticks and the bars made of them. Prices are in units with two decimals; sums are of whole cents or volumes, so no order of rows changes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import cents


def ticks(events: DataFrame) -> DataFrame:
    """symbol, ts, seq, price, volume."""
    return events.select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("bigint").alias("volume")
    )


def bars(source: DataFrame, unit: str = "HOUR") -> DataFrame:
    """symbol, bucket, open, high, low, close, volume, trades; (ts, seq) orders ticks totally."""
    at = F.struct("ts", "seq")
    return source.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("trades")
    )


def resampled(hourly: DataFrame, unit: str = "DAY", hours: int = 0) -> DataFrame:
    """Coarser bars of finer ones: of a unit, or of so many hours from midnight on."""
    to = F.date_trunc(unit, "bucket").cast("timestamp_ntz")
    if hours:
        to = F.expr(f"cast(date_trunc('DAY', bucket) as timestamp_ntz) + make_dt_interval(0, hour(bucket) div {hours} * {hours})")
    return hourly.groupBy("symbol", to.alias("to")).agg(
        F.min_by("open", "bucket").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket").alias("close"), F.sum("volume").alias("volume"), F.sum("trades").alias("trades")
    ).withColumnRenamed("to", "bucket")


def vwap_daily(source: DataFrame) -> DataFrame:
    """symbol, session, cents_volume, volume; their quotient is the reader's."""
    return source.groupBy("symbol", F.to_date("ts").alias("session")).agg(F.sum(cents("price") * F.col("volume")).alias("cents_volume"), F.sum("volume").alias("volume"))


def gap_filled(hourly: DataFrame) -> DataFrame:
    """symbol, bucket, close, volume of every hour from a symbol's first to its last; the close is carried forward, the volume 0."""
    hours = hourly.groupBy("symbol").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select("symbol", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("bucket"))
    filled = hours.join(hourly.select("symbol", "bucket", "close", "volume"), ["symbol", "bucket"], "left")
    until = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("symbol", "bucket", F.last("close", ignorenulls=True).over(until).alias("close"), F.coalesce("volume", F.lit(0).cast("bigint")).alias("volume"))


def rolling_range(hourly: DataFrame) -> DataFrame:
    """symbol, bucket, vol_6h (this hour and the five before, by time), high_6 (this bar and the five before, by rows)."""
    by = Window.partitionBy("symbol")
    second = F.col("bucket").cast("timestamp").cast("bigint")
    return hourly.select("symbol", "bucket", F.sum("volume").over(by.orderBy(second).rangeBetween(-5 * 3600, 0)).alias("vol_6h"), F.max("high").over(by.orderBy("bucket").rowsBetween(-5, 0)).alias("high_6"))


def _sized(hourly: DataFrame) -> DataFrame:
    """Bars of an hour, of four and of a day with their range in cents."""
    sizes = {"1h": hourly, "4h": resampled(hourly, hours=4), "1d": resampled(hourly)}
    every = reduce(DataFrame.unionByName, (bars.withColumn("interval", F.lit(name)) for name, bars in sizes.items()))
    return every.withColumn("range", cents("high") - cents("low"))


def aggregation_sensitivity(source: DataFrame, universe: tuple[str, ...] | None = None) -> DataFrame:
    """interval, symbol, range_cents, n_bars for bars of an hour, of four and of a day; a null symbol is the total of all."""
    hourly = bars(source if universe is None else source.filter(F.col("symbol").isin(*universe)))
    return _sized(hourly).groupingSets([("interval", "symbol"), ("interval",)], "interval", "symbol").agg(F.sum("range").alias("range_cents"), F.count(F.lit(1)).alias("n_bars"))


def universe_sensitivity(source: DataFrame) -> DataFrame:
    """interval, without, mean_range, change: the mean range of a bar in cents over all symbols but one, and how much that differs from the mean over all."""
    each = _sized(bars(source)).groupBy("interval", "symbol").agg(F.sum("range").alias("r"), F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("interval")
    rest = each.select("interval", F.col("symbol").alias("without"), (F.sum("r").over(total) - F.col("r")).alias("r"), (F.sum("n").over(total) - F.col("n")).alias("n"), (F.sum("r").over(total) / F.sum("n").over(total)).alias("mean")).filter("n > 0")
    return rest.select("interval", "without", F.round(F.col("r") / F.col("n"), 6).alias("mean_range"), F.round(F.col("r") / F.col("n") - F.col("mean"), 6).alias("change"))
