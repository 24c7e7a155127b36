"""Auction structure of sessions, and nodes that persist over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import by_symbol, price_bin


def auction_structure(hourly: DataFrame, area: DataFrame) -> DataFrame:
    """symbol, session, open_loc, close_loc (by the value area of the session before; null for the first), ib_high, ib_low (the first two bars), ext_up, ext_down."""
    bars = hourly.withColumn("session", F.to_date("bucket"))
    first = Window.partitionBy("symbol", "session").orderBy("bucket")
    bars = bars.withColumn("k", F.row_number().over(first))
    day = bars.groupBy("symbol", "session").agg(
        F.min_by("open", "bucket").alias("open"), F.max_by("close", "bucket").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max(F.when(F.col("k") <= 2, F.col("high"))).alias("ib_high"), F.min(F.when(F.col("k") <= 2, F.col("low"))).alias("ib_low"),
    )
    day = day.join(area.select("symbol", "session", "val", "vah"), ["symbol", "session"]).select("*", F.lag("val").over(by_symbol()).alias("pval"), F.lag("vah").over(by_symbol()).alias("pvah"))
    where = lambda c: F.when(F.col("pval").isNull(), F.lit(None)).when(price_bin(c) > F.col("pvah"), "ABOVE").when(price_bin(c) < F.col("pval"), "BELOW").otherwise("INSIDE")
    return day.select("symbol", "session", where("open").alias("open_loc"), where("close").alias("close_loc"), "ib_high", "ib_low", (F.col("high") > F.col("ib_high")).alias("ext_up"), (F.col("low") < F.col("ib_low")).alias("ext_down"))


def persistent_nodes(nodes: DataFrame) -> DataFrame:
    """symbol, bin, kind, first_session, last_session, n_sessions: runs of days in a row on which a bin is the same kind of node."""
    by = Window.partitionBy("symbol", "bin", "kind").orderBy("session")
    days = nodes.withColumn("island", F.unix_date("session") - F.row_number().over(by))
    return days.groupBy("symbol", "bin", "kind", "island").agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count(F.lit(1)).alias("n_sessions")).drop("island")


def va_overlap(area: DataFrame) -> DataFrame:
    """symbol, session, overlap_bins, union_bins of a session's value area and the one before."""
    rows = area.select("symbol", "session", "val", "vah", F.lag("val").over(by_symbol()).alias("pval"), F.lag("vah").over(by_symbol()).alias("pvah")).filter("pval is not null")
    both = F.greatest(F.lit(0), F.least("vah", "pvah") - F.greatest("val", "pval") + 1)
    return rows.select("symbol", "session", both.cast("bigint").alias("overlap_bins"), (F.expr("vah - val + 1 + pvah - pval + 1") - both).cast("bigint").alias("union_bins"))


def node_streaks(persistent: DataFrame) -> DataFrame:
    """kind, n_sessions, n_nodes."""
    return persistent.groupBy("kind", "n_sessions").agg(F.count(F.lit(1)).alias("n_nodes"))
