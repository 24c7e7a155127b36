"""Volume profiles, value areas and nodes. Volumes are whole numbers and ties have an order, so results don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import price_bin

KEY = ["symbol", "session"]
#: The most bins from a session's lowest to its highest that are laid out densely.
MOST_BINS = 1_000_000


def volume_profile(hourly: DataFrame) -> DataFrame:
    """symbol, session, bin, volume: a bar's volume in equal parts over its bins, the remainder one each from the lowest."""
    spread = hourly.select("symbol", F.to_date("bucket").alias("session"), price_bin("low").alias("lo"), price_bin("high").alias("hi"), "volume").withColumn("n", F.expr("hi - lo + 1"))
    parts = spread.select(*KEY, "lo", "n", F.col("volume").alias("whole"), F.posexplode(F.sequence("lo", "hi")).alias("i", "bin"))
    parts = parts.withColumn("part", F.expr("whole div n + if(i < whole % n, 1, 0)"))
    return parts.groupBy(*KEY, "bin").agg(F.sum("part").alias("volume"))


def volume_profile_ticks(source: DataFrame) -> DataFrame:
    """symbol, session, bin, volume of the ticks' own prices."""
    return source.groupBy("symbol", F.to_date("ts").alias("session"), price_bin("price").alias("bin")).agg(F.sum("volume").alias("volume"))


def point_of_control(profile: DataFrame) -> DataFrame:
    """symbol, session, poc, poc_volume: the bin of the highest volume, the lowest of equals."""
    best = F.max(F.struct("volume", (-F.col("bin")).alias("back"))).alias("best")
    return profile.groupBy(*KEY).agg(best).select(*KEY, (-F.col("best.back")).alias("poc"), F.col("best.volume").alias("poc_volume"))


def dense(profile: DataFrame) -> DataFrame:
    """symbol, session, lo, volumes: the volume of each bin from the lowest to the highest, 0 where there is none."""
    packed = profile.groupBy(*KEY).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.map_from_entries(F.collect_list(F.struct("bin", "volume"))).alias("by"))
    wide = F.expr(f"if(hi - lo >= {MOST_BINS}, raise_error('a session spans too many bins'), transform(sequence(lo, hi), b -> coalesce(by[b], 0L)))")
    return packed.select(*KEY, "lo", wide.alias("volumes"))


def value_area(profile: DataFrame) -> DataFrame:
    """symbol, session, poc, val, vah, va_volume, total: from the point of control, one bin at a time to the side of the higher volume (up, if equal), until 70 % is inside."""
    vs = dense(profile).withColumn("total", F.expr("aggregate(volumes, 0L, (a, x) -> a + x)")).withColumn("p", F.expr("cast(array_position(volumes, array_max(volumes)) as int)"))
    step = """CASE WHEN 10 * st.cum >= 7 * total OR (st.a <= 1 AND st.b >= size(volumes)) THEN st
        WHEN st.b < size(volumes) AND (st.a <= 1 OR volumes[st.b] >= volumes[st.a - 2]) THEN named_struct('a', st.a, 'b', st.b + 1, 'cum', st.cum + volumes[st.b])
        ELSE named_struct('a', st.a - 1, 'b', st.b, 'cum', st.cum + volumes[st.a - 2]) END"""
    grown = F.expr(f"aggregate(sequence(1, size(volumes)), named_struct('a', p, 'b', p, 'cum', volumes[p - 1]), (st, i) -> {step})")
    return vs.withColumn("r", grown).select(*KEY, F.expr("lo + p - 1").alias("poc"), F.expr("lo + r.a - 1").alias("val"), F.expr("lo + r.b - 1").alias("vah"), F.col("r.cum").alias("va_volume"), "total")


def value_area_ranked(profile: DataFrame) -> DataFrame:
    """symbol, session, poc, val, vah of the bins that, by volume, come first until 70 % is reached."""
    by = Window.partitionBy(*KEY)
    order = by.orderBy(F.desc("volume"), "bin")
    ranked = profile.select("*", F.sum("volume").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("volume").over(by).alias("total"), F.row_number().over(order).alias("rank"))
    kept = ranked.filter("10 * (cum - volume) < 7 * total or rank = 1")
    return kept.groupBy(*KEY).agg(F.min(F.when(F.col("rank") == 1, F.col("bin"))).alias("poc"), F.min("bin").alias("val"), F.max("bin").alias("vah"))


def dense_rows(profile: DataFrame) -> DataFrame:
    return dense(profile).select(*KEY, "lo", F.size("volumes").cast("bigint").alias("nbins"), F.posexplode("volumes").alias("i", "volume")).select(*KEY, (F.col("lo") + F.col("i")).alias("bin"), "volume", "nbins")


def volume_nodes(profile: DataFrame) -> DataFrame:
    """symbol, session, bin, volume, kind: HVN above both neighbours, LVN below both; beyond the edges the volume is -1."""
    by = Window.partitionBy(*KEY).orderBy("bin")
    rows = dense_rows(profile).select("*", F.lag("volume", 1, -1).over(by).alias("below"), F.lead("volume", 1, -1).over(by).alias("above"))
    kind = F.expr("CASE WHEN volume > below AND volume > above THEN 'HVN' WHEN volume < below AND volume < above THEN 'LVN' END")
    return rows.select(*KEY, "bin", "volume", kind.alias("kind")).filter("kind is not null")


def node_zones(profile: DataFrame) -> DataFrame:
    """symbol, session, kind, bin_lo, bin_hi, volume: runs of bins above the mean (HIGH) or below half of it (LOW)."""
    by = Window.partitionBy(*KEY)
    rows = dense_rows(profile).withColumn("total", F.sum("volume").over(by))
    rows = rows.withColumn("kind", F.expr("CASE WHEN volume * nbins > total THEN 'HIGH' WHEN 2 * volume * nbins < total THEN 'LOW' END")).filter("kind is not null")
    rows = rows.withColumn("island", F.col("bin") - F.row_number().over(Window.partitionBy(*KEY, "kind").orderBy("bin")))
    return rows.groupBy(*KEY, "kind", "island").agg(F.min("bin").alias("bin_lo"), F.max("bin").alias("bin_hi"), F.sum("volume").alias("volume")).drop("island")
