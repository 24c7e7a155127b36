"""Features and labels of sessions, what follows from states, and what a strategy on them would have made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import by_symbol, cents

KEY = ["symbol", "session"]
FEATURES = ("poc", "va_width", "n_hvn", "n_lvn", "range_bins")


def session_features(profile: DataFrame, area: DataFrame, nodes: DataFrame, states: DataFrame) -> DataFrame:
    """symbol, session, poc, va_width, n_hvn, n_lvn, range_bins, state."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    counts = nodes.groupBy(*KEY).agg(count("HVN").alias("n_hvn"), count("LVN").alias("n_lvn"))
    spans = profile.groupBy(*KEY).agg((F.max("bin") - F.min("bin") + 1).alias("range_bins"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    joined = area.join(spans, KEY).join(counts, KEY, "left").join(states, KEY)
    return joined.select(*KEY, "poc", (F.col("vah") - F.col("val") + 1).alias("va_width"), zero("n_hvn"), zero("n_lvn"), "range_bins", "state")


def daily_close(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("symbol", F.to_date("bucket").alias("session")).agg(F.max_by("close", "bucket").alias("close"))


def next_session_label(hourly: DataFrame) -> DataFrame:
    """symbol, session, label: the sign of the next close against this one; null for the last."""
    return daily_close(hourly).select(*KEY, F.signum(F.lead("close").over(by_symbol()) - F.col("close")).cast("int").alias("label"))


def state_up_rate(states: DataFrame, labels: DataFrame) -> DataFrame:
    """state, n, n_up, p_up."""
    rows = states.filter("state is not null").join(labels.filter("label is not null"), KEY)
    counts = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") > 0, 1)).alias("n_up"))
    return counts.withColumn("p_up", F.round(F.col("n_up") / F.col("n"), 6))


def acceptance_outcome(structure: DataFrame, labels: DataFrame) -> DataFrame:
    """close_loc, label, n."""
    rows = structure.filter("close_loc is not null").join(labels.filter("label is not null"), KEY)
    return rows.groupBy("close_loc", "label").agg(F.count(F.lit(1)).alias("n"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as DuckDB has it: null without pairs, NaN if either side is constant.

    Spark's corr divides by zero there, or, as the means of partitions are merged with rounding, by a trace
    of variance that a constant hasn't; so the extremes tell what is constant.
    """
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (spread == 0)
    return F.when(constant, F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / spread)


def feature_corr(features: DataFrame, labels: DataFrame) -> DataFrame:
    """feature, corr of each with the label, of the sessions that have a state and a label; NaN if the feature or the label is constant."""
    rows = features.filter("state is not null").join(labels.filter("label is not null"), KEY)
    wide = rows.agg(*[correlation(F.col(c).cast("double"), F.col("label").cast("double")).alias(c) for c in FEATURES])
    stacked = f"stack({len(FEATURES)}, {', '.join(f'{c!r}, {c}' for c in FEATURES)}) as (feature, corr)"
    return wide.selectExpr(stacked).select("feature", F.round("corr", 6).alias("corr"))


def strategy_equity(states: DataFrame, hourly: DataFrame) -> DataFrame:
    """symbol, session, position (1 after UP, -1 after DOWN, else 0), pnl_cents to the next close, equity_cents so far."""
    closes = daily_close(hourly).select(*KEY, cents("close").alias("c"))
    rows = states.join(closes, KEY).withColumn("next", F.lead("c").over(by_symbol())).filter("state is not null and next is not null")
    rows = rows.withColumn("position", F.expr("CASE state WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 ELSE 0 END")).withColumn("pnl_cents", F.col("position") * (F.col("next") - F.col("c")))
    return rows.select(*KEY, "position", "pnl_cents", F.sum("pnl_cents").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)).alias("equity_cents"))
