"""Market states and their transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalars import by_symbol


def market_state(area: DataFrame) -> DataFrame:
    """symbol, session, state: UP, DOWN or BALANCE against the session before; null for the first."""
    rows = area.select("symbol", "session", "poc", "val", "vah", *[F.lag(c).over(by_symbol()).alias(f"p{c}") for c in ("poc", "val", "vah")])
    state = F.expr(
        """CASE WHEN pval IS NULL THEN NULL
        WHEN val > pvah OR (poc > ppoc AND vah > pvah AND val >= pval) THEN 'UP'
        WHEN vah < pval OR (poc < ppoc AND val < pval AND vah <= pvah) THEN 'DOWN'
        ELSE 'BALANCE' END"""
    )
    return rows.select("symbol", "session", state.alias("state"))


def state_transitions(states: DataFrame) -> DataFrame:
    """state, next_state, n, p: n over all transitions from the state."""
    pairs = states.filter("state is not null").select("state", F.lead("state").over(by_symbol()).alias("next_state")).filter("next_state is not null")
    counts = pairs.groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("state")), 6))


def markov_order2(states: DataFrame) -> DataFrame:
    """s0, s1, s2, n."""
    rows = states.filter("state is not null").select(F.col("state").alias("s0"), F.lead("state", 1).over(by_symbol()).alias("s1"), F.lead("state", 2).over(by_symbol()).alias("s2")).filter("s2 is not null")
    return rows.groupBy("s0", "s1", "s2").agg(F.count(F.lit(1)).alias("n"))


def markov_chi_square(states: DataFrame) -> DataFrame:
    """s1, n, chi2, dof: whether, from state s1, the next state depends on the one before; a test of first order against second, to be summed over s1.

    Expected counts are the products of the margins of each s1; cells that nothing fell in count too.
    """
    cells = markov_order2(states)
    before = cells.groupBy("s1", "s0").agg(F.sum("n").alias("a"))
    after = cells.groupBy("s1", "s2").agg(F.sum("n").alias("b"))
    size = cells.groupBy("s1").agg(F.sum("n").alias("n_all"), ((F.countDistinct("s0") - 1) * (F.countDistinct("s2") - 1)).alias("dof"))
    grid = before.join(after, "s1").join(size, "s1").join(cells, ["s0", "s1", "s2"], "left").withColumn("e", F.col("a") * F.col("b") / F.col("n_all"))
    return grid.groupBy("s1", F.col("n_all").alias("n"), "dof").agg(F.round(F.sum((F.coalesce("n", F.lit(0)) - F.col("e")) ** 2 / F.col("e")), 6).alias("chi2")).select("s1", "n", "chi2", "dof")


def split_day(states: DataFrame, part: float = 0.8) -> DataFrame:
    """One row, `until`: the last of the first `part` of all days that have a session; later ones are held out."""
    days = states.select("session").distinct()
    return days.agg(F.sort_array(F.collect_list("session")).alias("d")).select(F.expr(f"d[cast(floor({part} * size(d)) as int) - 1]").alias("until"))


def order_likelihood(states: DataFrame) -> DataFrame:
    """model, n, log_likelihood (mean a transition) of held-out sessions, by chains of order 0, 1 and 2 counted on those before; counts are smoothed by one."""
    rows = states.filter("state is not null").select("symbol", "session", F.col("state").alias("s2"), F.lag("state", 1).over(by_symbol()).alias("s1"), F.lag("state", 2).over(by_symbol()).alias("s0")).filter("s0 is not null")
    rows = rows.join(F.broadcast(split_day(states)))  # one row
    known, later = rows.filter("session <= until"), rows.filter("session > until")
    k = 3  # UP, DOWN and BALANCE
    out = []
    for order, context in enumerate(([], ["s1"], ["s0", "s1"])):
        one = F.lit(1).alias("one")
        both = known.groupBy(*context, "s2", one).agg(F.count(F.lit(1)).alias("both"))
        alone = known.groupBy(*context, one).agg(F.count(F.lit(1)).alias("alone"))
        told = later.withColumn("one", F.lit(1)).join(both, [*context, "s2", "one"], "left").join(alone, [*context, "one"], "left")
        p = (F.coalesce("both", F.lit(0)) + 1) / (F.coalesce("alone", F.lit(0)) + k)
        out.append(told.agg(F.lit(f"order {order}").alias("model"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.log(p)), 6).alias("log_likelihood")))
    return out[0].unionByName(out[1]).unionByName(out[2])
