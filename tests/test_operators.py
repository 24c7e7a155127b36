import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import bars, features, predict, states, structure, volume
from marketlens.plans.catalog import Stages
from marketlens.streaming import bars as streaming

T0 = dt.datetime(2024, 1, 1, 9)


@pytest.fixture(scope="module")
def stages(spark, data):
    return Stages(spark, data)


def ticks(spark, rows):
    return spark.createDataFrame([("A", T0 + dt.timedelta(minutes=m), s, p, v) for m, s, p, v in rows], "symbol string, ts timestamp_ntz, seq bigint, price double, volume bigint")


def test_ties_in_time_go_by_sequence(spark):
    bar = bars.bars(ticks(spark, [(0, 2, 5.0, 1), (0, 1, 7.0, 1), (1, 3, 6.0, 1), (1, 4, 4.0, 1)])).first()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume, bar.trades) == (7.0, 7.0, 4.0, 4.0, 4, 4)


def test_bar_invariants(stages):
    assert stages.hourly.filter("low > open or low > close or high < open or high < close").count() == 0
    direct = bars.bars(stages.ticks, "DAY")
    assert direct.exceptAll(bars.resampled(stages.hourly)).count() == 0


def test_gaps_are_filled(spark):
    rows = bars.gap_filled(bars.bars(ticks(spark, [(0, 1, 5.0, 3), (185, 2, 8.0, 4)]))).orderBy("bucket").collect()
    assert [(r.close, r.volume) for r in rows] == [(5.0, 3), (5.0, 0), (5.0, 0), (8.0, 4)]


def test_profile_conserves_volume(spark, stages):
    assert stages.profile.agg(F.sum("volume")).first()[0] == stages.ticks.agg(F.sum("volume")).first()[0]
    few = volume.volume_profile(bars.bars(ticks(spark, [(0, 1, 1.0, 1), (1, 2, 21.0, 1)])))  # two lots over five bins
    assert [(r.bin, r.volume) for r in few.orderBy("bin").collect()] == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 0)]


def profile(spark, volumes):
    return spark.createDataFrame([("A", dt.date(2024, 1, 1), b, v) for b, v in volumes], "symbol string, session date, bin bigint, volume bigint")


def area(spark, volumes):
    r = volume.value_area(profile(spark, volumes)).first()
    return r.poc, r.val, r.vah, r.va_volume, r.total


def test_value_area_by_hand(spark, stages):
    assert area(spark, [(3, 10)]) == (3, 3, 3, 10, 10)
    assert area(spark, [(0, 5), (1, 5)]) == (0, 0, 1, 10, 10)  # the lower of equals is the point of control
    assert area(spark, [(0, 3), (1, 10), (2, 3), (3, 1)]) == (1, 1, 2, 13, 17)  # up, if both sides are equal
    assert area(spark, [(0, 0), (1, 0)]) == (0, 0, 0, 0, 0)
    assert area(spark, [(0, 4), (3, 5)])[1:3] == (0, 3)  # bins without volume lie between
    assert stages.area.filter("val > poc or poc > vah or 10 * va_volume < 7 * total").count() == 0


def test_nodes_and_zones(spark):
    p = profile(spark, [(0, 1), (1, 9), (2, 1), (3, 8), (5, 2)])
    kinds = {(r.bin, r.kind) for r in volume.volume_nodes(p).collect()}
    assert kinds == {(1, "HVN"), (2, "LVN"), (3, "HVN"), (4, "LVN"), (5, "HVN")}
    zones = {(r.kind, r.bin_lo, r.bin_hi, r.volume) for r in volume.node_zones(p).collect()}
    assert zones == {("LOW", 0, 0, 1), ("HIGH", 1, 1, 9), ("LOW", 2, 2, 1), ("HIGH", 3, 3, 8), ("LOW", 4, 4, 0)}


def test_too_many_bins_are_refused(spark):
    with pytest.raises(Exception, match="too many bins"):
        volume.value_area(profile(spark, [(0, 1), (volume.MOST_BINS + 1, 1)])).collect()


def test_persistence_breaks_at_a_missing_day(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 4)]
    nodes = spark.createDataFrame([("A", d, 7, "HVN") for d in days], "symbol string, session date, bin bigint, kind string")
    runs = sorted((r.first_session.day, r.last_session.day, r.n_sessions) for r in structure.persistent_nodes(nodes).collect())
    assert runs == [(1, 2, 2), (4, 4, 1)]


def test_transition_rows_sum_to_one(stages):
    sums = states.state_transitions(stages.states).groupBy("state").agg(F.sum("p").alias("s")).collect()
    assert sums and all(abs(r.s - 1) < 1e-5 for r in sums)


def test_first_session_has_no_state_and_last_no_label(stages):
    assert stages.states.filter("state is null").count() == 5
    assert stages.labels.filter("label is null").count() == 5


def test_equity_adds_up(stages):
    rows = features.strategy_equity(stages.states, stages.hourly).orderBy("symbol", "session").collect()
    total = {}
    for r in rows:
        total[r.symbol] = total.get(r.symbol, 0) + r.pnl_cents
        assert r.equity_cents == total[r.symbol]


def test_hidden_chain_finds_two_levels():
    rng = np.random.default_rng(0)
    truth = np.repeat([0, 1, 0, 1], 40)
    post, said = predict.baum_welch(rng.normal(truth * 4.0, 0.5))
    assert (post.argmax(1) == truth).mean() > 0.97 and (np.diff(said) > -1e-6).all()


def test_stream_equals_batch_on_closed_hours(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartitionByRange(12, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("part-*"))
    assert len(files) == 12
    for i, f in enumerate(files):  # a stream takes files by their age
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    stream = streaming.stream_ohlcv(streaming.read_events(spark, str(tmp_path / "in"), fields))
    query = stream.writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("bars_out")
    batch = bars.bars(bars.ticks(events))
    assert got.count() > 0.8 * batch.count() and got.exceptAll(batch).count() == 0


def test_bars_of_four_hours(spark):
    hourly = bars.bars(ticks(spark, [(0, 1, 5.0, 1), (170, 2, 7.0, 1), (185, 3, 6.0, 1), (300, 4, 4.0, 1)]))  # from nine on
    got = [(r.bucket.hour, r.open, r.close, r.volume, r.trades) for r in bars.resampled(hourly, hours=4).orderBy("bucket").collect()]
    assert got == [(8, 5.0, 7.0, 2, 2), (12, 6.0, 4.0, 2, 2)]


def chain(spark, states, symbol="A"):
    days = [(symbol, dt.date(2024, 1, 1) + dt.timedelta(days=i), s) for i, s in enumerate(states)]
    return spark.createDataFrame(days, "symbol string, session date, state string")


def test_chi_square_by_hand(spark):
    rng = np.random.default_rng(1)
    names = ["UP", "DOWN", "BALANCE"]
    seq = [names[i] for i in rng.integers(0, 3, 200)]
    want = {}
    for s1 in names:
        n = np.array([[sum(t == (a, s1, b) for t in zip(seq, seq[1:], seq[2:])) for b in names] for a in names], float)
        e = np.outer(n.sum(1), n.sum(0)) / n.sum()
        want[s1] = (int(n.sum()), pytest.approx(((n - e) ** 2 / e).sum(), abs=1e-5), 4)
    got = {r.s1: (r.n, r.chi2, r.dof) for r in states.markov_chi_square(chain(spark, seq)).collect()}
    assert got == want


def test_chains_of_higher_order_tell_what_has_memory(spark):
    seq = ["UP", "UP", "DOWN", "DOWN"] * 60  # the two states before say all, one says nothing
    got = {r.model: r.log_likelihood for r in states.order_likelihood(chain(spark, seq)).collect()}
    assert got["order 2"] > -0.1 and got["order 1"] < -0.6 and got["order 0"] < -0.6
    assert states.split_day(chain(spark, seq[:10])).first().until == dt.date(2024, 1, 8)


def test_held_out_sessions_are_not_learned_from(spark, stages):
    cut = states.split_day(stages.features).first().until
    turned = stages.features.withColumn("va_width", F.when(F.col("session") > F.lit(cut), F.col("va_width") * 1000).otherwise(F.col("va_width")))
    a, b = ({(r.symbol, r.session): r.p_up for r in predict.label_model(x, stages.labels).filter("not held_out").collect()} for x in (stages.features, turned))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_universes_without_a_symbol(stages):
    whole = {(r.interval, r.symbol): (r.range_cents, r.n_bars) for r in bars.aggregation_sensitivity(stages.ticks).collect()}
    for r in bars.universe_sensitivity(stages.ticks).collect():
        rest = bars.aggregation_sensitivity(stages.ticks, tuple(s for i, s in whole if i == r.interval and s not in (None, r.without))) if r.interval == "4h" else None
        if rest is not None:
            total = rest.filter("symbol is null and interval = '4h'").first()
            assert r.mean_range == pytest.approx(total.range_cents / total.n_bars, abs=1e-5)


def test_constants_have_no_correlation(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 5)]
    x = spark.createDataFrame([("A", d, 0, k, 1, k, 2 * k, "UP") for k, d in enumerate(days)], "symbol string, session date, poc bigint, va_width bigint, n_hvn bigint, n_lvn bigint, range_bins bigint, state string")
    labels = lambda *of: spark.createDataFrame(list(zip("A" * 4, days, of)), "symbol string, session date, label int")
    corr = lambda y: {r.feature: r["corr"] for r in features.feature_corr(x, y).collect()}
    some = corr(labels(-1, 0, 1, None))
    assert math.isnan(some["poc"]) and math.isnan(some["n_hvn"]) and {some[c] for c in ("va_width", "n_lvn", "range_bins")} == {1.0}
    assert all(map(math.isnan, corr(labels(1, 1, 1, 1)).values())) and all(map(math.isnan, corr(labels(1, None, None, None)).values()))
    assert set(corr(labels(None, None, None, None)).values()) == {None}


def test_merged_partitions_leave_a_constant_without_correlation(spark):
    rows = spark.range(0, 147, 1, 3).select((F.col("id") * 0 + 1).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))  # 49 * (1 / 49) < 1
    assert 0 < rows.agg(F.stddev_pop("x")).first()[0] < 1e-15
    assert math.isnan(rows.agg(features.correlation(F.col("x"), F.col("y"))).first()[0]) and math.isnan(rows.agg(features.correlation(F.col("y"), F.col("x"))).first()[0])
