"""Registry of the analytical queries: each takes (spark, folder) and composes the stages over its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.operators import bars, features, predict, states, structure, volume
from marketlens.plans.oracles import ORACLES
from marketlens.sources import inventory
from marketlens.sources.tables import read_table, write_parquet


class Stages:
    """The stages over one folder, each built from those before it when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder
        self.events = read_table(spark, folder, "events")
        self.ticks = bars.ticks(self.events)
        self.hourly = bars.bars(self.ticks)
        self.profile = volume.volume_profile(self.hourly)

    @property
    def area(self) -> DataFrame:
        return volume.value_area(self.profile)

    @property
    def nodes(self) -> DataFrame:
        return volume.volume_nodes(self.profile)

    @property
    def structure(self) -> DataFrame:
        return structure.auction_structure(self.hourly, self.area)

    @property
    def persistent(self) -> DataFrame:
        return structure.persistent_nodes(self.nodes)

    @property
    def states(self) -> DataFrame:
        return states.market_state(self.area)

    @property
    def labels(self) -> DataFrame:
        return features.next_session_label(self.hourly)

    @property
    def features(self) -> DataFrame:
        return features.session_features(self.profile, self.area, self.nodes, self.states)


_BY_NAME: dict[str, Callable[[Stages], DataFrame]] = {
    "table_inventory": lambda s: inventory.table_inventory(s.spark, s.folder),
    "column_quality": lambda s: inventory.quality(s.spark, s.folder),
    "ohlcv_hourly": lambda s: s.hourly,
    "ohlcv_resample_daily": lambda s: bars.resampled(s.hourly),
    "vwap_daily": lambda s: bars.vwap_daily(s.ticks),
    "gap_filled_hourly": lambda s: bars.gap_filled(s.hourly),
    "rolling_range": lambda s: bars.rolling_range(s.hourly),
    "aggregation_sensitivity": lambda s: bars.aggregation_sensitivity(s.ticks),
    "universe_sensitivity": lambda s: bars.universe_sensitivity(s.ticks),
    "volume_profile": lambda s: s.profile,
    "volume_profile_ticks": lambda s: volume.volume_profile_ticks(s.ticks),
    "point_of_control": lambda s: volume.point_of_control(s.profile),
    "value_area": lambda s: s.area,
    "value_area_ranked": lambda s: volume.value_area_ranked(s.profile),
    "volume_nodes": lambda s: s.nodes,
    "node_zones": lambda s: volume.node_zones(s.profile),
    "auction_structure": lambda s: s.structure,
    "persistent_nodes": lambda s: s.persistent,
    "node_streaks": lambda s: structure.node_streaks(s.persistent),
    "va_overlap": lambda s: structure.va_overlap(s.area),
    "market_state": lambda s: s.states,
    "state_transitions": lambda s: states.state_transitions(s.states),
    "markov_order2": lambda s: states.markov_order2(s.states),
    "markov_chi_square": lambda s: states.markov_chi_square(s.states),
    "order_likelihood": lambda s: states.order_likelihood(s.states),
    "session_features": lambda s: s.features,
    "next_session_label": lambda s: s.labels,
    "state_up_rate": lambda s: features.state_up_rate(s.states, s.labels),
    "acceptance_outcome": lambda s: features.acceptance_outcome(s.structure, s.labels),
    "feature_corr": lambda s: features.feature_corr(s.features, s.labels),
    "strategy_equity": lambda s: features.strategy_equity(s.states, s.hourly),
    "state_prediction": lambda s: predict.state_prediction(s.features, s.labels),
    "label_model_quality": lambda s: predict.label_model_quality(s.features, s.labels),
    "label_model": lambda s: predict.label_model(s.features, s.labels),
    "state_mixture": lambda s: predict.state_mixture(s.features),
    "hidden_states": lambda s: predict.hidden_states(s.features),
}


def exported(df: DataFrame) -> DataFrame:
    """df in types that other engines' clients show alike: dates as text, and whole numbers with nulls as doubles."""
    kinds = {"session": "string", "first_session": "string", "last_session": "string"} | ({"label": "double"} if "label" in df.columns else {})
    return df.withColumns({c: df[c].cast(kinds[c]) for c in df.columns if c in kinds})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: lambda spark, folder, build=build: exported(build(Stages(spark, folder))) for name, build in _BY_NAME.items()}

#: What the commands build, by artifact.
PROFILES = ("volume_profile", "point_of_control", "value_area", "volume_nodes", "node_zones")
ARTIFACTS = {"profiles": PROFILES, "features": ("auction_structure", "persistent_nodes", "market_state", "session_features", "next_session_label")}


def build(spark: SparkSession, folder: str, out: str, kind: str) -> list[str]:
    """Writes the artifacts of a kind as Parquet under a folder, one after another, and says which."""
    for name in ARTIFACTS[kind]:
        write_parquet(_BY_NAME[name](Stages(spark, folder)), f"{out}/{name}.parquet")
    return [f"{out}/{name}.parquet" for name in ARTIFACTS[kind]]


__all__ = ["ARTIFACTS", "ORACLES", "QUERIES", "Stages", "build"]
