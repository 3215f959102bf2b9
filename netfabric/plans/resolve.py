"""Resolver runs: operators composed the way a scheduled job would run them."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfabric.functions.ids import DEFAULT_TENANT
from netfabric.operators import entities as en
from netfabric.operators import metrics as me
from netfabric.operators import policy as po
from netfabric.operators import topology as to
from netfabric.session import cut_lineage

TimeArg = str | datetime


class EntityResolution:
    """Assets, observed policies and their edges from one window of flows.

    Every step is computed on first use and shared.  The steps several others
    read (the flow totals, which alone scan the events, the bindings, the
    addresses and the resolved flows) are written out once instead of being
    computed again by each reader.
    """

    def __init__(
        self, events: DataFrame, observations: DataFrame, as_of: TimeArg, *, since: TimeArg = "now-24h",
        bindings_as_of: TimeArg | None = None, bindings_since: TimeArg = en.BINDING_LOOKBACK, tenant: str = DEFAULT_TENANT,
    ) -> None:
        self._events, self._observations, self._tenant = events, observations, tenant
        self._as_of, self._since = as_of, since
        self._bindings_as_of, self._bindings_since = bindings_as_of or as_of, bindings_since

    @cached_property
    def flows(self) -> DataFrame:
        return cut_lineage(en.flow_vantage(self._events, self._as_of, since=self._since, tenant=self._tenant))

    @cached_property
    def bindings(self) -> DataFrame:
        arp = en.arp_bindings(self._observations, self._bindings_as_of, since=self._bindings_since, tenant=self._tenant)
        return cut_lineage(en.binding_map(arp))

    @cached_property
    def addresses(self) -> DataFrame:
        return cut_lineage(en.asset_addresses(self.flows, self.bindings, self._tenant))

    @cached_property
    def resolved(self) -> DataFrame:
        return cut_lineage(en.flows_with_assets(self.flows, self.addresses, self._tenant))

    @property
    def assets(self) -> DataFrame:
        return en.assets(self.addresses, self._tenant)

    @property
    def policies(self) -> DataFrame:
        return en.observed_policies(self.flows, self._tenant)

    @property
    def communication(self) -> DataFrame:
        return en.communication_edges(self.resolved, self._tenant)

    @property
    def governed(self) -> DataFrame:
        return en.governed_edges(self.resolved, self._tenant)


def resolve_policies(rules: DataFrame, tenant: str = DEFAULT_TENANT) -> dict[str, DataFrame]:
    """Firewalls, configured policies and the edges between them."""
    return {
        "firewalls": po.firewall_entities(rules, tenant), "policies": po.policy_entities(rules, tenant),
        "governed": po.policy_edges(rules, tenant),
    }


def entity_tables(observed: EntityResolution, configured: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The entity table and the governed_by edge table of both provenances."""
    entities = (
        en.assets_as_entities(observed.assets, observed.addresses)
        .unionByName(en.observed_as_entities(observed.policies))
        .unionByName(po.firewalls_as_entities(configured["firewalls"]))
        .unionByName(po.policies_as_entities(configured["policies"]))
    )
    return entities, observed.governed.unionByName(configured["governed"])


def resolve_topology(observations: DataFrame, flow_edges: DataFrame, tenant: str = DEFAULT_TENANT) -> tuple[DataFrame, DataFrame]:
    """Graph nodes and edges from observations and flow edges, devices fused."""
    # Fusion reads the nodes several times; the observations are scanned once for them.
    nodes = cut_lineage(to.nodes_from_observations(observations, tenant))
    edges = to.edges_from_observations(observations, tenant)
    canonical = to.device_canonical_ids(nodes)
    nodes = to.merge_devices(nodes, canonical)
    edges = to.edge_confidence(to.remap_edges(edges, canonical, tenant))
    placeholders = to.placeholder_nodes(flow_edges, nodes, tenant)
    return (
        nodes.unionByName(placeholders),
        edges.select(*to.EDGE_COLUMNS).unionByName(flow_edges.select(*to.EDGE_COLUMNS)),
    )


def public_metrics_run(
    events: DataFrame, pseudonyms: DataFrame, key: bytes, key_version: int, as_of: TimeArg, *,
    since: TimeArg = f"now-{me.LOOKBACK_HOURS}h", baseline: TimeArg = f"now-{me.BASELINE_DAYS}d",
    bucket_seconds: int = me.BUCKET_SECONDS, top_n: int = me.TOP_ENTITIES, tenant: str = DEFAULT_TENANT,
) -> dict[str, DataFrame]:
    """One run of the metric resolver: every enabled measure of the catalogue.

    Returns ``metrics``, ``entities`` (by surrogate) and ``pseudonyms`` rows to write.
    """
    window = {"since": since, "bucket_seconds": bucket_seconds, "tenant": tenant}
    metrics, per_entity = [], []
    for measure in me.enabled_measures():
        if measure.kind == "index":
            index = me.deny_rate_index if measure.metric == "deny_rate_index" else me.ips_volume_index
            metrics.append(index(events, as_of, baseline=baseline, **window))
            continue
        metrics.append(me.metric_series(events, measure.metric, as_of, **window))
        if measure.per_entity:
            per_entity.append(me.top_entities(me.entity_series(events, measure.metric, as_of, **window), top_n))
    series = metrics[0]
    for more in metrics[1:]:
        series = series.unionByName(more)
    leaders = per_entity[0]
    for more in per_entity[1:]:
        leaders = leaders.unionByName(more)
    minted = me.mint_surrogates(leaders.select(F.col("ip").alias("real_value")), pseudonyms, "host", key, key_version, as_of)
    names = minted.select(F.col("real_value").alias("ip"), "surrogate")
    public = leaders.join(names, "ip").select("bucket_start", "surrogate", "metric", "value")
    return {
        "metrics": series.withColumn("tenant_id", F.lit(tenant)), "entities": public.withColumn("tenant_id", F.lit(tenant)),
        "pseudonyms": minted,
    }
