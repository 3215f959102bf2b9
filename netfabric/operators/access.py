"""Why a client can reach a server: flows, controls, detections and path of each pair."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.functions.net import is_ip, is_ipv4, short_host
from netfabric.functions.skew import lookup_join, top_rows
from netfabric.operators.entities import (
    AliasIndex, communication_between, configured_policies, entity_addresses, find_entities, governed_policies, select_pair, tagged_values,
)
from netfabric.operators.flows import alert_counts_for_ips, alerts_for_ips, observers_for_ips
from netfabric.operators.topology import enforcement_points, find_path
from netfabric.session import cut_lineage

TimeArg = str | datetime

# How the firewall and the configured rules were found.
PROVENANCE, TOPOLOGY = "provenance", "topology"
NO_FIREWALL, UNMATCHED = "no_path_firewall", "firewall_name_unmatched"


def _distinct_list(value: Column) -> Column:
    return F.array_sort(F.collect_set(value))


def observed_by(
    entities: DataFrame, index: AliasIndex, events: DataFrame, ids: DataFrame, as_of: TimeArg, *, since: TimeArg = "now-24h",
) -> DataFrame:
    """Firewalls that logged traffic of each lookup's best entity, by the lookup and all its addresses."""
    best = cut_lineage(find_entities(entities, index, ids, best_only=True).select("lookup", "entity_id", "name"))
    held = entity_addresses(index, best.select("lookup", "entity_id")).select("lookup", "ip")
    values = best.select("lookup", F.col("lookup").alias("ip")).unionByName(held).filter(is_ip("ip")).distinct()
    seen = observers_for_ips(events, values, as_of, since=since, keys=["lookup"])
    lists = seen.groupBy("lookup").agg(_distinct_list(short_host("observer_hostname")).alias("firewalls"))
    return best.join(lists, "lookup", "left").withColumn("firewalls", F.coalesce("firewalls", F.array().cast("array<string>")))


class Access(NamedTuple):
    """Answers and the long tables behind them.

    ``answers``: one row per pair.  ``controls``: the rules that its flows named.
    ``firewalls``: the firewalls of each pair.  ``configured``: every rule of each of
    those firewalls, once, however many pairs it stands between.  ``detections``: by
    pair, newest first where they are limited.
    """

    answers: DataFrame
    controls: DataFrame
    firewalls: DataFrame
    configured: DataFrame
    detections: DataFrame


def explain_access(
    pairs: DataFrame, entities: DataFrame, index: AliasIndex, entity_edges: DataFrame, gov_edges: DataFrame, nodes: DataFrame,
    edges: DataFrame, events: DataFrame, as_of: TimeArg, *, since: TimeArg = "now-24h", detection_limit: int | None = None,
) -> Access:
    """Why each ``client`` of ``pairs`` reaches its ``server``.

    ``entity_edges`` are typed communicated_with edges; ``gov_edges`` holds
    governed_by edges of both provenances.  The firewall that logged a flow is on its
    path; where none did, the topology of the pair tells, and only such pairs are
    looked for there.  ``detections_truncated`` says whether ``detection_limit`` left any out.
    """
    keys = ["client", "server"]
    asked = cut_lineage(pairs.select(*keys).distinct())
    lookups = asked.select(F.explode(F.array("client", "server")).alias("lookup"))
    candidates = cut_lineage(find_entities(entities, index, lookups).select("lookup", "entity_id", "confidence", "last_seen"))
    left = asked.join(candidates.withColumnRenamed("lookup", "client"), "client").select(*keys, "entity_id")
    right = asked.join(candidates.withColumnRenamed("lookup", "server"), "server").select(*keys, "entity_id")
    between = cut_lineage(communication_between(entity_edges, left, right, as_of, since=since, keys=keys))
    chosen = select_pair(between, keys).select(*keys, "client_id", "server_id")

    # Without a communication edge each side falls back to its best candidate.
    best = top_rows(candidates, ["lookup"], [F.col("confidence").desc(), F.col("last_seen").desc(), F.col("entity_id")])
    best_client = best.select(F.col("lookup").alias("client"), F.col("entity_id").alias("_c"))
    best_server = best.select(F.col("lookup").alias("server"), F.col("entity_id").alias("_s"))
    ends = cut_lineage(
        asked.join(best_client, "client", "left").join(best_server, "server", "left").join(chosen, keys, "left")
        .select(*keys, F.coalesce("client_id", "_c").alias("client_id"), F.coalesce("server_id", "_s").alias("server_id"))
    )
    ok = ends.filter(F.col("client_id").isNotNull() & F.col("server_id").isNotNull())

    picked = cut_lineage(between.join(chosen, [*keys, "client_id", "server_id"], "left_semi"))
    totals = picked.groupBy(*keys).agg(F.sum("sessions").alias("sessions"), F.sum("bytes").alias("bytes"))
    values = cut_lineage(picked.select(*keys, F.explode(
        F.concat(*[tagged_values(c) for c in ("ports", "providers", "observer_hosts")])
    ).alias("_v")).select(*keys, "_v.*").distinct())
    value_sets = values.filter("what <> 'observer_hosts'").groupBy(*keys).agg(
        _distinct_list(F.when(F.col("what") == "ports", F.col("value").cast("int"))).alias("ports"),
        _distinct_list(F.when(F.col("what") == "providers", F.col("value"))).alias("providers"),
    )

    logged = values.filter("what = 'observer_hosts'").select(*keys, short_host("value").alias("firewall"), F.lit(PROVENANCE).alias("basis"))
    unseen = ok.select(*keys).join(logged.select(*keys), keys, "left_anti")
    points = enforcement_points(
        nodes, edges, unseen.select(F.col("client").alias("src_lookup"), F.col("server").alias("dst_lookup")), as_of, since=since)
    placed = points.select(
        F.col("src_lookup").alias("client"), F.col("dst_lookup").alias("server"), F.explode("firewalls").alias("firewall"), F.lit(TOPOLOGY).alias("basis"))
    walls = cut_lineage(logged.unionByName(placed).distinct())
    rules = cut_lineage(configured_policies(entities, gov_edges, walls.select("firewall")))
    per_wall = rules.groupBy("firewall").agg(F.count(F.lit(1)).alias("_rules"))
    wall_lists = lookup_join(walls, per_wall, "firewall", "left").groupBy(*keys).agg(
        F.array_sort(F.collect_list("firewall")).alias("firewalls"), F.first("basis").alias("firewall_basis"),
        F.coalesce(F.sum("_rules"), F.lit(0)).alias("coverage_configured"),
    ).withColumn("attributed_firewall", F.when(F.size("firewalls") == 1, F.col("firewalls")[0]))

    named = governed_policies(gov_edges.filter(F.col("source") == "observed"), entities, picked.select(*keys, "edge_id"), keys)
    controls = named.select(*keys, "vendor", "rule", "source").distinct().join(
        wall_lists.select(*keys, F.col("attributed_firewall").alias("firewall"), "firewall_basis"), keys, "left"
    ).select(*keys, "firewall", "vendor", "rule", "source", F.coalesce("firewall_basis", F.lit(NO_FIREWALL)).alias("firewall_basis"))

    end_ids = ok.select(*keys, F.explode(F.array("client_id", "server_id")).alias("entity_id")).distinct()
    asked_ips = ok.select(*keys, F.explode(F.array("client", "server")).alias("ip"))
    ips = cut_lineage(entity_addresses(index, end_ids).select(*keys, "ip").unionByName(asked_ips).filter(is_ipv4("ip")).distinct())
    fields = ["event_id", "timestamp", "signature", "signature_id", "category", "severity", "source_ip", "destination_ip"]
    if detection_limit is None:
        # Every detection of every pair may be far more than the events: the rows are made where they are read, and counted without.
        detections = alerts_for_ips(events, ips, as_of, since=since, keys=keys).select(*keys, *fields)
        counted = alert_counts_for_ips(events, ips, as_of, since=since, keys=keys).withColumnRenamed("detections", "_found")
        shown = F.col("_found")
    else:
        found_alerts = cut_lineage(alerts_for_ips(events, ips, as_of, since=since, keys=keys, limit=detection_limit + 1).select(*keys, *fields))
        counted = found_alerts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_found"))
        shown = F.least("_found", F.lit(detection_limit))
        detections = top_rows(found_alerts, keys, [F.col("timestamp").desc(), F.col("event_id")], detection_limit)
    paths = find_path(nodes, edges, ok.select(F.col("client").alias("src_lookup"), F.col("server").alias("dst_lookup")), as_of, since=since).select(
        F.col("src_lookup").alias("client"), F.col("dst_lookup").alias("server"),
        F.struct("found", "path_nodes", "hops").alias("topology_path"),
    )

    def entity(id_col: str, out: str) -> DataFrame:
        return entities.select(F.col("entity_id").alias(id_col), F.struct("entity_id", "name", "identity_basis").alias(out))

    result = (
        ends.join(entity("client_id", "client_entity"), "client_id", "left").join(entity("server_id", "server_entity"), "server_id", "left")
        .join(totals, keys, "left").join(value_sets, keys, "left").join(wall_lists, keys, "left").join(counted, keys, "left").join(paths, keys, "left")
    )
    found = F.col("client_id").isNotNull() & F.col("server_id").isNotNull()
    strings, none = F.array().cast("array<string>"), F.lit(0).cast("long")
    configured_basis = (
        F.when(~found, F.lit(None)).when(F.col("firewalls").isNull(), NO_FIREWALL)
        .when(F.col("coverage_configured") == 0, UNMATCHED).otherwise(TOPOLOGY)
    )
    answers = result.select(
        *keys, found.alias("found"), "client_entity", "server_entity",
        F.coalesce("sessions", none).alias("sessions"), F.coalesce("bytes", none).alias("bytes"),
        F.coalesce("ports", F.array().cast("array<int>")).alias("ports"), F.coalesce("providers", strings).alias("providers"),
        F.coalesce("firewalls", strings).alias("firewalls"), F.when(found, F.coalesce("firewall_basis", F.lit(NO_FIREWALL))).alias("firewall_basis"),
        "attributed_firewall", configured_basis.alias("configured_basis"), "topology_path",
        (F.coalesce("sessions", none) > 0).alias("coverage_observed"), F.coalesce("coverage_configured", none).alias("coverage_configured"),
        F.coalesce(shown, none).alias("detection_count"), F.coalesce(F.col("_found") > shown, F.lit(False)).alias("detections_truncated"),
    )
    return Access(answers, controls, walls.select(*keys, "firewall"), rules, detections)
