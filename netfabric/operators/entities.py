"""Assets, observed policies and the edges between them, resolved from flows and ARP bindings."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.functions.canonical import csv_set
from netfabric.functions.ids import DEFAULT_TENANT, entity_edge_id, entity_id, text
from netfabric.functions.net import lookup_form, segment
from netfabric.functions.skew import lookup_join, top_rows
from netfabric.functions.timeargs import window_filter
from netfabric.session import shared_path

TimeArg = str | datetime

# Look-back of the ARP bindings, confidences and provenance tags.
BINDING_LOOKBACK = "now-168h"
OBSERVED, CONFIGURED = "observed", "configured"
CONFIDENCE_MAC, CONFIDENCE_IP = 1.0, 0.5

ENTITY_COLUMNS = (
    "entity_id", "tenant_id", "kind", "name", "identifiers", "source", "identity_basis", "confidence",
    "attrs", "first_seen", "last_seen",
)
# Attributes of a configured rule that say nothing about what it matches, or are columns of their own.
NO_CLAUSE = ("provider", "device_name", "action", "from_zone", "to_zone", "position", "enabled", "hit_count", "hit_count_collected_at")
COMM_SETS = ("ports", "providers", "transports", "observer_hosts")


def flow_vantage(
    events: DataFrame, as_of: TimeArg, *, since: TimeArg = "now-24h", tenant: str = DEFAULT_TENANT,
) -> DataFrame:
    """Totals per (source, destination, logging device); rule and provider from the newest event.

    Partial aggregation runs before the shuffle; the port set has at most 65536 values.
    """
    df = events.filter(F.col("tenant_id") == tenant).filter(window_filter("timestamp", since, None, as_of))
    df = df.filter(F.col("source_ip").isNotNull() & F.col("destination_ip").isNotNull())
    keys = [
        F.col("source_ip").alias("src_ip"), F.col("destination_ip").alias("dst_ip"),
        text("observer_hostname").alias("observer_hostname"),
    ]
    newest = F.max_by(F.struct("rule_name", "event_provider", "network_transport"), F.struct("timestamp", "event_id"))
    grouped = df.groupBy(*keys).agg(
        F.sum(F.coalesce("network_bytes", F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("flows"),
        F.collect_set("destination_port").alias("ports"), newest.alias("_n"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    return grouped.select(
        "src_ip", "dst_ip", "observer_hostname", "bytes", "flows", F.array_sort("ports").alias("ports"),
        F.trim(text(F.col("_n.rule_name"))).alias("rule_name"), F.trim(text(F.col("_n.event_provider"))).alias("provider"),
        text(F.col("_n.network_transport")).alias("transport"), "first_seen", "last_seen",
    )


def arp_bindings(
    observations: DataFrame, as_of: TimeArg, *, since: TimeArg = BINDING_LOOKBACK, tenant: str = DEFAULT_TENANT,
) -> DataFrame:
    """Newest MAC per (device, address) and how many MACs the device saw for it."""
    arp = (
        observations.filter((F.col("tenant_id") == tenant) & (F.col("observation_type") == "arp_entry"))
        .filter(window_filter("observed_at", since, None, as_of))
        .select(
            "source_device", F.regexp_replace("subj_id", "^ip:", "").alias("ip"),
            F.regexp_replace("obj_id", "^mac:", "").alias("mac"), "observed_at",
        )
    )
    # Polling repeats the same binding; it is reduced to one row per MAC first.
    per_mac = arp.groupBy("source_device", "ip", "mac").agg(F.max("observed_at").alias("observed_at"))
    return per_mac.groupBy("source_device", "ip").agg(
        F.max_by("mac", F.struct("observed_at", "mac")).alias("mac"), F.max("observed_at").alias("observed_at"),
        F.count(F.lit(1)).alias("mac_count"),
    )


def binding_map(bindings: DataFrame) -> DataFrame:
    """``(segment, ip, mac, conflict)``: the newest MAC, and whether several were seen."""
    mac = F.lower(text("mac"))
    rows = bindings.select(
        segment("source_device").alias("segment"), "ip", mac.alias("mac"), "observed_at", "mac_count"
    ).filter((text("ip") != "") & (F.col("mac") != ""))
    return rows.groupBy("segment", "ip").agg(
        F.max_by("mac", F.struct("observed_at", "mac")).alias("_mac"),
        ((F.max("mac_count") > 1) | (F.min("mac") != F.max("mac"))).alias("conflict"),
    ).select("segment", "ip", F.col("_mac").alias("mac"), "conflict")


def asset_addresses(flows: DataFrame, bindings: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """One row per (segment, ip) seen in flows with the asset it belongs to.

    The key is the MAC when the segment binds the address, else the address
    within its segment, so an address reused elsewhere never merges.
    """
    ends = flows.select(
        segment("observer_hostname").alias("segment"), F.explode(F.array("src_ip", "dst_ip")).alias("ip"),
        "first_seen", "last_seen",
    )
    seen = ends.groupBy("segment", "ip").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    bound = seen.join(bindings, ["segment", "ip"], "left")
    key = F.when(F.col("mac").isNotNull(), F.concat(F.lit("mac:"), F.col("mac"))).otherwise(
        F.concat(F.lit("ip:"), F.col("segment"), F.lit(":"), F.col("ip"))
    )
    return bound.select(
        entity_id(F.lit(tenant), F.lit("asset"), key).alias("entity_id"), "segment", "ip", "mac",
        F.coalesce("conflict", F.lit(False)).alias("conflict"), "first_seen", "last_seen",
    )


def assets(addresses: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """One row per asset.  The addresses themselves stay in their own long table."""
    distinct_ips = addresses.groupBy("entity_id", "mac", "ip").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max(F.col("conflict") & F.col("mac").isNotNull()).alias("conflict"),
    )
    grouped = distinct_ips.groupBy("entity_id").agg(
        F.max("mac").alias("mac"), F.count(F.lit(1)).alias("ip_count"), F.min("ip").alias("first_ip"),
        F.max("conflict").alias("ip_conflict"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    has_mac = F.col("mac").isNotNull()
    return grouped.select(
        "entity_id", F.lit(tenant).alias("tenant_id"), F.lit("asset").alias("kind"),
        F.coalesce("mac", "first_ip").alias("name"), "mac", "ip_count", "ip_conflict",
        F.lit(OBSERVED).alias("source"), F.when(has_mac, "mac").otherwise("ip_only").alias("identity_basis"),
        F.when(has_mac, F.lit(CONFIDENCE_MAC)).otherwise(F.lit(CONFIDENCE_IP)).alias("confidence"),
        "first_seen", "last_seen",
    )


def observed_policies(flows: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """One policy per (provider, rule) that flows name."""
    named = flows.filter(F.col("rule_name") != "")
    grouped = named.groupBy("provider", "rule_name").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    return grouped.select(
        entity_id(F.lit(tenant), F.lit("policy"), F.concat_ws(":", "provider", "rule_name")).alias("entity_id"),
        F.lit(tenant).alias("tenant_id"), F.lit("policy").alias("kind"), F.col("rule_name").alias("name"), "provider",
        F.lit(OBSERVED).alias("source"), F.lit("").alias("identity_basis"), F.lit(1.0).alias("confidence"),
        "first_seen", "last_seen",
    )


def flows_with_assets(flows: DataFrame, addresses: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """Flow rows with the asset ids of both ends and their communication edge id."""
    ids = addresses.select("segment", "ip", "entity_id")
    src = ids.select("segment", F.col("ip").alias("src_ip"), F.col("entity_id").alias("src_id"))
    dst = ids.select("segment", F.col("ip").alias("dst_ip"), F.col("entity_id").alias("dst_id"))
    rows = flows.withColumn("segment", segment("observer_hostname"))
    joined = lookup_join(lookup_join(rows, src, ["segment", "src_ip"]), dst, ["segment", "dst_ip"])
    return joined.withColumn("edge_id", entity_edge_id(
        F.lit(tenant), F.col("src_id"), F.col("dst_id"), F.lit("communicated_with"), F.lit(OBSERVED)
    ))


def tagged_values(name: str) -> Column:
    """The values of an array column as ``(what, value)`` structs."""
    return F.transform(F.col(name), lambda v: F.struct(F.lit(name).alias("what"), v.cast("string").alias("value")))


def merge_communication(rows: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """Sum and union communication rows that share both ends.

    The set columns are reduced as (end, end, value) rows, so no group ever
    holds a list of lists.
    """
    keys = ["src_id", "dst_id"]
    totals = rows.groupBy(*keys).agg(
        F.sum("sessions").alias("sessions"), F.sum("bytes").alias("bytes"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    tagged = F.concat(*[tagged_values(c) for c in COMM_SETS])
    values = rows.select(*keys, F.explode(tagged).alias("_v")).select(*keys, "_v.*").filter(text("value") != "")
    sets = values.groupBy(*keys).agg(*[
        F.array_sort(F.collect_set(F.when(F.col("what") == c, F.col("value").cast("int") if c == "ports" else F.col("value")))).alias(c)
        for c in COMM_SETS
    ])
    empty = {c: F.array().cast("array<int>" if c == "ports" else "array<string>") for c in COMM_SETS}
    joined = totals.join(sets, keys, "left")
    return joined.select(
        entity_edge_id(F.lit(tenant), F.col("src_id"), F.col("dst_id"), F.lit("communicated_with"), F.lit(OBSERVED)).alias("edge_id"),
        F.lit(tenant).alias("tenant_id"), "src_id", "dst_id", F.lit("communicated_with").alias("edge_type"),
        F.lit(OBSERVED).alias("source"), F.lit(1.0).alias("confidence"), "sessions", "bytes",
        *[F.coalesce(F.col(c), empty[c]).alias(c) for c in COMM_SETS], "first_seen", "last_seen",
    )


def communication_edges(resolved: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """communicated_with edges from :func:`flows_with_assets` rows."""
    rows = resolved.select(
        "src_id", "dst_id", F.col("flows").alias("sessions"), "bytes", "ports",
        F.array("provider").alias("providers"), F.array("transport").alias("transports"),
        F.array("observer_hostname").alias("observer_hosts"), "first_seen", "last_seen",
    )
    return merge_communication(rows, tenant)


def governed_edges(resolved: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """governed_by edges from a communication edge to the observed policy."""
    t = F.lit(tenant)
    rows = resolved.filter(F.col("rule_name") != "").groupBy("edge_id", "provider", "rule_name").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    policy = entity_id(t, F.lit("policy"), F.concat_ws(":", "provider", "rule_name"))
    rows = rows.withColumn("src_id", F.col("edge_id")).withColumn("dst_id", policy)
    return rows.select(
        entity_edge_id(t, F.col("src_id"), F.col("dst_id"), F.lit("governed_by"), F.lit(OBSERVED)).alias("edge_id"),
        t.alias("tenant_id"), "src_id", "dst_id", F.lit("governed_by").alias("edge_type"), F.lit(OBSERVED).alias("source"),
        F.lit(1.0).alias("confidence"), F.col("rule_name").alias("rule"), "provider", "first_seen", "last_seen",
    )


# ---------------------------------------------------------------- map renderings

def assets_as_entities(asset_rows: DataFrame, addresses: DataFrame) -> DataFrame:
    """Assets with one identifier each: the MAC, or else the address.

    A device's addresses stay in the long table ``addresses`` and in the alias index;
    a gateway may have very many.
    """
    conflicts = addresses.filter(F.col("conflict") & F.col("mac").isNotNull()).groupBy("entity_id").agg(F.max("ip").alias("_conflict"))
    empty = F.create_map().cast("map<string,string>")
    identity = F.when(F.col("mac").isNotNull(), F.create_map(F.lit("mac"), F.col("mac"))).otherwise(F.create_map(F.lit("ip"), F.col("name")))
    conflict = F.when(F.col("_conflict").isNotNull(), F.create_map(F.lit("ip_conflict"), F.col("_conflict"))).otherwise(empty)
    return asset_rows.join(conflicts, "entity_id", "left").withColumn("identifiers", identity).withColumn("attrs", conflict).select(*ENTITY_COLUMNS)


def observed_as_entities(policies: DataFrame) -> DataFrame:
    return policies.withColumn(
        "identifiers", F.create_map(F.lit("rule"), F.col("name"), F.lit("provider"), F.col("provider"))
    ).withColumn("attrs", F.create_map(F.lit("provider"), F.col("provider"))).select(*ENTITY_COLUMNS)


def communication_attrs(edges: DataFrame) -> DataFrame:
    """Adds ``attrs``: counts as text and sets as comma-joined text."""
    pairs = [F.lit("sessions"), F.col("sessions").cast("string"), F.lit("bytes"), F.col("bytes").cast("string")]
    for c in COMM_SETS:
        pairs += [F.lit(c), csv_set(F.col(c))]
    return edges.withColumn("attrs", F.create_map(*pairs))


# ---------------------------------------------------------------- twins

def asset_twins(addresses: DataFrame, asset_rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """``(twin_id, target_id)``: address-only assets whose address has one MAC, which has an asset."""
    unique = bindings.groupBy("ip").agg(F.min("mac").alias("mac"), F.max("mac").alias("_other")).filter(
        F.col("mac") == F.col("_other")
    ).select("ip", "mac")
    targets = asset_rows.filter(F.col("identity_basis") == "mac").select("mac", F.col("entity_id").alias("target_id"))
    ip_only = asset_rows.filter(F.col("identity_basis") == "ip_only").select("entity_id")
    owned = addresses.select("entity_id", "ip").distinct().join(ip_only, "entity_id", "left_semi")
    linked = lookup_join(owned, unique, "ip").join(targets, "mac")
    return linked.groupBy(F.col("entity_id").alias("twin_id")).agg(F.min_by("target_id", "ip").alias("target_id"))


def reconcile_twins(
    twins: DataFrame, comm_edges: DataFrame, gov_edges: DataFrame, tenant: str = DEFAULT_TENANT,
) -> dict[str, DataFrame]:
    """Move the edges of twins onto the MAC asset.

    Returns ``merged_edges`` (to upsert), ``delete_edges(edge_id)`` and
    ``delete_entities(entity_id)``.  governed_by edges of a moved edge are
    deleted; the next resolver pass derives them again.
    """
    src = twins.select(F.col("twin_id").alias("src_id"), F.col("target_id").alias("_s"))
    dst = twins.select(F.col("twin_id").alias("dst_id"), F.col("target_id").alias("_d"))
    marked = lookup_join(lookup_join(comm_edges, src, "src_id", "left"), dst, "dst_id", "left")
    affected = marked.filter(F.col("_s").isNotNull() | F.col("_d").isNotNull())
    moved = affected.select(
        F.coalesce("_s", "src_id").alias("src_id"), F.coalesce("_d", "dst_id").alias("dst_id"),
        "sessions", "bytes", *COMM_SETS, "first_seen", "last_seen",
    )
    standing = comm_edges.join(moved.select("src_id", "dst_id").distinct(), ["src_id", "dst_id"], "left_semi").select(*moved.columns)
    gone = affected.select("edge_id")
    governed = lookup_join(gov_edges.select("edge_id", "src_id"), gone.select(F.col("edge_id").alias("src_id")), "src_id", "left_semi")
    return {
        "merged_edges": merge_communication(moved.unionByName(standing), tenant),
        "delete_edges": gone.unionByName(governed.select("edge_id")).distinct(),
        "delete_entities": twins.select(F.col("twin_id").alias("entity_id")),
    }


# ---------------------------------------------------------------- lookups

class AliasIndex(NamedTuple):
    """``(alias, kind, entity_id)`` stored twice: in buckets of the alias, for lookups, and of the entity, for its addresses."""

    by_alias: DataFrame
    by_entity: DataFrame


def aliases(entities: DataFrame, addresses: DataFrame) -> DataFrame:
    """``(alias, kind, entity_id)``: an entity's id, its identifiers, and every address of an asset."""
    entry = F.transform(F.map_entries("identifiers"), lambda e: F.struct(e["value"].alias("alias"), e["key"].alias("kind")))
    named = F.concat(F.array(F.struct(F.col("entity_id").alias("alias"), F.lit("id").alias("kind"))), entry)
    own = entities.select("entity_id", F.explode(named).alias("_a")).select("_a.alias", "_a.kind", "entity_id")
    held = addresses.select(F.col("ip").alias("alias"), F.lit("ip").alias("kind"), "entity_id")
    return own.unionByName(held).filter(text("alias") != "").distinct()


def store_alias_index(rows: DataFrame, buckets: int | None = None) -> AliasIndex:
    """Write :func:`aliases` as two bucketed tables, so that a join on their key reads them where they lie.

    Only the other side of such a join is shuffled, to the buckets.  ``buckets`` is
    by default the number of shuffle partitions.
    """
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(key: str) -> DataFrame:
        name = f"alias_index_{uuid.uuid4().hex}"
        # Dealt out by the key first, each bucket is one file.
        rows.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", shared_path(spark, "aliases")).saveAsTable(name)
        return spark.table(name)

    return AliasIndex(stored("alias"), stored("entity_id"))


def find_entities(entities: DataFrame, index: AliasIndex, ids: DataFrame, *, best_only: bool = False) -> DataFrame:
    """Every entity matching each ``lookup`` by id, identifier or address.

    With ``best_only`` just the head of the ranking by confidence, then recency.
    """
    wanted = ids.select("lookup").distinct().withColumn("alias", lookup_form("lookup"))
    matched = lookup_join(index.by_alias.select("alias", "entity_id"), wanted, "alias").select("lookup", "entity_id").distinct()
    hits = lookup_join(matched, entities.select("entity_id", "confidence", "last_seen"), "entity_id")
    if best_only:
        hits = top_rows(hits, ["lookup"], [F.col("confidence").desc(), F.col("last_seen").desc(), F.col("entity_id")])
    rest = [c for c in ENTITY_COLUMNS if c not in ("entity_id", "confidence", "last_seen")]
    return lookup_join(hits, entities.select("entity_id", *rest), "entity_id").select("lookup", *ENTITY_COLUMNS)


def entity_addresses(index: AliasIndex, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted``, which has an ``entity_id``, with one row per ``ip`` of the entity."""
    held = index.by_entity.filter("kind = 'ip'").select("entity_id", F.col("alias").alias("ip"))
    return lookup_join(held, wanted, "entity_id").select(*wanted.columns, "ip")


def communication_between(
    edges: DataFrame, left: DataFrame, right: DataFrame, as_of: TimeArg, *, since: TimeArg = "now-24h",
    keys: Sequence[str] = ("pair_id",),
) -> DataFrame:
    """Communication edges between two candidate sets per request, in either direction.

    ``left`` and ``right`` hold (request keys, entity_id).  ``client_id`` and
    ``server_id`` orient each edge; an edge that fits both ways counts forward.
    """
    k = list(keys)
    recent = edges.filter(F.col("edge_type") == "communicated_with").filter(window_filter("last_seen", since, None, as_of))
    a, b = left.select(*k, "entity_id").distinct(), right.select(*k, "entity_id").distinct()

    def oriented(first: DataFrame, second: DataFrame) -> DataFrame:
        starts = lookup_join(recent, first.withColumnRenamed("entity_id", "src_id"), "src_id")
        return lookup_join(starts, second.withColumnRenamed("entity_id", "dst_id"), [*k, "dst_id"], "left_semi")

    forward = oriented(a, b).withColumn("client_id", F.col("src_id")).withColumn("server_id", F.col("dst_id"))
    reverse = oriented(b, a).withColumn("client_id", F.col("dst_id")).withColumn("server_id", F.col("src_id"))
    only_back = reverse.join(forward.select(*k, "edge_id"), [*k, "edge_id"], "left_anti")
    return forward.unionByName(only_back)


def select_pair(between: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """The (client, server) to explain per request.

    Firewall provenance first, then sessions, then recency, then the ids.
    """
    k = list(keys)
    pairs = between.groupBy(*k, "client_id", "server_id").agg(
        F.max(F.size("observer_hosts") > 0).alias("has_provenance"), F.sum("sessions").alias("sessions"),
        F.sum("bytes").alias("bytes"), F.max("last_seen").alias("last_seen"),
    )
    order = [F.col(c).desc() for c in ("has_provenance", "sessions", "last_seen", "client_id", "server_id")]
    return top_rows(pairs, k, order)


def governed_policies(gov_edges: DataFrame, entities: DataFrame, edge_ids: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Policies behind communication edges; ``edge_ids`` may carry request keys."""
    wanted = edge_ids.select(*keys, F.col("edge_id").alias("src_id")).distinct()
    gov = gov_edges.filter(F.col("edge_type") == "governed_by").select("src_id", "dst_id")
    hits = lookup_join(gov, wanted, "src_id")
    policies = entities.select(
        F.col("entity_id").alias("dst_id"), "name", F.coalesce(F.col("identifiers")["provider"], F.lit("")).alias("vendor"), "source"
    )
    return lookup_join(hits, policies, "dst_id").select(
        *keys, F.col("src_id").alias("edge_id"), F.col("dst_id").alias("policy_id"),
        F.col("name").alias("rule"), "vendor", "source",
    )


def configured_policies(entities: DataFrame, edges: DataFrame, firewalls: DataFrame) -> DataFrame:
    """Configured rules of each named firewall, one row per rule; ``firewalls(firewall)``.

    ``clauses`` has all else that the rule matches on: addresses, applications, services,
    negations, schedules and so on, by name; a rule without one of them matches any.
    """
    walls = entities.filter(F.col("kind") == "firewall").select(
        F.col("entity_id").alias("src_id"), F.col("identifiers")["device_name"].alias("firewall")
    ).join(firewalls.select("firewall").distinct(), "firewall", "left_semi")
    governed = edges.filter((F.col("edge_type") == "governed_by") & (F.col("source") == CONFIGURED)).select("src_id", "dst_id")
    owned = lookup_join(governed, walls, "src_id").select("firewall", F.col("dst_id").alias("entity_id")).distinct()
    attrs = F.col("attrs")
    detail = entities.filter(F.col("kind") == "policy").select(
        "entity_id", F.col("name").alias("rule"), *[text(attrs[c]).alias(c) for c in ("action", "from_zone", "to_zone", "position")],
        (text(attrs["enabled"]) == "true").alias("enabled"), F.col("source"),
        F.map_filter(attrs, lambda k, v: ~k.isin(*NO_CLAUSE) & (v != "")).alias("clauses"),
    )
    return owned.join(detail, "entity_id").select(
        "firewall", F.col("entity_id").alias("policy_id"), "rule", "action", "from_zone", "to_zone", "position", "enabled",
        "source", "clauses",
    )


def configured_policy_counts(policies: DataFrame) -> DataFrame:
    return policies.groupBy("firewall").agg(F.count(F.lit(1)).alias("count"))
