"""Topology graph: built from observations and flows, then queried."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.functions.ids import DEFAULT_TENANT, graph_edge_id, node_id, text
from netfabric.functions.net import MAC_PATTERN, MAC_PREFIX_PATTERN, is_mac, lookup_form
from netfabric.functions.skew import block_join, block_sizes, lookup_join, top_rows
from netfabric.functions.timeargs import window_filter
from netfabric.operators.graph import (
    both_directions, connected_components, shortest_paths, twin_classes, within_depth,
)
from netfabric.operators.upsert import collapse_superseded, latest_by_key
from netfabric.session import cut_lineage

TimeArg = str | datetime

# Node kinds, edge types, layers and the layer sets of path queries.
NODE_KINDS = ("device", "interface", "host", "identity", "segment", "zone", "rule")
EDGE_TYPES = (
    "physical_link", "attaches_to", "has_address", "member_of", "routes_to", "tunnel", "hosts",
    "talked_to", "governed_by", "in_zone", "authenticated_as",
)
LAYER_SETS = {
    "physical": ("l1", "l2"),
    "flow": ("flow", "l3"),
    "any": ("l1", "l2", "l3", "virt", "flow"),
}
BASE_CONFIDENCE = 0.7
DEFAULT_WINDOW = "now-24h"
FLOW_EVIDENCE = "events"

NODE_COLUMNS = ("node_id", "tenant_id", "kind", "name", "identifiers", "first_seen", "last_seen", "attrs")
EDGE_COLUMNS = (
    "edge_id", "tenant_id", "src_id", "dst_id", "edge_type", "layer", "first_seen", "last_seen",
    "confidence", "attrs",
)


def _map(*pairs: tuple[str, Column]) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), text(v))])


# ---------------------------------------------------------------- flows

def flow_pairs(
    events: DataFrame, as_of: TimeArg, *, since: TimeArg = DEFAULT_WINDOW, tenant: str = DEFAULT_TENANT,
) -> DataFrame:
    """Totals per address pair; rule, zones and provider come from its newest event."""
    df = events.filter(F.col("tenant_id") == tenant).filter(window_filter("timestamp", since, None, as_of))
    df = df.filter(F.col("source_ip").isNotNull() & F.col("destination_ip").isNotNull())
    newest = F.max_by(
        F.struct("rule_name", "observer_ingress_zone", "observer_egress_zone", "event_provider"),
        F.struct("timestamp", "event_id"),
    )
    grouped = df.groupBy(F.col("source_ip").alias("src_ip"), F.col("destination_ip").alias("dst_ip")).agg(
        F.sum("network_bytes").alias("bytes"), F.count(F.lit(1)).alias("flows"), newest.alias("_n"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    return grouped.select(
        "src_ip", "dst_ip", "bytes", "flows", text(F.col("_n.rule_name")).alias("rule_name"),
        text(F.col("_n.observer_ingress_zone")).alias("ingress_zone"),
        text(F.col("_n.observer_egress_zone")).alias("egress_zone"),
        text(F.col("_n.event_provider")).alias("provider"), "first_seen", "last_seen",
    )


def _host_by_ip(tenant: Column, ip: Column) -> Column:
    return node_id(tenant, F.lit("host"), F.concat(F.lit("ip:"), ip))


def flow_edges(pairs: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """talked_to, governed_by (from the talked_to edge to its rule) and in_zone edges.

    ``src_kind``, ``dst_kind`` and the names say what each end is, for the
    placeholder nodes.
    """
    t, flow = F.lit(tenant), F.lit("flow")
    base = pairs.select(
        "*", _host_by_ip(t, F.col("src_ip")).alias("_src"), _host_by_ip(t, F.col("dst_ip")).alias("_dst")
    ).withColumn("_talk", graph_edge_id(t, F.col("_src"), F.col("_dst"), F.lit("talked_to"), flow))

    def edge(df: DataFrame, src: Column, dst: Column, kind: str, attrs: Column, ends: tuple[str, str], names: tuple[Column, Column]) -> DataFrame:
        return df.select(
            graph_edge_id(t, src, dst, F.lit(kind), flow).alias("edge_id"), t.alias("tenant_id"),
            src.alias("src_id"), dst.alias("dst_id"), F.lit(kind).alias("edge_type"), flow.alias("layer"),
            "first_seen", "last_seen", F.lit(1.0).alias("confidence"), attrs.alias("attrs"),
            F.lit(ends[0]).alias("src_kind"), F.lit(ends[1]).alias("dst_kind"),
            names[0].alias("src_name"), names[1].alias("dst_name"),
        )

    blank = F.lit("")
    evidence = ("evidence", F.lit(FLOW_EVIDENCE))
    talked = edge(
        base, F.col("_src"), F.col("_dst"), "talked_to",
        _map(("bytes", F.coalesce("bytes", F.lit(0))), ("flows", F.col("flows")), ("provider", F.col("provider")), evidence),
        ("host", "host"), (blank, blank),
    )
    ruled = base.filter(F.col("rule_name") != "")
    rule_key = F.concat_ws(":", "provider", "rule_name")
    governed = edge(
        ruled, F.col("_talk"), node_id(t, F.lit("rule"), rule_key), "governed_by",
        _map(("rule_name", F.col("rule_name")), evidence), ("edge", "rule"), (blank, F.col("rule_name")),
    )
    zoned = base.select(
        "provider", "first_seen", "last_seen",
        F.explode(F.array(
            F.struct(F.col("_src").alias("host"), F.col("ingress_zone").alias("zone")),
            F.struct(F.col("_dst").alias("host"), F.col("egress_zone").alias("zone")),
        )).alias("_z"),
    ).select("provider", "first_seen", "last_seen", "_z.host", "_z.zone").filter(F.col("zone") != "")
    # One host and zone meet in many pairs; the window covers them all.
    zoned = zoned.groupBy("provider", "host", "zone").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    zone_key = F.concat_ws(":", "provider", "zone")
    in_zone = edge(
        zoned, F.col("host"), node_id(t, F.lit("zone"), zone_key), "in_zone",
        _map(("zone", F.col("zone")), evidence), ("host", "zone"), (blank, F.col("zone")),
    )
    return talked.unionByName(governed).unionByName(in_zone)


# ---------------------------------------------------------------- observations

def _after(prefix: str, value: Column) -> Column:
    """The part after the first ``prefix``, or the whole value."""
    return F.when(value.contains(prefix), F.substring(value, F.locate(prefix, value) + len(prefix), F.length(value))).otherwise(value)


def _node(kind: str, key: Column, name: Column, idents: Column, attrs: Column, soft: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), text(name).alias("name"), idents.alias("idents"),
        (soft if soft is not None else _map()).alias("soft_idents"), attrs.alias("attrs"),
    )


def _parts(observations: DataFrame, tenant: str) -> DataFrame:
    """Observations with the values that several edge and node rules share."""
    attrs, subj, obj = F.col("attrs"), F.col("subj_id"), text("obj_id")
    remote = F.coalesce(
        F.nullif(text(attrs["remote_system"]), F.lit("")),
        F.split_part(_after("if:", obj), F.lit(":"), F.lit(1)),
    )
    return observations.filter(F.col("tenant_id") == tenant).select(
        "observation_type", "observed_at", "collector", "source_device", "attrs", subj.alias("subj_id"), obj.alias("obj_id"),
        _after("mac:", F.when(F.col("observation_type") == "arp_entry", obj).otherwise(subj)).alias("mac"),
        _after("ip:", subj).alias("ip"),
        F.when(obj != "", _after(":", obj)).otherwise(F.col("source_device")).alias("uplink"),
        remote.alias("remote"),
    )


def _map_or_empty(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(_map())


def nodes_from_observations(observations: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """Graph nodes from observations; for each identifier or attribute the newest value wins."""
    p = _parts(observations, tenant)
    attrs, kind = F.col("attrs"), F.col("observation_type")
    mac, uplink, device = F.col("mac"), F.col("uplink"), F.col("source_device")

    def named_device(name: Column, extra: Column | None = None, more: Column | None = None, soft: Column | None = None) -> Column:
        idents = _map(("name", name)) if extra is None else F.map_concat(_map(("name", name)), extra)
        return _node("device", name, name, idents, more if more is not None else _map(), soft)

    def host(idents: Column, more: Column | None = None) -> Column:
        return _node("host", F.concat(F.lit("mac:"), mac), mac, idents, more if more is not None else _map())

    virtual = _map(("virtual", F.lit("true")))
    inv_mac = F.lower(text(attrs["mac"]))
    inv_name = F.coalesce(F.nullif(text(attrs["name"]), F.lit("")), F.concat(F.lit("dev:"), inv_mac))
    inv_idents = F.map_concat(
        _map_or_empty(inv_mac != "", _map(("mac", inv_mac))),
        _map_or_empty(text(attrs["ip"]) != "", _map(("mgmt_ip", attrs["ip"]))),
    )
    chassis = text(attrs["remote_chassis"])
    remote = F.col("remote")
    contributions = (
        F.when(kind == "arp_entry", F.array(host(_map(("mac", mac), ("ip", F.col("ip"))))))
        .when(
            kind.isin("mac_entry", "wlan_assoc"),
            F.array(
                host(_map(("mac", mac))),
                named_device(uplink, soft=_map_or_empty(uplink.rlike(MAC_PATTERN), _map(("mac", F.lower(uplink))))),
            ),
        )
        .when(kind == "vm_nic", F.array(host(_map(("mac", mac)), virtual), named_device(device)))
        .when(
            kind == "vm_host",
            F.array(
                named_device(device, more=_map(("role", F.lit("hypervisor")))),
                _node("host", F.col("obj_id"), F.coalesce(attrs["name"], F.col("obj_id")), _map(("vmid", attrs["vmid"])), virtual),
            ),
        )
        .when(
            kind == "lldp_neighbor",
            F.array(
                named_device(device),
                named_device(remote, extra=_map_or_empty(chassis.rlike(MAC_PREFIX_PATTERN), _map(("mac", F.lower(chassis))))),
                _node("interface", F.col("subj_id"), attrs["local_port"], _map(), _map(("device", device))),
                _node("interface", F.col("obj_id"), attrs["remote_port"], _map(), _map(("device", remote))),
            ),
        )
        .when(
            kind == "device_inventory",
            F.array(named_device(inv_name, extra=inv_idents, more=_map(("role", F.coalesce(attrs["role"], F.lit("device")))))),
        )
    )
    t = F.lit(tenant)
    rows = p.select("observed_at", F.explode(contributions).alias("_c")).select(
        node_id(t, F.col("_c.kind"), F.col("_c.key")).alias("node_id"), "observed_at",
        F.col("_c.kind").alias("kind"), F.col("_c.name").alias("name"), F.col("_c.idents").alias("idents"),
        F.col("_c.soft_idents").alias("soft_idents"), F.col("_c.attrs").alias("attrs"),
    )
    heads = rows.groupBy("node_id").agg(
        F.min("kind").alias("kind"),
        F.min_by("name", F.struct((F.col("name") == "").alias("a"), F.col("observed_at").alias("b"), F.col("name").alias("c"))).alias("name"),
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"),
    )
    entries = rows.select("node_id", "observed_at", F.explode(F.concat(
        _entries("idents", "i", 1), _entries("soft_idents", "i", 0), _entries("attrs", "a", 1),
    )).alias("_e")).select("node_id", "observed_at", "_e.*")
    maps = merge_maps(entries, "node_id", {"identifiers": "i", "attrs": "a"})
    return heads.join(maps, "node_id", "left").select(
        "node_id", t.alias("tenant_id"), "kind", "name",
        F.coalesce("identifiers", _map()).alias("identifiers"), "first_seen", "last_seen",
        F.coalesce("attrs", _map()).alias("attrs"),
    )


def _entries(name: str, scope: str, priority: int) -> Column:
    return F.transform(F.map_entries(name), lambda e: F.struct(
        F.lit(scope).alias("scope"), F.lit(priority).alias("priority"), e["key"].alias("key"), e["value"].alias("value")
    ))


def merge_maps(entries: DataFrame, key: str, scopes: dict[str, str], newest_first: bool = True) -> DataFrame:
    """One map per id and scope from ``(id, observed_at, scope, priority, key, value)`` rows.

    Higher priority wins, then the newest value.  Values are reduced per map key
    before the map is built, so a map never holds more than its distinct keys.
    """
    order = F.struct("priority", "observed_at", "value")
    pick = F.max_by if newest_first else F.min_by
    best = entries.groupBy(key, "scope", F.col("key").alias("_k")).agg(pick("value", order).alias("_v"))
    return best.groupBy(key).agg(*[
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("scope") == tag, F.struct("_k", "_v"))))).alias(name)
        for name, tag in scopes.items()
    ])


def edges_from_observations(observations: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """Graph edges from observations, with ``evidence_set`` for the confidence rule."""
    p = _parts(observations, tenant)
    t = F.lit(tenant)
    attrs, kind, mac = F.col("attrs"), F.col("observation_type"), F.col("mac")
    collector, device = F.col("collector"), F.col("source_device")
    mac_host = node_id(t, F.lit("host"), F.concat(F.lit("mac:"), mac))

    def edge(src: Column, dst: Column, etype: str, layer: str, values: Column, evidence: Column) -> Column:
        return F.struct(
            src.alias("src_id"), dst.alias("dst_id"), F.lit(etype).alias("edge_type"), F.lit(layer).alias("layer"),
            values.alias("attrs"), evidence.alias("evidence"),
        )

    hyper = F.lit("proxmox")
    found = (
        F.when(kind == "arp_entry", edge(
            mac_host, node_id(t, F.lit("host"), F.concat(F.lit("ip:"), F.col("ip"))), "has_address", "l3",
            _map(("ip", F.col("ip"))), collector,
        ))
        .when(kind.isin("mac_entry", "wlan_assoc"), edge(
            mac_host, node_id(t, F.lit("device"), F.col("uplink")), "attaches_to", "l2",
            _map(("port", attrs["port"]), ("vlan", attrs["vlan"])), collector,
        ))
        .when(kind == "vm_nic", edge(
            mac_host, node_id(t, F.lit("device"), device), "attaches_to", "l2",
            _map(("bridge", attrs["bridge"]), ("vlan", attrs["vlan"])), hyper,
        ))
        .when(kind == "vm_host", edge(
            node_id(t, F.lit("device"), device), node_id(t, F.lit("host"), F.col("obj_id")), "hosts", "virt",
            _map(("vmid", attrs["vmid"])), hyper,
        ))
        .when(kind == "lldp_neighbor", edge(
            node_id(t, F.lit("interface"), F.col("subj_id")), node_id(t, F.lit("interface"), F.col("obj_id")),
            "physical_link", "l2",
            _map(("local_port", attrs["local_port"]), ("remote_port", attrs["remote_port"]),
                 ("device_a", device), ("device_b", F.col("remote"))),
            F.concat_ws(":", collector, device),
        ))
    )
    rows = p.select("observed_at", found.alias("_e")).filter(F.col("_e").isNotNull()).select("observed_at", "_e.*")
    return merge_edges(rows, tenant)


def merge_edges(rows: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """Edges keyed by (src, dst, type, layer): widest window, newest attributes, evidence set.

    ``rows`` carry either ``observed_at`` and one ``evidence``, or a merged
    edge's ``first_seen``, ``last_seen`` and ``evidence_set``.
    """
    if "observed_at" in rows.columns:
        rows = rows.select(
            "src_id", "dst_id", "edge_type", "layer", F.col("observed_at").alias("first_seen"),
            F.col("observed_at").alias("last_seen"), "attrs", F.array("evidence").alias("evidence_set"),
        )
    t = F.lit(tenant)
    keyed = rows.withColumn(
        "edge_id", graph_edge_id(t, F.col("src_id"), F.col("dst_id"), F.col("edge_type"), F.col("layer"))
    )
    heads = keyed.groupBy("edge_id").agg(
        *[F.first(c).alias(c) for c in ("src_id", "dst_id", "edge_type", "layer")],
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    entries = keyed.select("edge_id", F.col("last_seen").alias("observed_at"), F.explode(F.concat(
        _entries("attrs", "a", 1),
        F.transform("evidence_set", lambda e: F.struct(
            F.lit("e").alias("scope"), F.lit(1).alias("priority"), e.alias("key"), F.lit("").alias("value"))),
    )).alias("_e")).select("edge_id", "observed_at", "_e.*")
    maps = merge_maps(entries, "edge_id", {"attrs": "a", "_ev": "e"})
    return heads.join(maps, "edge_id", "left").select(
        "edge_id", t.alias("tenant_id"), "src_id", "dst_id", "edge_type", "layer", "first_seen", "last_seen",
        F.coalesce("attrs", _map()).alias("attrs"), F.array_sort(F.map_keys(F.coalesce("_ev", _map()))).alias("evidence_set"),
    )


def edge_confidence(edges: DataFrame) -> DataFrame:
    """0.7, or 1.0 with two evidence sources; the sorted evidence list goes to the attributes."""
    confidence = F.when(F.size("evidence_set") >= 2, F.lit(1.0)).otherwise(F.lit(BASE_CONFIDENCE))
    evidence = _map(("evidence", F.array_join("evidence_set", ",")))
    return edges.select(
        *[c for c in EDGE_COLUMNS if c not in ("confidence", "attrs")],
        confidence.alias("confidence"), F.map_concat("attrs", evidence).alias("attrs"),
    )


# ---------------------------------------------------------------- device fusion

def device_tokens(nodes: DataFrame) -> DataFrame:
    """``(node_id, token)``: the MAC, name and management IP that identify a device."""
    ids = F.col("identifiers")

    def token(tag: str, value: Column) -> Column:
        return F.when(text(value) != "", F.concat(F.lit(f"{tag}:"), value))

    tokens = F.array(token("mac", F.lower(ids["mac"])), token("name", ids["name"]), token("mgmt_ip", ids["mgmt_ip"]))
    return nodes.filter(F.col("kind") == "device").select("node_id", F.explode(tokens).alias("token")).filter(F.col("token").isNotNull())


def device_canonical_ids(nodes: DataFrame) -> DataFrame:
    """``(node_id, canonical_id)`` for device nodes that fuse with another one.

    A token shared by many nodes links each to the token's smallest node (a
    star, not all pairs); only shared tokens enter the component search.
    """
    tokens = device_tokens(nodes)
    hubs = tokens.groupBy("token").agg(F.min("node_id").alias("hub"), F.max("node_id").alias("_far")).filter(
        F.col("hub") != F.col("_far")
    ).select("token", "hub")
    links = lookup_join(tokens, hubs, "token").select(F.col("node_id").alias("src_id"), F.col("hub").alias("dst_id"))
    parts = connected_components(links)
    return parts.select(F.col("id").alias("node_id"), F.col("component").alias("canonical_id"))


def merge_devices(nodes: DataFrame, canonical: DataFrame) -> DataFrame:
    """Fuse device nodes onto their canonical id.

    A human name beats a MAC name; identifiers and attributes keep the
    canonical node's value first, then the smallest node id's.
    """
    mapped = lookup_join(nodes, canonical, "node_id", "left")
    lone = mapped.filter(F.col("canonical_id").isNull()).select(*NODE_COLUMNS)
    fused = mapped.filter(F.col("canonical_id").isNotNull())
    name_rank = F.struct(
        (F.col("name") == "").alias("a"), is_mac("name").alias("b"), F.col("node_id").alias("c")
    )
    heads = fused.groupBy("canonical_id").agg(
        F.first("tenant_id").alias("tenant_id"), F.min("kind").alias("kind"), F.min_by("name", name_rank).alias("name"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    entries = fused.select("canonical_id", F.col("node_id").alias("observed_at"), F.explode(F.concat(
        _entries("identifiers", "i", 1), _entries("attrs", "a", 1),
    )).alias("_e")).select("canonical_id", "observed_at", "_e.*")
    maps = merge_maps(entries, "canonical_id", {"identifiers": "i", "attrs": "a"}, newest_first=False)
    merged = heads.join(maps, "canonical_id", "left").select(
        F.col("canonical_id").alias("node_id"), "tenant_id", "kind", "name",
        F.coalesce("identifiers", _map()).alias("identifiers"), "first_seen", "last_seen",
        F.coalesce("attrs", _map()).alias("attrs"),
    )
    return lone.unionByName(merged)


def remap_edges(edges: DataFrame, canonical: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """Move both ends onto canonical ids, drop self-loops, re-key and merge."""
    src = canonical.select(F.col("node_id").alias("src_id"), F.col("canonical_id").alias("_s"))
    dst = canonical.select(F.col("node_id").alias("dst_id"), F.col("canonical_id").alias("_d"))
    moved = lookup_join(lookup_join(edges, src, "src_id", "left"), dst, "dst_id", "left")
    moved = moved.withColumn("src_id", F.coalesce("_s", "src_id")).withColumn("dst_id", F.coalesce("_d", "dst_id"))
    kept = moved.filter(F.col("src_id") != F.col("dst_id")).select(
        "src_id", "dst_id", "edge_type", "layer", "first_seen", "last_seen", "attrs", "evidence_set"
    )
    return merge_edges(kept, tenant)


def placeholder_nodes(edges: DataFrame, nodes: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """Nodes for flow endpoints nobody observed, flagged ``l3_only``.

    Zones and rules get their own kind; the edge id a governed_by edge starts
    from is no node.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src_id").alias("id"), F.col("src_kind").alias("kind"), F.col("src_name").alias("name")),
        F.struct(F.col("dst_id").alias("id"), F.col("dst_kind").alias("kind"), F.col("dst_name").alias("name")),
    )).alias("_p"), "first_seen", "last_seen").select("_p.*", "first_seen", "last_seen").filter(F.col("kind") != "edge")
    unique = ends.groupBy("id").agg(
        F.min("kind").alias("kind"), F.max("name").alias("name"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    missing = unique.join(nodes.select(F.col("node_id").alias("id")), "id", "left_anti")
    return missing.select(
        F.col("id").alias("node_id"), F.lit(tenant).alias("tenant_id"), "kind", "name", _map().alias("identifiers"),
        "first_seen", "last_seen",
        F.when(F.col("kind") == "host", _map(("unresolved", F.lit("l3_only")))).otherwise(_map()).alias("attrs"),
    )


# ---------------------------------------------------------------- queries

def find_node(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Newest node per lookup, by node id or any identifier value; ``ids(lookup)``."""
    aliases = nodes.select(
        "*", F.explode(F.array_distinct(F.concat(F.array("node_id"), F.map_values("identifiers")))).alias("_alias")
    )
    wanted = ids.select("lookup").distinct().withColumn("_alias", lookup_form("lookup"))
    hits = lookup_join(aliases, wanted, "_alias").drop("_alias")
    return latest_by_key(hits, ["lookup"], "last_seen", ["node_id"])


def subgraph(
    nodes: DataFrame, edges: DataFrame, as_of: TimeArg, *, since: TimeArg = DEFAULT_WINDOW, limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Edges seen in the window (optionally the newest ``limit``) and the nodes at their ends."""
    recent = edges.filter(window_filter("last_seen", since, None, as_of))
    if limit is not None:
        recent = recent.orderBy(F.col("last_seen").desc(), "edge_id").limit(int(limit))
    ends = recent.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
    return nodes.join(ends, "node_id", "left_semi"), recent


def nodes_by_attr(nodes: DataFrame, *, role: str | None = None, kind: str | None = None) -> DataFrame:
    """Current inventory by role and kind, isolated nodes included, one row per name."""
    df = nodes
    if role is not None:
        df = df.filter(F.col("attrs")["role"] == role)
    if kind is not None:
        df = df.filter(F.col("kind") == kind)
    return collapse_superseded(df)


def locate(nodes: DataFrame, edges: DataFrame, ids: DataFrame, as_of: TimeArg, *, since: TimeArg = DEFAULT_WINDOW) -> DataFrame:
    """Where each lookup is attached: device, port or bridge, VLAN."""
    found = find_node(nodes, ids).select("lookup", "node_id", "name")
    attach = edges.filter(F.col("edge_type") == "attaches_to").filter(window_filter("last_seen", since, None, as_of))
    newest = latest_by_key(
        attach.select(F.col("src_id").alias("node_id"), "edge_id", "dst_id", "attrs", "last_seen"), ["node_id"], "last_seen", ["edge_id"]
    )
    port, bridge = text(F.col("attrs")["port"]), text(F.col("attrs")["bridge"])
    return found.join(newest, "node_id", "left").select(
        "lookup", F.col("node_id").alias("entity"), "name", F.col("dst_id").alias("attached_to"),
        F.when(F.col("dst_id").isNotNull(), F.when(port != "", port).otherwise(F.col("attrs")["bridge"])).alias("port"),
        F.col("attrs")["vlan"].alias("vlan"),
        F.when(F.col("dst_id").isNotNull(), F.when(bridge != "", "bridge").otherwise("switchport")).alias("via"),
    )


def neighbors(
    nodes: DataFrame, edges: DataFrame, ids: DataFrame, as_of: TimeArg, *, depth: int = 1, layer: str | None = None,
    since: TimeArg = DEFAULT_WINDOW,
) -> tuple[DataFrame, DataFrame]:
    """Ego graphs: ``(lookup, node)`` rows and the edges with both ends inside.

    The radius counts edges of every layer; ``layer`` filters the edges returned.
    """
    # Only what the search for the start needs is shuffled, not whole nodes.
    found = find_node(nodes.select("node_id", "identifiers", "last_seen"), ids)
    roots = cut_lineage(found.select("lookup", F.col("node_id").alias("start")).filter("start IS NOT NULL"))
    recent = edges.filter(window_filter("last_seen", since, None, as_of))
    adjacency = cut_lineage(both_directions(recent))
    # Twins lie in each other's reach from two steps on; nearer, every node is its own class.
    classes = cut_lineage(
        twin_classes(adjacency) if depth >= 2 else adjacency.select(F.col("src").alias("id"), F.col("src").alias("class")).distinct())
    heads = cut_lineage(classes.filter("id = class"))
    between = adjacency
    for end in ("src", "dst"):
        between = lookup_join(between, heads.select(F.col("id").alias(end)), end, "left_semi")
    asked = cut_lineage(_with_class(roots, classes, "start", "class"))
    reach = within_depth(between, asked.select(F.col("class").alias("start")), depth)
    # The classes in reach of each lookup; their members are met only where the rows go out.
    by_class = asked.withColumnRenamed("class", "_root").join(
        reach.select(F.col("start").alias("_root"), F.col("node").alias("class"), "hops"), "_root").drop("_root")

    placed = _with_class(nodes, classes, "node_id", "class")
    # Written, so that the nodes meet their number of blocks without a shuffle where the classes are few.
    sizes = cut_lineage(block_sizes(classes, by_class, "class"))
    hops = F.when(F.col("node_id") == F.col("start"), F.lit(0)).when(F.col("hops") == 0, F.lit(2)).otherwise(F.col("hops"))
    out_nodes = block_join(placed, by_class, "class", sizes).withColumn("hops", hops).select(
        "node_id", "lookup", "hops", *[c for c in nodes.columns if c != "node_id"])

    shown = recent if layer is None else recent.filter(F.col("layer") == layer)
    ends = shown
    for end in ("src", "dst"):
        ends = _with_class(ends, classes, f"{end}_id", f"_{end}")
    held = by_class.select("lookup", "class")
    kinds = lookup_join(ends.select("_src", "_dst").distinct(), held.withColumnRenamed("class", "_src"), "_src")
    inside = lookup_join(kinds, held.withColumnRenamed("class", "_dst"), ["lookup", "_dst"], "left_semi")
    out_edges = block_join(ends, inside, ["_src", "_dst"]).select(
        "lookup", "dst_id", "src_id", *[c for c in shown.columns if c not in ("src_id", "dst_id")])
    return out_nodes, out_edges


def _with_class(df: DataFrame, classes: DataFrame, node: str, name: str) -> DataFrame:
    """``df`` with the class of its ``node`` as ``name``; a node without a link is its own class."""
    found = lookup_join(df, classes.select(F.col("id").alias(node), F.col("class").alias(name)), node, "left")
    return found.withColumn(name, F.coalesce(name, node))


def find_path(
    nodes: DataFrame, edges: DataFrame, pairs: DataFrame, as_of: TimeArg, *, layer: str = "any", since: TimeArg = DEFAULT_WINDOW,
) -> DataFrame:
    """Undirected shortest path per ``(src_lookup, dst_lookup)`` within a layer set."""
    layers = LAYER_SETS.get(layer, LAYER_SETS["any"])
    recent = edges.filter(window_filter("last_seen", since, None, as_of)).filter(F.col("layer").isin(*layers))
    asked = _resolve_pairs(nodes, pairs)
    known = asked.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    paths = shortest_paths(both_directions(recent), known)
    return asked.join(paths, ["src", "dst"], "left").select(
        "src_lookup", "dst_lookup", "src", "dst", F.col("path").isNotNull().alias("found"),
        F.col("path").alias("path_nodes"), (F.size("path") - 1).alias("hops"),
    ).withColumn("hops", F.when(F.col("found"), F.col("hops")))


def _resolve_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    lookups = pairs.select(F.explode(F.array("src_lookup", "dst_lookup")).alias("lookup"))
    found = find_node(nodes, lookups).select("lookup", "node_id")
    src = found.select(F.col("lookup").alias("src_lookup"), F.col("node_id").alias("src"))
    dst = found.select(F.col("lookup").alias("dst_lookup"), F.col("node_id").alias("dst"))
    return pairs.select("src_lookup", "dst_lookup").distinct().join(src, "src_lookup", "left").join(dst, "dst_lookup", "left")


def enforcement_points(
    nodes: DataFrame, edges: DataFrame, pairs: DataFrame, as_of: TimeArg, *, since: TimeArg = DEFAULT_WINDOW,
) -> DataFrame:
    """Rules, zones and firewalls per ``(src_lookup, dst_lookup)`` pair.

    Rules hang off the pair's talked_to edges; firewalls are devices in the
    same l1/l2 component as either end.
    """
    recent = edges.filter(window_filter("last_seen", since, None, as_of))
    asked = _resolve_pairs(nodes, pairs).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    key = ["src_lookup", "dst_lookup"]

    talked = recent.filter(F.col("edge_type") == "talked_to").select("edge_id", "src_id", "dst_id")
    ends = asked.select(*key, F.col("src").alias("src_id"), F.col("dst").alias("dst_id"))
    back = asked.select(*key, F.col("dst").alias("src_id"), F.col("src").alias("dst_id"))
    pair_edges = talked.join(ends.unionByName(back).distinct(), ["src_id", "dst_id"]).select(*key, "edge_id").distinct()
    governed = recent.filter(F.col("edge_type") == "governed_by").select(
        F.col("src_id").alias("edge_id"), F.col("dst_id").alias("node_id"), F.col("attrs")["rule_name"].alias("_rule")
    )
    names = nodes.select("node_id", "name")
    rules = governed.join(pair_edges, "edge_id").join(names, "node_id", "left").select(
        *key, F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("_rule")).alias("value")
    )

    each_end = asked.select(*key, F.explode(F.array("src", "dst")).alias("node")).distinct()
    zoned = recent.filter(F.col("edge_type") == "in_zone").select(F.col("src_id").alias("node"), F.col("attrs")["zone"].alias("value"))
    zones = lookup_join(zoned, each_end, "node").select(*key, "value")

    parts = connected_components(recent.filter(F.col("layer").isin(*LAYER_SETS["physical"])))
    firewalls = nodes.filter((F.col("kind") == "device") & (F.col("attrs")["role"] == "firewall")).select(
        F.col("node_id").alias("node"), F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("node_id")).alias("value")
    )
    placed = parts.select(F.col("id").alias("node"), "component")
    fw_parts = firewalls.join(placed, "node", "left").select(F.coalesce("component", "node").alias("component"), "value").distinct()
    end_parts = each_end.join(placed, "node", "left").select(*key, F.coalesce("component", "node").alias("component")).distinct()
    walls = lookup_join(end_parts, fw_parts, "component").select(*key, "value")

    tagged = (
        rules.withColumn("what", F.lit("rule")).unionByName(zones.withColumn("what", F.lit("zone")))
        .unionByName(walls.withColumn("what", F.lit("firewall")))
        .filter(text("value") != "").distinct()
    )
    sets = tagged.groupBy(*key).agg(*[
        F.array_sort(F.collect_set(F.when(F.col("what") == tag, F.col("value")))).alias(name)
        for name, tag in (("firewalls", "firewall"), ("rules", "rule"), ("zones", "zone"))
    ])
    empty = F.array().cast("array<string>")
    return asked.join(sets, key, "left").select(
        *key, "src", "dst", *[F.coalesce(F.col(c), empty).alias(c) for c in ("firewalls", "rules", "zones")]
    )


def topology_snapshot(
    nodes: DataFrame, edges: DataFrame, as_of: TimeArg, *, layer: str | None = None, since: TimeArg = DEFAULT_WINDOW,
    role: str | None = None, kind: str | None = None, limit: int | None = None,
) -> dict[str, DataFrame]:
    """``nodes``, ``edges`` and a one-row ``summary`` with counts and a truncation flag.

    All filters come before the limit, so it takes the newest of the wanted edges.
    """
    in_window, recent = subgraph(nodes, edges, as_of, since=since)
    if role is not None or kind is not None:
        in_window = nodes_by_attr(nodes, role=role, kind=kind)
        keep = in_window.select("node_id")
        for end in ("src_id", "dst_id"):
            recent = lookup_join(recent, keep.withColumnRenamed("node_id", end), end, "left_semi")
    if layer is not None:
        recent = recent.filter(F.col("layer") == layer)
    wanted = recent
    if limit is not None:
        recent = wanted.orderBy(F.col("last_seen").desc(), "edge_id").limit(int(limit))
        if role is None and kind is None:
            ends = recent.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
            in_window = in_window.join(ends, "node_id", "left_semi")
    summary = (
        in_window.select(F.lit(1).alias("n"), F.lit(0).alias("e"), F.lit(0).alias("w"))
        .unionAll(recent.select(F.lit(0), F.lit(1), F.lit(0))).unionAll(wanted.select(F.lit(0), F.lit(0), F.lit(1)))
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "node_count"), ("e", "edge_count"), ("w", "_wanted"))])
        .withColumn("truncated", F.col("_wanted") > F.col("edge_count")).drop("_wanted")
    )
    return {"nodes": in_window, "edges": recent, "summary": summary}
