"""Topology from flows and observations, and graph questions over the whole graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from netfabric.operators import topology as op
from netfabric.plans import adapter as ad
from netfabric.plans.adapter import AS_OF, DUCK, SINCE, with_views
from netfabric.plans.queries import REGISTRY
from netfabric.plans.resolve import resolve_topology
from netfabric.session import cut_lineage

EV = with_views(DUCK, "net_events")
GRAPH = with_views(DUCK, "graph_nodes", "graph_edges")


def nid(kind: str, key: str) -> str:
    return f"substring(sha1('t_main|{kind}|' || {key}), 1, 16)"


def geid(src: str, dst: str, etype: str, layer: str) -> str:
    return f"substring(sha1('t_main|' || {src} || '|' || {dst} || '|{etype}|{layer}'), 1, 16)"


PAIRS = f"""{EV}, fp AS (SELECT e.source_ip AS src_ip, e.destination_ip AS dst_ip, CAST(sum(e.network_bytes) AS BIGINT) AS bytes, count(*) AS flows,
  arg_max((e.rule_name, e.observer_ingress_zone, e.observer_egress_zone, e.event_provider), (e.timestamp, e.event_id)) AS n,
  min(e.timestamp) AS first_seen, max(e.timestamp) AS last_seen
  FROM net_events e WHERE e.source_ip IS NOT NULL AND e.destination_ip IS NOT NULL GROUP BY ALL),
pairs AS (SELECT src_ip, dst_ip, bytes, flows, n[1] AS rule_name, n[2] AS ingress_zone, n[3] AS egress_zone, n[4] AS provider, first_seen, last_seen FROM fp),
x AS (SELECT *, {nid("host", "'ip:' || src_ip")} AS s, {nid("host", "'ip:' || dst_ip")} AS d FROM pairs),
y AS (SELECT *, {geid("s", "d", "talked_to", "flow")} AS talk FROM x),
z AS (SELECT provider, s AS host, ingress_zone AS zone, first_seen, last_seen FROM y UNION ALL SELECT provider, d, egress_zone, first_seen, last_seen FROM y),
zz AS (SELECT provider, host, zone, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM z WHERE zone <> '' GROUP BY ALL),
fe AS (SELECT talk AS edge_id, s AS src_id, d AS dst_id, 'talked_to' AS edge_type, first_seen, last_seen, 'host' AS sk, 'host' AS dk FROM y
  UNION ALL SELECT {geid("talk", nid("rule", "provider || ':' || rule_name"), "governed_by", "flow")}, talk, {nid("rule", "provider || ':' || rule_name")},
    'governed_by', first_seen, last_seen, 'edge', 'rule' FROM y WHERE rule_name <> ''
  UNION ALL SELECT {geid("host", nid("zone", "provider || ':' || zone"), "in_zone", "flow")}, host, {nid("zone", "provider || ':' || zone")},
    'in_zone', first_seen, last_seen, 'host', 'zone' FROM zz)"""


def _pairs(spark, sf_dir):
    return op.flow_pairs(ad.events(spark, sf_dir), AS_OF, since=SINCE)


@REGISTRY.add("flow_pairs", f"{PAIRS} SELECT * FROM pairs")
def flow_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@REGISTRY.add("flow_edges", f"{PAIRS} SELECT edge_id, src_id, dst_id, edge_type, first_seen, last_seen FROM fe")
def flow_edges(spark, sf_dir):
    return op.flow_edges(_pairs(spark, sf_dir)).select("edge_id", "src_id", "dst_id", "edge_type", "first_seen", "last_seen")


@REGISTRY.add("placeholder_nodes", f"""{PAIRS}, ends AS (SELECT src_id AS id, sk AS kind, first_seen, last_seen FROM fe UNION ALL SELECT dst_id, dk, first_seen, last_seen FROM fe)
SELECT id AS node_id, min(kind) AS kind, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM ends WHERE kind <> 'edge' GROUP BY id""")
def placeholder_nodes(spark, sf_dir):
    edges = op.flow_edges(_pairs(spark, sf_dir))
    return op.placeholder_nodes(edges, ad.graph_nodes(spark, sf_dir)).select("node_id", "kind", "first_seen", "last_seen")


ARP = f"""{with_views(DUCK, "arp_obs")}, o AS (SELECT *, {nid("host", "'mac:' || mac")} AS m, {nid("host", "'ip:' || ip")} AS i FROM arp_obs)"""


@REGISTRY.add("nodes_from_observations", f"""{ARP} SELECT m AS node_id, 'host' AS kind, mac AS name, mac, arg_max(ip, (observed_at, ip)) AS ip,
  min(observed_at) AS first_seen, max(observed_at) AS last_seen FROM o GROUP BY m, mac""")
def nodes_from_observations(spark, sf_dir):
    df = op.nodes_from_observations(ad.observations(spark, sf_dir))
    return df.select(
        "node_id", "kind", "name", F.col("identifiers")["mac"].alias("mac"), F.col("identifiers")["ip"].alias("ip"), "first_seen", "last_seen"
    )


@REGISTRY.add("edges_from_observations", f"""{ARP} SELECT {geid("m", "i", "has_address", "l3")} AS edge_id, m AS src_id, i AS dst_id, ip,
  'junos' AS evidence, 0.7::DOUBLE AS confidence, min(observed_at) AS first_seen, max(observed_at) AS last_seen FROM o GROUP BY m, i, ip""")
def edges_from_observations(spark, sf_dir):
    df = op.edge_confidence(op.edges_from_observations(ad.observations(spark, sf_dir)))
    return df.select(
        "edge_id", "src_id", "dst_id", F.col("attrs")["ip"].alias("ip"), F.col("attrs")["evidence"].alias("evidence"), "confidence", "first_seen", "last_seen"
    )


def inventory(spark, sf_dir):
    """Device inventory from two collectors: one names a device, one knows it by MAC.

    Suppliers give the devices; devices of one group share a management
    address, so components are larger than a pair.
    """
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 40).alias("g"))
    seen = F.timestamp_seconds(F.lit(ad.EPOCH_2024) + F.col("k"))
    mac = F.concat(F.lit("02:aa:00:00:"), F.lpad(F.hex(F.floor(F.col("k") / 256)), 2, "0"), F.lit(":"), F.lpad(F.hex(F.col("k") % 256), 2, "0"))

    def rows(attrs, collector):
        return s.select(
            seen.alias("observed_at"), F.lit(collector).alias("collector"), F.lit("site").alias("source_device"), F.lit("t_main").alias("tenant_id"),
            F.lit("l2").alias("layer"), F.lit("device_inventory").alias("observation_type"), F.lit("device").alias("subj_kind"),
            F.concat(F.lit("device:"), mac).alias("subj_id"), F.lit("").alias("obj_kind"), F.lit("").alias("obj_id"), attrs.alias("attrs"), F.lit("").alias("raw"),
        )

    named = F.create_map(
        F.lit("name"), F.concat(F.lit("dev-"), F.col("k").cast("string")), F.lit("mac"), F.upper(mac), F.lit("role"), F.lit("switch"),
        F.lit("ip"), F.concat(F.lit("192.0.2."), F.col("g").cast("string")),
    )
    by_mac = F.create_map(F.lit("name"), F.lit(""), F.lit("mac"), mac, F.lit("role"), F.lit("device"), F.lit("ip"), F.lit(""))
    return rows(named, "unifi").unionByName(rows(by_mac, "junos"))


HEXMAC = "'02:aa:00:00:' || lpad(upper(to_hex(CAST(floor(s_suppkey / 256) AS BIGINT))), 2, '0') || ':' || lpad(upper(to_hex(s_suppkey % 256)), 2, '0')"
DEVICES = f"""WITH dv AS (SELECT s_suppkey AS k, s_suppkey % 40 AS g, {nid("device", "'dev-' || CAST(s_suppkey AS VARCHAR)")} AS a,
  {nid("device", f"'dev:' || lower({HEXMAC})")} AS b FROM supplier),
mem AS (SELECT g, a AS node_id FROM dv UNION ALL SELECT g, b FROM dv), can AS (SELECT g, min(node_id) AS canonical_id FROM mem GROUP BY g)"""


@REGISTRY.add("device_canonical_ids", f"{DEVICES} SELECT m.node_id, c.canonical_id FROM mem m JOIN can c USING (g)")
def device_canonical_ids(spark, sf_dir):
    return op.device_canonical_ids(cut_lineage(op.nodes_from_observations(inventory(spark, sf_dir))))


@REGISTRY.add("merge_devices", f"""{DEVICES}, t AS (SELECT g, min(k) AS k0, max(k) AS k1 FROM dv GROUP BY g)
SELECT c.canonical_id AS node_id, 'device' AS kind, '192.0.2.' || CAST(c.g AS VARCHAR) AS mgmt_ip,
  make_timestamp((CAST({ad.EPOCH_2024} AS BIGINT) + k0) * 1000000) AS first_seen, make_timestamp((CAST({ad.EPOCH_2024} AS BIGINT) + k1) * 1000000) AS last_seen
FROM can c JOIN t USING (g)""")
def merge_devices(spark, sf_dir):
    nodes = cut_lineage(op.nodes_from_observations(inventory(spark, sf_dir)))
    merged = op.merge_devices(nodes, op.device_canonical_ids(nodes))
    return merged.select("node_id", "kind", F.col("identifiers")["mgmt_ip"].alias("mgmt_ip"), "first_seen", "last_seen")


def links(spark, sf_dir):
    """Uplinks of suppliers' devices to a neighbour device, seen from both sides of the fusion."""
    inv = inventory(spark, sf_dir)
    return inv.withColumn("observation_type", F.lit("mac_entry")).select(
        "observed_at", "collector", F.col("attrs")["name"].alias("source_device"), "tenant_id", "layer", "observation_type", "subj_kind",
        F.concat(F.lit("mac:"), F.lower(F.col("attrs")["mac"])).alias("subj_id"), F.lit("device").alias("obj_kind"),
        F.when(F.col("attrs")["name"] != "", F.concat(F.lit("device:"), F.col("attrs")["name"]))
        .otherwise(F.concat(F.lit("device:dev:"), F.lower(F.col("attrs")["mac"]))).alias("obj_id"),
        F.create_map(F.lit("port"), F.lit("1"), F.lit("vlan"), F.lit("10")).alias("attrs"), "raw",
    )


@REGISTRY.add("remap_edges", f"""{DEVICES}, e AS (SELECT DISTINCT {nid("host", f"'mac:' || lower({HEXMAC})")} AS src_id, s_suppkey % 40 AS g FROM supplier)
SELECT {geid("e.src_id", "c.canonical_id", "attaches_to", "l2")} AS edge_id, e.src_id, c.canonical_id AS dst_id, 1.0::DOUBLE AS confidence, 'junos,unifi' AS evidence
FROM e JOIN can c USING (g)""")
def remap_edges(spark, sf_dir):
    canonical = op.device_canonical_ids(cut_lineage(op.nodes_from_observations(inventory(spark, sf_dir))))
    moved = op.edge_confidence(op.remap_edges(op.edges_from_observations(links(spark, sf_dir)), canonical))
    return moved.select("edge_id", "src_id", "dst_id", "confidence", F.col("attrs")["evidence"].alias("evidence"))


@REGISTRY.add("resolve_topology", f"""{PAIRS}, {ARP[5:]}, k AS (SELECT src_id AS id, sk AS kind FROM fe WHERE sk <> 'edge' UNION SELECT dst_id, dk FROM fe UNION SELECT m, 'host' FROM o)
SELECT 'node' AS what, kind AS type, count(DISTINCT id) AS n FROM k GROUP BY kind
UNION ALL SELECT 'edge', edge_type, count(*) FROM fe GROUP BY edge_type
UNION ALL SELECT 'edge', 'has_address', count(DISTINCT m || i) FROM o""")
def resolve_topology_counts(spark, sf_dir):
    nodes, edges = resolve_topology(ad.observations(spark, sf_dir), op.flow_edges(_pairs(spark, sf_dir)))
    n = nodes.groupBy(F.col("kind").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "type", "n")
    e = edges.groupBy(F.col("edge_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "type", "n")
    return n.unionByName(e)


# ---------------------------------------------------------------- graph questions

def _all_names(spark, sf_dir):
    return ad.graph_nodes(spark, sf_dir).select(F.col("name").alias("lookup"))


@REGISTRY.add("find_node", f"{GRAPH} SELECT name AS lookup, node_id, kind, name, last_seen FROM graph_nodes")
def find_node(spark, sf_dir):
    return op.find_node(ad.graph_nodes(spark, sf_dir), _all_names(spark, sf_dir)).select("lookup", "node_id", "kind", "name", "last_seen")


RECENT = f"r AS (SELECT * FROM graph_edges WHERE last_seen >= TIMESTAMP '{SINCE}')"


@REGISTRY.add("subgraph", f"{GRAPH}, {RECENT} SELECT node_id, kind, name FROM graph_nodes WHERE node_id IN (SELECT src_id FROM r UNION SELECT dst_id FROM r)")
def subgraph(spark, sf_dir):
    nodes, _ = op.subgraph(ad.graph_nodes(spark, sf_dir), ad.graph_edges(spark, sf_dir), AS_OF, since=SINCE)
    return nodes.select("node_id", "kind", "name")


@REGISTRY.add("subgraph_edges", f"{GRAPH}, {RECENT} SELECT edge_id, src_id, dst_id, last_seen FROM r ORDER BY last_seen DESC, edge_id LIMIT 500")
def subgraph_edges(spark, sf_dir):
    _, edges = op.subgraph(ad.graph_nodes(spark, sf_dir), ad.graph_edges(spark, sf_dir), AS_OF, since=SINCE, limit=500)
    return edges.select("edge_id", "src_id", "dst_id", "last_seen")


@REGISTRY.add("nodes_by_attr", f"{GRAPH} SELECT node_id, name, last_seen FROM graph_nodes WHERE role = 'firewall' AND kind = 'device'")
def nodes_by_attr(spark, sf_dir):
    return op.nodes_by_attr(ad.graph_nodes(spark, sf_dir), role="firewall", kind="device").select("node_id", "name", "last_seen")


@REGISTRY.add("locate", f"""{GRAPH} SELECT n.name AS lookup, n.node_id AS entity, n.name, e.dst_id AS attached_to, e.port, e.vlan,
  CASE WHEN e.dst_id IS NOT NULL THEN 'switchport' END AS via
FROM graph_nodes n LEFT JOIN graph_edges e ON e.src_id = n.node_id AND e.edge_type = 'attaches_to'""")
def locate(spark, sf_dir):
    return op.locate(ad.graph_nodes(spark, sf_dir), ad.graph_edges(spark, sf_dir), _all_names(spark, sf_dir), AS_OF, since=SINCE)


ADJ = "adj AS (SELECT src_id AS a, dst_id AS b FROM graph_edges UNION SELECT dst_id, src_id FROM graph_edges)"
REACH = f"""{GRAPH}, {ADJ}, st AS (SELECT node_id, name FROM graph_nodes WHERE role = 'hypervisor'),
h1 AS (SELECT s.name AS lookup, adj.b AS node FROM st s JOIN adj ON adj.a = s.node_id),
h2 AS (SELECT h1.lookup, adj.b AS node FROM h1 JOIN adj ON adj.a = h1.node),
rc AS (SELECT name AS lookup, node_id AS node, 0 AS hops FROM st UNION ALL SELECT lookup, node, 1 FROM h1 UNION ALL SELECT lookup, node, 2 FROM h2),
reach AS (SELECT lookup, node, min(hops) AS hops FROM rc GROUP BY ALL)"""


def _servers(spark, sf_dir):
    nodes = ad.graph_nodes(spark, sf_dir)
    return nodes.filter(F.col("attrs")["role"] == "hypervisor").select(F.col("name").alias("lookup"))


@REGISTRY.add("neighbors", f"{REACH} SELECT lookup, node AS node_id, hops FROM reach")
def neighbors(spark, sf_dir):
    nodes, _ = op.neighbors(ad.graph_nodes(spark, sf_dir), ad.graph_edges(spark, sf_dir), _servers(spark, sf_dir), AS_OF, depth=2, since=SINCE)
    return nodes.select("lookup", "node_id", "hops")


@REGISTRY.add("neighbor_edges", f"""{REACH} SELECT x.lookup, e.edge_id, e.layer FROM graph_edges e JOIN reach x ON x.node = e.src_id
JOIN reach y ON y.node = e.dst_id AND y.lookup = x.lookup WHERE e.layer = 'l2'""")
def neighbor_edges(spark, sf_dir):
    _, edges = op.neighbors(
        ad.graph_nodes(spark, sf_dir), ad.graph_edges(spark, sf_dir), _servers(spark, sf_dir), AS_OF, depth=2, layer="l2", since=SINCE
    )
    return edges.select("lookup", "edge_id", "layer")


# Every host asks for its path to the router of its region: host, site, router.
@REGISTRY.add("find_path", f"""{GRAPH} SELECT 'host-' || CAST(c_custkey AS VARCHAR) AS src_lookup, 'router-' || CAST(n_regionkey AS VARCHAR) AS dst_lookup, true AS found, 2 AS hops,
  {nid("host", "'host-' || CAST(c_custkey AS VARCHAR)")} || '>' || {nid("device", "'site-' || CAST(c_nationkey AS VARCHAR)")} || '>' || {nid("device", "'router-' || CAST(n_regionkey AS VARCHAR)")} AS path
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def find_path(spark, sf_dir):
    nation = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    pairs = ad.table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        F.concat(F.lit("host-"), F.col("c_custkey").cast("string")).alias("src_lookup"),
        F.concat(F.lit("router-"), F.col("n_regionkey").cast("string")).alias("dst_lookup"),
    )
    paths = op.find_path(ad.graph_nodes(spark, sf_dir), ad.graph_edges(spark, sf_dir), pairs, AS_OF, since=SINCE)
    return paths.select("src_lookup", "dst_lookup", "found", "hops", F.array_join("path_nodes", ">").alias("path"))


@REGISTRY.add("enforcement_points", """WITH fw AS (SELECT n_regionkey, string_agg('site-' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY 'site-' || CAST(n_nationkey AS VARCHAR)) AS firewalls
  FROM nation WHERE n_nationkey % 3 = 0 GROUP BY n_regionkey)
SELECT 'host-' || CAST(c_custkey AS VARCHAR) AS src_lookup, 'router-' || CAST(n_regionkey AS VARCHAR) AS dst_lookup, coalesce(firewalls, '') AS firewalls, '' AS rules, '' AS zones
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN fw USING (n_regionkey)""")
def enforcement_points(spark, sf_dir):
    nation = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    pairs = ad.table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        F.concat(F.lit("host-"), F.col("c_custkey").cast("string")).alias("src_lookup"),
        F.concat(F.lit("router-"), F.col("n_regionkey").cast("string")).alias("dst_lookup"),
    )
    points = op.enforcement_points(ad.graph_nodes(spark, sf_dir), ad.graph_edges(spark, sf_dir), pairs, AS_OF, since=SINCE)
    return points.select("src_lookup", "dst_lookup", *[F.array_join(c, ",").alias(c) for c in ("firewalls", "rules", "zones")])


# The flow graph itself: every talking pair, with rules and zones.
@REGISTRY.add("enforcement_points_flows", f"""{PAIRS}, u AS (SELECT s, d, src_ip, dst_ip FROM y), b AS (SELECT s, d, rule_name FROM y WHERE rule_name <> ''),
ru AS (SELECT u.src_ip, u.dst_ip, string_agg(DISTINCT b.rule_name, ',' ORDER BY b.rule_name) AS rules FROM u JOIN b ON (b.s = u.s AND b.d = u.d) OR (b.s = u.d AND b.d = u.s) GROUP BY ALL),
zo AS (SELECT u.src_ip, u.dst_ip, string_agg(DISTINCT zz.zone, ',' ORDER BY zz.zone) AS zones FROM u JOIN zz ON zz.host = u.s OR zz.host = u.d GROUP BY ALL)
SELECT 'ip-' || u.src_ip AS src_lookup, 'ip-' || u.dst_ip AS dst_lookup, coalesce(ru.rules, '') AS rules, coalesce(zo.zones, '') AS zones
FROM u LEFT JOIN ru USING (src_ip, dst_ip) LEFT JOIN zo USING (src_ip, dst_ip)""")
def enforcement_points_flows(spark, sf_dir):
    pairs = cut_lineage(_pairs(spark, sf_dir))
    edges = cut_lineage(op.flow_edges(pairs))
    nodes = op.placeholder_nodes(edges, ad.graph_nodes(spark, sf_dir))
    ips = pairs.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    named = ips.select(
        F.substring(F.sha1(F.concat(F.lit("t_main|host|ip:"), "ip")), 1, 16).alias("node_id"), F.concat(F.lit("ip-"), "ip").alias("_ip")
    )
    nodes = nodes.join(named, "node_id", "left").withColumn(
        "identifiers", F.when(F.col("_ip").isNotNull(), F.create_map(F.lit("ip"), F.col("_ip"))).otherwise(F.col("identifiers"))
    ).drop("_ip")
    asked = pairs.select(F.concat(F.lit("ip-"), "src_ip").alias("src_lookup"), F.concat(F.lit("ip-"), "dst_ip").alias("dst_lookup"))
    points = op.enforcement_points(nodes, edges, asked, AS_OF, since=SINCE)
    return points.select("src_lookup", "dst_lookup", F.array_join("rules", ",").alias("rules"), F.array_join("zones", ",").alias("zones"))


@REGISTRY.add("topology_snapshot", f"""{GRAPH}, k AS (SELECT node_id FROM graph_nodes WHERE kind = 'device'),
e AS (SELECT 1 FROM graph_edges WHERE src_id IN (SELECT node_id FROM k) AND dst_id IN (SELECT node_id FROM k))
SELECT (SELECT count(*) FROM k) AS node_count, (SELECT count(*) FROM e) AS edge_count, false AS truncated""")
def topology_snapshot(spark, sf_dir):
    return op.topology_snapshot(ad.graph_nodes(spark, sf_dir), ad.graph_edges(spark, sf_dir), AS_OF, since=SINCE, kind="device")["summary"]
