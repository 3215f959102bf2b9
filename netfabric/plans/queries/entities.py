"""Entity resolution and lookups over the whole flow and ARP tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netfabric.operators import entities as op
from netfabric.plans import adapter as ad
from netfabric.plans.adapter import ARP_AS_OF, ARP_SINCE, AS_OF, DUCK, SINCE, with_views
from netfabric.plans.queries import REGISTRY
from netfabric.plans.queries.policy import edge_id, eid
from netfabric.plans.resolve import EntityResolution, entity_tables, resolve_policies
from netfabric.session import cut_lineage

BASE = with_views(DUCK, "net_events", "arp_obs", "rules")
SEG = "CASE WHEN split_part({h}, '.', 1) = '' THEN 'unknown' ELSE lower(split_part({h}, '.', 1)) END"

# The resolver written as SQL, step by step under the operators' names.
FLOWS = f"""fl AS (SELECT e.source_ip AS src_ip, e.destination_ip AS dst_ip, e.observer_hostname, CAST(sum(coalesce(e.network_bytes, 0)) AS BIGINT) AS bytes,
  count(*) AS flows, arg_max((e.rule_name, e.event_provider, e.network_transport), (e.timestamp, e.event_id)) AS n,
  min(e.timestamp) AS first_seen, max(e.timestamp) AS last_seen
  FROM net_events e WHERE e.source_ip IS NOT NULL AND e.destination_ip IS NOT NULL GROUP BY ALL),
flows AS (SELECT src_ip, dst_ip, observer_hostname, bytes, flows, n[1] AS rule_name, n[2] AS provider, n[3] AS transport, first_seen, last_seen,
  {SEG.format(h="observer_hostname")} AS segment FROM fl)"""
BIND = f"""pm AS (SELECT source_device, ip, mac, max(observed_at) AS observed_at FROM arp_obs GROUP BY ALL),
arp AS (SELECT source_device, ip, arg_max(mac, (observed_at, mac)) AS mac, max(observed_at) AS observed_at, count(*) AS mac_count FROM pm GROUP BY ALL),
bind AS (SELECT {SEG.format(h="source_device")} AS segment, ip, arg_max(mac, (observed_at, mac)) AS mac,
  max(mac_count) > 1 OR min(mac) <> max(mac) AS conflict FROM arp GROUP BY ALL)"""
ADDR = f"""ends AS (SELECT segment, src_ip AS ip, first_seen, last_seen FROM flows UNION ALL SELECT segment, dst_ip, first_seen, last_seen FROM flows),
addr AS (SELECT {eid("'asset|' || CASE WHEN b.mac IS NOT NULL THEN 'mac:' || b.mac ELSE 'ip:' || s.segment || ':' || s.ip END")} AS entity_id,
  s.segment, s.ip, b.mac, coalesce(b.conflict, false) AS conflict, s.first_seen, s.last_seen
  FROM (SELECT segment, ip, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM ends GROUP BY ALL) s
  LEFT JOIN bind b ON b.segment = s.segment AND b.ip = s.ip)"""
ASSETS = """asset AS (SELECT entity_id, max(mac) AS mac, count(DISTINCT ip) AS ip_count, min(ip) AS first_ip, max(conflict AND mac IS NOT NULL) AS ip_conflict,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM addr GROUP BY entity_id)"""
COMM_ID = edge_id("s.entity_id", "d.entity_id", "communicated_with", "observed")
RESOLVED = f"""res AS (SELECT f.*, s.entity_id AS src_id, d.entity_id AS dst_id, {COMM_ID} AS edge_id FROM flows f
  JOIN addr s ON s.segment = f.segment AND s.ip = f.src_ip JOIN addr d ON d.segment = f.segment AND d.ip = f.dst_ip),
port AS (SELECT DISTINCT r.src_id, r.dst_id, e.destination_port AS p FROM net_events e JOIN res r
  ON r.src_ip = e.source_ip AND r.dst_ip = e.destination_ip AND r.observer_hostname = e.observer_hostname),
ports AS (SELECT src_id, dst_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS ports FROM port GROUP BY ALL),
comm AS (SELECT r.edge_id, r.src_id, r.dst_id, CAST(sum(flows) AS BIGINT) AS sessions, CAST(sum(bytes) AS BIGINT) AS bytes, any_value(q.ports) AS ports,
  array_to_string(list_sort(list_distinct(list(nullif(provider, '')))), ',') AS providers,
  array_to_string(list_sort(list_distinct(list(nullif(transport, '')))), ',') AS transports,
  array_to_string(list_sort(list_distinct(list(nullif(observer_hostname, '')))), ',') AS observer_hosts,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM res r JOIN ports q USING (src_id, dst_id) GROUP BY ALL)"""
POLICY_ID = eid("'policy|' || provider || ':' || rule_name")
GOV = f"""gov AS (SELECT {edge_id("edge_id", POLICY_ID, "governed_by", "observed")} AS edge_id, edge_id AS src_id, {POLICY_ID} AS dst_id, rule_name AS rule, provider,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM (SELECT * FROM res WHERE rule_name <> '') GROUP BY ALL)"""
ALL_STEPS = f"{BASE}, {FLOWS}, {BIND}, {ADDR}, {ASSETS}, {RESOLVED}, {GOV}"


def observed(spark, sf_dir):
    return EntityResolution(
        ad.events(spark, sf_dir), ad.observations(spark, sf_dir), AS_OF, since=SINCE,
        bindings_as_of=ARP_AS_OF, bindings_since=ARP_SINCE,
    )


def tables(spark, sf_dir):
    """The resolver, and its entity and governed_by tables and alias index as a job would store them."""
    seen = observed(spark, sf_dir)
    entities, governed = entity_tables(seen, resolve_policies(ad.rules(spark, sf_dir)))
    entities = cut_lineage(entities)
    return seen, entities, cut_lineage(governed), op.store_alias_index(op.aliases(entities, seen.addresses))


@REGISTRY.add("flow_vantage", f"{BASE}, {FLOWS} SELECT src_ip, dst_ip, observer_hostname, bytes, flows, rule_name, provider, transport, first_seen, last_seen FROM flows")
def flow_vantage(spark, sf_dir):
    return observed(spark, sf_dir).flows.drop("ports")


@REGISTRY.add("arp_bindings", f"{BASE}, {BIND} SELECT * FROM arp")
def arp_bindings(spark, sf_dir):
    return op.arp_bindings(ad.observations(spark, sf_dir), ARP_AS_OF, since=ARP_SINCE)


@REGISTRY.add("binding_map", f"{BASE}, {BIND} SELECT * FROM bind")
def binding_map(spark, sf_dir):
    return observed(spark, sf_dir).bindings


@REGISTRY.add("asset_addresses", f"{ALL_STEPS} SELECT * FROM addr")
def asset_addresses(spark, sf_dir):
    return observed(spark, sf_dir).addresses


@REGISTRY.add("assets", f"""{ALL_STEPS} SELECT entity_id, 't_main' AS tenant_id, 'asset' AS kind, coalesce(mac, first_ip) AS name, mac, ip_count, ip_conflict,
  'observed' AS source, CASE WHEN mac IS NULL THEN 'ip_only' ELSE 'mac' END AS identity_basis, CASE WHEN mac IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
  first_seen, last_seen FROM asset""")
def assets(spark, sf_dir):
    return observed(spark, sf_dir).assets


@REGISTRY.add("observed_policies", f"""{ALL_STEPS} SELECT {POLICY_ID} AS entity_id, rule_name AS name, provider, min(first_seen) AS first_seen, max(last_seen) AS last_seen
  FROM flows WHERE rule_name <> '' GROUP BY rule_name, provider""")
def observed_policies(spark, sf_dir):
    return observed(spark, sf_dir).policies.select("entity_id", "name", "provider", "first_seen", "last_seen")


def _comm_text(df):
    return df.select(
        "edge_id", "src_id", "dst_id", "sessions", "bytes", *[F.array_join(c, ",").alias(c) for c in op.COMM_SETS], "first_seen", "last_seen"
    )


@REGISTRY.add("communication_edges", f"{ALL_STEPS} SELECT * FROM comm")
def communication_edges(spark, sf_dir):
    return _comm_text(observed(spark, sf_dir).communication)


@REGISTRY.add("governed_edges", f"{ALL_STEPS} SELECT * FROM gov")
def governed_edges(spark, sf_dir):
    return observed(spark, sf_dir).governed.select("edge_id", "src_id", "dst_id", "rule", "provider", "first_seen", "last_seen")


# Twins: address-only assets come from flows resolved without bindings, MAC
# assets from the same flows with them.
TWIN = f"""{ALL_STEPS},
old AS (SELECT f.*, {eid("'asset|ip:' || segment || ':' || src_ip")} AS o_src, {eid("'asset|ip:' || segment || ':' || dst_ip")} AS o_dst FROM flows f),
uniq AS (SELECT ip, min(mac) AS mac FROM bind GROUP BY ip HAVING min(mac) = max(mac)),
own AS (SELECT DISTINCT segment, ip, {eid("'asset|ip:' || segment || ':' || ip")} AS twin_id FROM ends),
twin AS (SELECT o.twin_id, a.entity_id AS target_id FROM own o JOIN uniq u ON u.ip = o.ip JOIN asset a ON a.mac = u.mac),
oc AS (SELECT {edge_id("o_src", "o_dst", "communicated_with", "observed")} AS edge_id, o_src, o_dst, CAST(sum(flows) AS BIGINT) AS sessions, CAST(sum(bytes) AS BIGINT) AS bytes,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM old GROUP BY o_src, o_dst),
aff AS (SELECT oc.*, coalesce(s.target_id, o_src) AS n_src, coalesce(d.target_id, o_dst) AS n_dst FROM oc
  LEFT JOIN twin s ON s.twin_id = o_src LEFT JOIN twin d ON d.twin_id = o_dst WHERE s.target_id IS NOT NULL OR d.target_id IS NOT NULL)"""


def _twins(spark, sf_dir):
    seen = observed(spark, sf_dir)
    none = seen.bindings.filter(F.lit(False))
    plain = op.asset_addresses(seen.flows, none)
    resolved = op.flows_with_assets(seen.flows, plain)
    asset_rows = op.assets(plain).unionByName(seen.assets.filter(F.col("identity_basis") == "mac"))
    twins = op.asset_twins(plain, asset_rows, seen.bindings)
    return twins, op.reconcile_twins(twins, op.communication_edges(resolved), op.governed_edges(resolved))


@REGISTRY.add("asset_twins", f"{TWIN} SELECT * FROM twin")
def asset_twins(spark, sf_dir):
    return _twins(spark, sf_dir)[0]


@REGISTRY.add("reconcile_twins", f"""{TWIN} SELECT {edge_id("n_src", "n_dst", "communicated_with", "observed")} AS edge_id, n_src AS src_id, n_dst AS dst_id,
  CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(bytes) AS BIGINT) AS bytes, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM aff GROUP BY n_src, n_dst""")
def reconcile_twins(spark, sf_dir):
    return _twins(spark, sf_dir)[1]["merged_edges"].select("edge_id", "src_id", "dst_id", "sessions", "bytes", "first_seen", "last_seen")


@REGISTRY.add("reconcile_deletes", f"""{TWIN} SELECT DISTINCT edge_id FROM aff UNION
SELECT {edge_id("a.edge_id", POLICY_ID, "governed_by", "observed")} FROM aff a JOIN old o ON o.o_src = a.o_src AND o.o_dst = a.o_dst WHERE o.rule_name <> ''""")
def reconcile_deletes(spark, sf_dir):
    return _twins(spark, sf_dir)[1]["delete_edges"]


LOOK = f"""{ALL_STEPS},
ea AS (SELECT entity_id, entity_id AS alias FROM asset UNION SELECT entity_id, ip FROM addr UNION SELECT entity_id, mac FROM addr WHERE mac IS NOT NULL),
lk AS (SELECT DISTINCT source_ip AS lookup FROM net_events UNION SELECT DISTINCT upper(mac) FROM arp_obs),
cand AS (SELECT l.lookup, a.entity_id, CASE WHEN s.mac IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence, s.last_seen, coalesce(s.mac, s.first_ip) AS name
  FROM lk l JOIN ea a ON a.alias = CASE WHEN l.lookup LIKE '%:%' THEN lower(l.lookup) ELSE l.lookup END JOIN asset s USING (entity_id))"""


def _lookups(spark, sf_dir):
    ips = ad.events(spark, sf_dir).select(F.col("source_ip").alias("lookup"))
    macs = ad.view(spark, sf_dir, "arp_obs").select(F.upper("mac").alias("lookup"))
    return ips.unionByName(macs).distinct()


@REGISTRY.add("find_entities", f"{LOOK} SELECT * FROM cand")
def find_entities(spark, sf_dir):
    _, entities, _, index = tables(spark, sf_dir)
    found = op.find_entities(entities, index, _lookups(spark, sf_dir))
    return found.select("lookup", "entity_id", "confidence", "last_seen", "name")


@REGISTRY.add("find_entity_best", f"""{LOOK}, r AS (SELECT *, row_number() OVER (PARTITION BY lookup ORDER BY confidence DESC, last_seen DESC, entity_id) AS rn FROM cand)
SELECT lookup, entity_id, confidence, last_seen, name FROM r WHERE rn = 1""")
def find_entity_best(spark, sf_dir):
    _, entities, _, index = tables(spark, sf_dir)
    found = op.find_entities(entities, index, _lookups(spark, sf_dir), best_only=True)
    return found.select("lookup", "entity_id", "confidence", "last_seen", "name")


# Every address pair seen in flows is asked about, each address with all its candidates.
PAIRS = f"""{ALL_STEPS}, pr AS (SELECT DISTINCT src_ip AS client, dst_ip AS server FROM flows),
cs AS (SELECT DISTINCT ip, entity_id FROM addr),
fw AS (SELECT DISTINCT p.client, p.server, c.edge_id, c.src_id AS client_id, c.dst_id AS server_id FROM pr p JOIN cs a ON a.ip = p.client JOIN comm c ON c.src_id = a.entity_id JOIN cs b ON b.ip = p.server AND b.entity_id = c.dst_id),
bw AS (SELECT DISTINCT p.client, p.server, c.edge_id, c.dst_id AS client_id, c.src_id AS server_id FROM pr p JOIN cs a ON a.ip = p.client JOIN comm c ON c.dst_id = a.entity_id JOIN cs b ON b.ip = p.server AND b.entity_id = c.src_id),
btw AS (SELECT * FROM fw UNION ALL SELECT bw.* FROM bw ANTI JOIN fw USING (client, server, edge_id))"""


def _between(spark, sf_dir):
    seen = observed(spark, sf_dir)
    pairs = seen.flows.select(F.col("src_ip").alias("client"), F.col("dst_ip").alias("server")).distinct()
    owners = seen.addresses.select("ip", "entity_id").distinct()
    left = pairs.join(owners.withColumnRenamed("ip", "client"), "client").select("client", "server", "entity_id")
    right = pairs.join(owners.withColumnRenamed("ip", "server"), "server").select("client", "server", "entity_id")
    return op.communication_between(seen.communication, left, right, AS_OF, since=SINCE, keys=["client", "server"]), seen


@REGISTRY.add("communication_between", f"{PAIRS} SELECT client, server, edge_id, client_id, server_id FROM btw")
def communication_between(spark, sf_dir):
    return _between(spark, sf_dir)[0].select("client", "server", "edge_id", "client_id", "server_id")


@REGISTRY.add("select_pair", f"""{PAIRS}, g AS (SELECT b.client, b.server, b.client_id, b.server_id, max(c.observer_hosts <> '') AS has_provenance,
  CAST(sum(c.sessions) AS BIGINT) AS sessions, CAST(sum(c.bytes) AS BIGINT) AS bytes, max(c.last_seen) AS last_seen FROM btw b JOIN comm c USING (edge_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY client, server ORDER BY has_provenance DESC, sessions DESC, last_seen DESC, client_id DESC, server_id DESC) AS rn FROM g)
SELECT * EXCLUDE (rn) FROM r WHERE rn = 1""")
def select_pair(spark, sf_dir):
    return op.select_pair(_between(spark, sf_dir)[0], ["client", "server"])


@REGISTRY.add("governed_policies", f"""{ALL_STEPS} SELECT DISTINCT src_id AS edge_id, dst_id AS policy_id, rule, provider AS vendor, 'observed' AS source FROM gov""")
def governed_policies(spark, sf_dir):
    seen, entities, gov, _ = tables(spark, sf_dir)
    return op.governed_policies(gov, entities, seen.communication.select("edge_id"))


@REGISTRY.add("configured_policies", f"""{BASE} SELECT device_name AS firewall, {eid("'policy|' || provider || ':' || device_name || ':' || rule_name")} AS policy_id,
  rule_name AS rule, action, from_zone, to_zone, CAST(position AS VARCHAR) AS position, enabled, 'configured' AS source FROM rules""")
def configured_policies(spark, sf_dir):
    _, entities, gov, _ = tables(spark, sf_dir)
    walls = ad.rules(spark, sf_dir).select(F.col("device_name").alias("firewall"))
    return op.configured_policies(entities, gov, walls).drop("clauses")


@REGISTRY.add("configured_policy_counts", f"{BASE} SELECT device_name AS firewall, count(*) AS count FROM rules GROUP BY device_name")
def configured_policy_counts(spark, sf_dir):
    _, entities, gov, _ = tables(spark, sf_dir)
    walls = ad.rules(spark, sf_dir).select(F.col("device_name").alias("firewall"))
    return op.configured_policy_counts(op.configured_policies(entities, gov, walls))
