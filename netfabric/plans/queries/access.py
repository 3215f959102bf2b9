"""Access explanation over every talking address pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from netfabric.operators import access as op
from netfabric.operators import topology as to
from netfabric.plans import adapter as ad
from netfabric.plans.adapter import AS_OF, SINCE
from netfabric.plans.queries import REGISTRY
from netfabric.plans.queries.entities import ALL_STEPS, PAIRS, tables
from netfabric.session import cut_lineage

CHOSEN = """g AS (SELECT b.client, b.server, b.client_id, b.server_id, max(c.observer_hosts <> '') AS pv, CAST(sum(c.sessions) AS BIGINT) AS sessions,
  CAST(sum(c.bytes) AS BIGINT) AS bytes, max(c.last_seen) AS ls FROM btw b JOIN comm c USING (edge_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY client, server ORDER BY pv DESC, sessions DESC, ls DESC, client_id DESC, server_id DESC) AS rn FROM g),
ch AS (SELECT * FROM r WHERE rn = 1),
ho AS (SELECT DISTINCT ch.client, ch.server, split_part(res.observer_hostname, '.', 1) AS fw FROM ch JOIN btw b USING (client, server, client_id, server_id)
  JOIN res ON res.edge_id = b.edge_id WHERE res.observer_hostname <> ''),
hl AS (SELECT client, server, string_agg(fw, ',' ORDER BY fw) AS firewalls, count(*) AS n, min(fw) AS one FROM ho GROUP BY ALL),
cc AS (SELECT ho.client, ho.server, count(*) AS n FROM ho JOIN rules ON rules.device_name = ho.fw GROUP BY ALL),
oc AS (SELECT ch.client, ch.server, count(DISTINCT (gov.provider, gov.rule)) AS n FROM ch JOIN btw b USING (client, server, client_id, server_id)
  JOIN gov ON gov.src_id = b.edge_id GROUP BY ALL)"""
# Alerts on either address asked about, or on any address of the two entities.
DETECTED = """dip AS (SELECT client, server, client AS ip FROM ch UNION SELECT client, server, server FROM ch
  UNION SELECT ch.client, ch.server, a.ip FROM ch JOIN addr a ON a.entity_id = ch.client_id
  UNION SELECT ch.client, ch.server, a.ip FROM ch JOIN addr a ON a.entity_id = ch.server_id),
al AS (SELECT event_id, e.timestamp AS seen, coalesce(ids_signature, '') AS signature, coalesce(ids_severity, '') AS severity, source_ip, destination_ip
  FROM net_events e WHERE event_provider = 'unifi' AND event_kind = 'alert'),
det AS (SELECT d.client, d.server, event_id, seen AS timestamp, signature, severity, source_ip, destination_ip FROM dip d JOIN al ON al.source_ip = d.ip
  UNION SELECT d.client, d.server, event_id, seen, signature, severity, source_ip, destination_ip FROM dip d JOIN al ON al.destination_ip = d.ip)"""


def _asked(spark, sf_dir):
    """Access of every talking address pair."""
    seen, entities, gov, index = tables(spark, sf_dir)
    events = ad.events(spark, sf_dir)
    edges = cut_lineage(to.flow_edges(to.flow_pairs(events, AS_OF, since=SINCE)))
    nodes = to.placeholder_nodes(edges, ad.graph_nodes(spark, sf_dir))
    ips = seen.flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct().select(
        F.substring(F.sha1(F.concat(F.lit("t_main|host|ip:"), "ip")), 1, 16).alias("node_id"), F.col("ip").alias("_ip")
    )
    nodes = nodes.join(ips, "node_id", "left").withColumn(
        "identifiers", F.when(F.col("_ip").isNotNull(), F.create_map(F.lit("ip"), F.col("_ip"))).otherwise(F.col("identifiers"))
    ).drop("_ip")
    nodes = cut_lineage(nodes)
    pairs = seen.flows.select(F.col("src_ip").alias("client"), F.col("dst_ip").alias("server")).distinct()
    return op.explain_access(pairs, entities, index, cut_lineage(seen.communication), gov, nodes, edges, events, AS_OF, since=SINCE)


@REGISTRY.add("explain_access", f"""{PAIRS}, {CHOSEN}, {DETECTED}
SELECT ch.client, ch.server, ch.client_id, ch.server_id, ch.sessions, ch.bytes, coalesce(hl.firewalls, '') AS firewalls,
  CASE WHEN hl.n IS NULL THEN 'no_path_firewall' ELSE 'provenance' END AS firewall_basis, CASE WHEN hl.n = 1 THEN hl.one END AS attributed_firewall,
  CASE WHEN hl.n IS NULL THEN 'no_path_firewall' WHEN cc.n IS NULL THEN 'firewall_name_unmatched' ELSE 'topology' END AS configured_basis,
  CAST(coalesce(cc.n, 0) AS BIGINT) AS coverage_configured, coalesce(dn.n, 0) AS detection_count, false AS detections_truncated,
  true AS path_found, 1 AS hops
FROM ch LEFT JOIN hl USING (client, server) LEFT JOIN cc USING (client, server)
LEFT JOIN (SELECT client, server, count(*) AS n FROM det GROUP BY ALL) dn USING (client, server)""")
def explain_access(spark, sf_dir):
    return _asked(spark, sf_dir).answers.select(
        "client", "server", F.col("client_entity.entity_id").alias("client_id"), F.col("server_entity.entity_id").alias("server_id"),
        "sessions", "bytes", F.array_join("firewalls", ",").alias("firewalls"), "firewall_basis", "attributed_firewall", "configured_basis",
        "coverage_configured", "detection_count", "detections_truncated", F.col("topology_path.found").alias("path_found"),
        F.col("topology_path.hops").alias("hops"),
    )


@REGISTRY.add("explain_access_controls", f"""{PAIRS}, {CHOSEN}
SELECT DISTINCT ch.client, ch.server, CASE WHEN hl.n = 1 THEN hl.one END AS firewall, gov.provider AS vendor, gov.rule, 'observed' AS source,
  CASE WHEN hl.n IS NULL THEN 'no_path_firewall' ELSE 'provenance' END AS firewall_basis
FROM ch JOIN btw b USING (client, server, client_id, server_id) JOIN gov ON gov.src_id = b.edge_id LEFT JOIN hl USING (client, server)""")
def explain_access_controls(spark, sf_dir):
    return _asked(spark, sf_dir).controls


@REGISTRY.add("explain_access_configured", f"""{PAIRS}, {CHOSEN}
SELECT DISTINCT ho.fw AS firewall, r.rule_name AS rule, r.action, r.from_zone, r.to_zone, CAST(r.position AS VARCHAR) AS position, r.enabled,
  'configured' AS source, concat('application=', r.application, ';dest_addresses=any;service=', r.application, ';source_addresses=', r.source_address,
    CASE WHEN r.position % 3 = 0 THEN ';source_negated=true' ELSE '' END) AS clauses
FROM ho JOIN rules r ON r.device_name = ho.fw""")
def explain_access_configured(spark, sf_dir):
    return _asked(spark, sf_dir).configured.drop("policy_id").withColumn("clauses", F.array_join(
        F.transform(F.array_sort(F.map_entries("clauses")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


@REGISTRY.add("explain_access_firewalls", f"""{PAIRS}, {CHOSEN} SELECT client, server, fw AS firewall FROM ho""")
def explain_access_firewalls(spark, sf_dir):
    return _asked(spark, sf_dir).firewalls


@REGISTRY.add("explain_access_detections", f"""{PAIRS}, {CHOSEN}, {DETECTED} SELECT * FROM det""")
def explain_access_detections(spark, sf_dir):
    return _asked(spark, sf_dir).detections.select("client", "server", "event_id", "timestamp", "signature", "severity", "source_ip", "destination_ip")


@REGISTRY.add("observed_by", f"""{ALL_STEPS}, lk AS (SELECT DISTINCT source_ip AS lookup FROM net_events),
cand AS (SELECT l.lookup, a.entity_id, s.mac, s.last_seen, coalesce(s.mac, s.first_ip) AS name,
  row_number() OVER (PARTITION BY l.lookup ORDER BY CASE WHEN s.mac IS NULL THEN 0 ELSE 1 END DESC, s.last_seen DESC, a.entity_id) AS rn
  FROM lk l JOIN (SELECT DISTINCT ip, entity_id FROM addr) a ON a.ip = l.lookup JOIN asset s USING (entity_id)),
best AS (SELECT * FROM cand WHERE rn = 1),
ips AS (SELECT lookup, lookup AS ip FROM best UNION SELECT b.lookup, a.ip FROM best b JOIN addr a USING (entity_id)),
ob AS (SELECT source_ip AS ip, observer_hostname FROM net_events WHERE observer_hostname <> '' UNION SELECT destination_ip, observer_hostname FROM net_events WHERE observer_hostname <> ''),
f AS (SELECT DISTINCT i.lookup, split_part(o.observer_hostname, '.', 1) AS fw FROM ips i JOIN ob o ON o.ip = i.ip)
SELECT b.lookup, b.entity_id, b.name, (SELECT coalesce(string_agg(fw, ',' ORDER BY fw), '') FROM f WHERE f.lookup = b.lookup) AS firewalls FROM best b""")
def observed_by(spark, sf_dir):
    _, entities, _, index = tables(spark, sf_dir)
    events = ad.events(spark, sf_dir)
    ids = events.select(F.col("source_ip").alias("lookup")).distinct()
    return op.observed_by(entities, index, events, ids, AS_OF, since=SINCE).withColumn("firewalls", F.array_join("firewalls", ","))
