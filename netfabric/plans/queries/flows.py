"""Event questions over the whole event table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from netfabric.operators import flows as op
from netfabric.operators import upsert
from netfabric.plans import adapter as ad
from netfabric.plans.adapter import AS_OF, DUCK, SINCE, with_views
from netfabric.plans.queries import REGISTRY
from netfabric.session import shared_path
from netfabric.sources import writers

EV = with_views(DUCK, "net_events")
WINDOW = f"e.timestamp >= TIMESTAMP '{SINCE}'"
FLOW_COLS = ", ".join(f"e.{c}" for c in op.FLOW_COLUMNS)


@REGISTRY.add("query_flows", f"""{EV}
SELECT {FLOW_COLS} FROM net_events e
WHERE {WINDOW} AND e.timestamp <= TIMESTAMP '{AS_OF}' AND e.event_provider = 'juniper' AND e.destination_port = 443
  AND (e.observer_ingress_zone = 'zone-1' OR e.observer_egress_zone = 'zone-1')
ORDER BY e.timestamp DESC, e.event_id LIMIT 100""")
def query_flows(spark, sf_dir):
    return op.query_flows(
        ad.events(spark, sf_dir), AS_OF, provider="juniper", dst_port=443, zone="zone-1", since=SINCE, limit=100
    )


@REGISTRY.add("query_flows_all", f"""{EV}
SELECT {FLOW_COLS} FROM net_events e WHERE {WINDOW} AND e.timestamp <= TIMESTAMP '{AS_OF}'""")
def query_flows_all(spark, sf_dir):
    return op.query_flows(ad.events(spark, sf_dir), AS_OF, since=SINCE, limit=None)


@REGISTRY.add("top_talkers_all", f"""{EV}
SELECT e.source_ip AS ip, CAST(sum(e.network_bytes) AS BIGINT) AS bytes, count(*) AS flows FROM net_events e
WHERE {WINDOW} AND e.source_ip IS NOT NULL GROUP BY e.source_ip""")
def top_talkers_all(spark, sf_dir):
    return op.top_talkers(ad.events(spark, sf_dir), AS_OF, since=SINCE, limit=None)


@REGISTRY.add("column_values", f"""{EV}
SELECT DISTINCT 'source_ip' AS "column", e.source_ip AS value FROM net_events e WHERE e.source_ip IS NOT NULL
UNION SELECT DISTINCT 'event_action', e.event_action FROM net_events e WHERE e.event_action IS NOT NULL""")
def column_values(spark, sf_dir):
    return op.column_values(ad.events(spark, sf_dir), ["source_ip", "event_action"])


@REGISTRY.add("event_table", f"""{EV}
SELECT CAST(CAST(e.timestamp AS DATE) AS VARCHAR) AS event_date, e.event_provider AS provider, count(*) AS n, count(DISTINCT e.event_id) AS ids FROM net_events e GROUP BY ALL""")
def event_table(spark, sf_dir):
    """Events written to a table by day, a slice moved by a day and back, and read again."""
    path = shared_path(spark, "events")
    writers.write_events(ad.events(spark, sf_dir), path)
    for hours in (24, -24):
        upsert.backfill_table(spark, path, "timestamp", F.col("event_provider") == "juniper", timedelta(hours=hours))
    events = spark.read.parquet(path)
    return events.groupBy(F.col("event_date").cast("string").alias("event_date"), F.col("event_provider").alias("provider")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@REGISTRY.add("top_talkers", f"""{EV}
SELECT e.source_ip AS ip, CAST(sum(e.network_bytes) AS BIGINT) AS bytes, count(*) AS flows FROM net_events e
WHERE {WINDOW} AND e.source_ip IS NOT NULL GROUP BY e.source_ip ORDER BY bytes DESC NULLS LAST, ip LIMIT 20""")
def top_talkers(spark, sf_dir):
    return op.top_talkers(ad.events(spark, sf_dir), AS_OF, since=SINCE, limit=20)


@REGISTRY.add("top_talkers_by_flows", f"""{EV}
SELECT e.destination_ip AS ip, CAST(sum(e.network_bytes) AS BIGINT) AS bytes, count(*) AS flows FROM net_events e
WHERE {WINDOW} AND e.destination_ip IS NOT NULL GROUP BY e.destination_ip ORDER BY flows DESC, ip LIMIT 10""")
def top_talkers_by_flows(spark, sf_dir):
    return op.top_talkers(ad.events(spark, sf_dir), AS_OF, by="flows", side="dst", since=SINCE, limit=10)


@REGISTRY.add("describe_events", f"""{EV}
SELECT count(*) AS row_count, min(e.timestamp) AS earliest, max(e.timestamp) AS latest,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT event_action v FROM net_events)) AS actions,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT event_outcome v FROM net_events)) AS outcomes,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT event_provider v FROM net_events)) AS providers,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT observer_ingress_zone v FROM net_events UNION SELECT observer_egress_zone FROM net_events)) AS zones,
  false AS truncated
FROM net_events e""")
def describe_events(spark, sf_dir):
    df = op.describe(ad.events(spark, sf_dir))
    return df.select(
        "row_count", "earliest", "latest",
        *[F.array_join(c, ",").alias(c) for c in ("actions", "outcomes", "providers", "zones")], "truncated",
    )


@REGISTRY.add("describe_columns", """
SELECT * FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'),
  ('value', 'double'), ('props', 'string')) t(name, type)""")
def describe_columns(spark, sf_dir):
    return op.describe_columns(ad.table(spark, sf_dir, "events"))


@REGISTRY.add("adhoc_sql", f"""{EV}
SELECT e.event_provider AS provider, e.event_action AS action, count(*) AS n, CAST(sum(e.network_bytes) AS BIGINT) AS bytes
FROM net_events e GROUP BY e.event_provider, e.event_action""")
def adhoc_sql(spark, sf_dir):
    return op.adhoc_sql(
        spark,
        "SELECT event_provider AS provider, event_action AS action, count(*) AS n, sum(network_bytes) AS bytes"
        " FROM net_events GROUP BY event_provider, event_action",
        {"net_events": ad.events(spark, sf_dir)}, max_rows=100_000,
    )


TOTALS = """count(*) AS event_count, CAST(sum(e.network_bytes) AS BIGINT) AS total_bytes,
  strftime(min(e.timestamp), '%Y-%m-%d') AS earliest_date, CAST(epoch(max(e.timestamp)) AS BIGINT) AS newest_epoch"""


@REGISTRY.add("window_totals", f"{EV} SELECT {TOTALS} FROM net_events e WHERE {WINDOW}".replace(
    "CAST(epoch(max(e.timestamp)) AS BIGINT)", "CAST(floor(epoch(max(e.timestamp))) AS BIGINT)"))
def window_totals(spark, sf_dir):
    return op.window_totals(ad.events(spark, sf_dir), AS_OF, since=SINCE).withColumn(
        "earliest_date", F.col("earliest_date").cast("string")
    )


@REGISTRY.add("window_totals_by_provider", f"""{EV} SELECT e.event_provider, {TOTALS} FROM net_events e WHERE {WINDOW}
GROUP BY e.event_provider""".replace(
    "CAST(epoch(max(e.timestamp)) AS BIGINT)", "CAST(floor(epoch(max(e.timestamp))) AS BIGINT)"))
def window_totals_by_provider(spark, sf_dir):
    return op.window_totals(ad.events(spark, sf_dir), AS_OF, since=SINCE, by_provider=True).withColumn(
        "earliest_date", F.col("earliest_date").cast("string")
    )


SEVERITY = """CASE WHEN e.ids_severity IS NOT NULL THEN CASE e.ids_severity WHEN '1' THEN 'critical' WHEN '2' THEN 'high' ELSE 'medium' END
  WHEN e.pan_severity IS NOT NULL THEN CASE WHEN lower(e.pan_severity) IN ('critical', 'high', 'medium', 'low') THEN lower(e.pan_severity)
    WHEN lower(e.pan_severity) = 'informational' THEN 'low' ELSE 'medium' END
  WHEN TRY_CAST(e.syslog_severity AS INT) IS NOT NULL THEN CASE WHEN TRY_CAST(e.syslog_severity AS INT) <= 2 THEN 'critical'
    WHEN TRY_CAST(e.syslog_severity AS INT) = 3 THEN 'high' WHEN TRY_CAST(e.syslog_severity AS INT) = 4 THEN 'medium' ELSE 'low' END
  WHEN e.event_kind = 'alert' THEN 'medium' END"""
SEV_NUM = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END"


@REGISTRY.add("normalise_severity", f"""{EV}, s AS (SELECT e.event_provider, e.event_kind, {SEVERITY} AS severity FROM net_events e)
SELECT event_provider, event_kind, severity, {SEV_NUM} AS severity_num, count(*) AS n FROM s GROUP BY ALL""")
def normalise_severity(spark, sf_dir):
    graded = op.normalise_severity(ad.events(spark, sf_dir))
    return graded.groupBy("event_provider", "event_kind", "severity", "severity_num").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add("recent_alerts", f"""{EV}, s AS (SELECT e.*, {SEVERITY} AS severity FROM net_events e
  WHERE {WINDOW} AND (e.event_kind = 'alert' OR coalesce(e.ids_signature, '') <> '' OR coalesce(e.pan_severity, '') <> '')),
g AS (SELECT *, {SEV_NUM} AS severity_num FROM s)
SELECT g.event_id, g.timestamp, g.event_provider AS provider, g.event_kind,
  coalesce(nullif(g.ids_signature, ''), nullif(g.rule_name, ''), g.event_kind) AS signature, g.severity, g.severity_num,
  g.source_ip, g.source_port, g.destination_ip, g.destination_port, g.observer_hostname AS observer,
  g.observer_ingress_zone AS ingress_zone, g.observer_egress_zone AS egress_zone,
  concat_ws(';', 'panw.panos.severity=' || g.pan_severity, 'syslog.severity=' || g.syslog_severity,
    'unifi.ips.severity=' || g.ids_severity, 'unifi.ips.signature=' || g.ids_signature) AS ext_subset
FROM g WHERE severity_num >= 3 ORDER BY g.timestamp DESC, g.event_id LIMIT 500""")
def recent_alerts(spark, sf_dir):
    df = op.recent_alerts(ad.events(spark, sf_dir), AS_OF, since=SINCE, min_severity="high", limit=500)
    entries = F.transform(F.array_sort(F.map_entries("ext_subset")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return df.withColumn("ext_subset", F.array_join(entries, ";"))


@REGISTRY.add("alerts_for_ips", f"""{EV}, a AS (SELECT e.* FROM net_events e
  WHERE {WINDOW} AND e.event_provider = 'unifi' AND e.event_kind = 'alert'),
t AS (SELECT source_ip AS ip, event_id, a.timestamp AS seen, ids_severity, ids_signature FROM a
  UNION SELECT destination_ip, event_id, a.timestamp, ids_severity, ids_signature FROM a WHERE destination_ip IS NOT NULL),
w AS (SELECT DISTINCT source_ip AS ip FROM net_events),
r AS (SELECT t.*, row_number() OVER (PARTITION BY t.ip ORDER BY t.seen DESC, t.event_id) AS rn FROM t JOIN w ON w.ip = t.ip)
SELECT ip AS ip_key, event_id, seen AS timestamp, coalesce(ids_severity, '') AS severity, coalesce(ids_signature, '') AS signature
FROM r WHERE rn <= 5""")
def alerts_for_ips(spark, sf_dir):
    ev = ad.events(spark, sf_dir)
    ips = ev.select(F.col("source_ip").alias("ip")).distinct()
    df = op.alerts_for_ips(ev, ips, AS_OF, since=SINCE, limit=5)
    return df.select("ip_key", "event_id", "timestamp", "severity", "signature")


@REGISTRY.add("observers_for_ips", f"""{EV}, w AS (SELECT DISTINCT source_ip AS ip FROM net_events)
SELECT DISTINCT w.ip AS ip_key, e.observer_hostname FROM net_events e JOIN w ON w.ip = e.source_ip WHERE e.observer_hostname <> ''
UNION SELECT w.ip, e.observer_hostname FROM net_events e JOIN w ON w.ip = e.destination_ip WHERE e.observer_hostname <> ''""")
def observers_for_ips(spark, sf_dir):
    ev = ad.events(spark, sf_dir)
    ips = ev.select(F.col("source_ip").alias("ip")).distinct()
    return op.observers_for_ips(ev, ips, AS_OF, since=SINCE)


@REGISTRY.add("short_host", f"""{EV}
SELECT split_part(e.observer_hostname, '.', 1) AS host, e.source_ip AS address, count(*) AS n FROM net_events e GROUP BY ALL""")
def short_host(spark, sf_dir):
    from netfabric.functions.net import short_host as expr

    return ad.events(spark, sf_dir).groupBy(
        expr("observer_hostname").alias("host"), expr("source_ip").alias("address")
    ).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add("busiest_pair", f"""{EV}, c AS (SELECT split_part(e.observer_hostname, '.', 1) AS device, e.source_ip, e.destination_ip, count(*) AS flows
  FROM net_events e WHERE e.source_ip IS NOT NULL AND e.destination_ip IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY flows DESC, source_ip, destination_ip) AS rn FROM c)
SELECT device, source_ip || '->' || destination_ip AS pair, flows FROM r WHERE rn = 1""")
def busiest_pair(spark, sf_dir):
    return op.busiest_pair(ad.events(spark, sf_dir), AS_OF, since=SINCE)


@REGISTRY.add("top_destination_ports", f"""{EV}
SELECT e.destination_port, count(*) AS flows FROM net_events e GROUP BY e.destination_port ORDER BY flows DESC, e.destination_port LIMIT 3""")
def top_destination_ports(spark, sf_dir):
    return op.top_destination_ports(ad.events(spark, sf_dir), AS_OF, since=SINCE)


@REGISTRY.add("distinct_providers", f"{EV} SELECT DISTINCT e.event_provider FROM net_events e")
def distinct_providers(spark, sf_dir):
    return op.distinct_values(ad.events(spark, sf_dir), "event_provider", AS_OF, since=SINCE)


@REGISTRY.add("distinct_actions", f"{EV} SELECT DISTINCT e.event_action FROM net_events e WHERE e.event_provider = 'paloalto'")
def distinct_actions(spark, sf_dir):
    return op.distinct_values(ad.events(spark, sf_dir), "event_action", AS_OF, since=SINCE, provider="paloalto")


@REGISTRY.add("alert_providers", f"""{EV} SELECT DISTINCT e.event_provider FROM net_events e
WHERE e.event_kind = 'alert' OR coalesce(e.ids_signature, '') <> '' OR coalesce(e.pan_severity, '') <> ''""")
def alert_providers(spark, sf_dir):
    return op.distinct_values(ad.events(spark, sf_dir), "event_provider", AS_OF, since=SINCE, only_alerts=True)


@REGISTRY.add("newest_rule_per_pair", f"""{EV}
SELECT e.source_ip, e.destination_ip, arg_max(e.rule_name, (e.timestamp, e.event_id)) AS rule_name FROM net_events e
WHERE e.rule_name <> '' AND e.source_ip IS NOT NULL AND e.destination_ip IS NOT NULL GROUP BY ALL""")
def newest_rule_per_pair(spark, sf_dir):
    return op.newest_rule_per_pair(ad.events(spark, sf_dir))


@REGISTRY.add("evidence_chain", f"""{with_views(DUCK, "audit_calls")}
SELECT 'run-' || CAST(a.conv_id AS VARCHAR) AS run_id, a.ts, a.tool, a.principal, a.args FROM audit_calls a WHERE a.tier = 'evidence'""")
def evidence_chain(spark, sf_dir):
    rows = ad.audit_rows(spark, sf_dir).withColumn("row_hash", F.sha1("args")).withColumn("prev_hash", F.lit(""))
    return op.evidence_chain(rows).select("run_id", "ts", "tool", "principal", "args")
