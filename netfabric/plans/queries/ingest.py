"""Normalisers over lines rendered from the whole event table, one query per feed and one over all."""

from __future__ import annotations

from pyspark.sql import functions as F

from netfabric.functions import net
from netfabric.plans import adapter as ad
from netfabric.plans import lines
from netfabric.plans.adapter import DUCK, with_views
from netfabric.plans.normalise import normalise_events, route_feeds
from netfabric.plans.queries import REGISTRY
from netfabric.plans.queries.metrics import KEY, duck_hmac
from netfabric.sources import redact, syslog
from netfabric.sources.junos_audit import normalise_junos_audit
from netfabric.sources.panos import normalise_panos
from netfabric.sources.proxmox import normalise_proxmox
from netfabric.sources.readers import parse_evidence
from netfabric.sources.srx import normalise_srx
from netfabric.sources.unifi import normalise_unifi

EV = f"""{with_views(DUCK, "net_events")}, b AS (SELECT e.*, v.event_type AS t, e.event_no AS n, coalesce(e.network_bytes, 0) AS sent, e.event_no % 1000 AS got,
  date_trunc('millisecond', e.timestamp) AS ms FROM net_events e JOIN events v ON v.event_id = e.event_no)"""


def _ext(name: str):
    return F.coalesce(F.col("ext")[name], F.lit(""))


def _cats():
    return F.array_join("event_category", ",").alias("category")


@REGISTRY.add("parse_syslog_header", f"""{EV} SELECT 14 AS priority, ms AS header_ts, CASE WHEN n % 11 = 0 THEN 'vsrx-br01x.lab' ELSE 'vsrx-br0' || CAST(n % 3 + 1 AS VARCHAR) || '.lab' END AS hostname,
  'RT_FLOW' AS appname, CASE t WHEN 'view' THEN 'RT_FLOW_SESSION_CREATE' WHEN 'click' THEN 'RT_FLOW_SESSION_CLOSE' WHEN 'purchase' THEN 'APPTRACK_SESSION_CLOSE'
  WHEN 'signup' THEN 'RT_SCREEN_TCP' ELSE 'RT_FLOW_SESSION_DENY' END AS msgid, count(*) AS c FROM b GROUP BY ALL
UNION ALL SELECT NULL, date_trunc('second', ms), 'controller', NULL, NULL, count(*) FROM b GROUP BY ALL""")
def parse_syslog_header(spark, sf_dir):
    raw = lines.srx_lines(spark, sf_dir).unionByName(lines.unifi_lines(spark, sf_dir))
    df = syslog.parse_syslog_header(raw).filter("parsed")
    # A legacy header's program name ends before a bracket; CEF lines look like one.
    return df.withColumn("appname", F.when(F.col("appname") != "CEF", F.col("appname"))).groupBy(
        "priority", "header_ts", "hostname", "appname", "msgid").agg(F.count(F.lit(1)).alias("c"))


@REGISTRY.add("route_feeds", """SELECT * FROM (SELECT 'srx' AS route, count(*) AS n FROM events UNION ALL SELECT 'panos', count(*) FROM events
UNION ALL SELECT 'unifi', count(*) FROM events UNION ALL SELECT 'proxmox', count(*) FROM events UNION ALL SELECT 'junos_audit', 2 * count(*) FROM events)""")
def route_feeds_counts(spark, sf_dir):
    out = None
    for name, df in route_feeds(lines.all_lines(spark, sf_dir)).items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("route"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@REGISTRY.add("structured_data_map", f"""{EV} SELECT n, 12 AS fields, rule_name AS policy, coalesce(destination_ip, 'fe80::1') AS dst FROM b""")
def structured_data_map(spark, sf_dir):
    m = syslog.structured_data_map(F.col("structured_data"))
    df = syslog.parse_syslog_header(lines.srx_lines(spark, sf_dir)).select(F.col("event_no").alias("n"), m.alias("m"))
    return df.select("n", F.size("m").alias("fields"), F.col("m")["policy-name"].alias("policy"), F.col("m")["destination-address"].alias("dst"))


@REGISTRY.add("normalise_srx", f"""{EV} SELECT ms AS timestamp, CASE t WHEN 'view' THEN 'flow_session_create' WHEN 'click' THEN 'flow_session_close' WHEN 'purchase' THEN 'unknown'
    WHEN 'signup' THEN 'screen_syn_flood_' || CAST(n % 4 AS VARCHAR) ELSE 'flow_session_deny' END AS event_action,
  CASE t WHEN 'view' THEN 'success' WHEN 'click' THEN 'success' WHEN 'purchase' THEN 'unknown' ELSE 'failure' END AS event_outcome,
  CASE WHEN t = 'signup' THEN 'alert' ELSE 'event' END AS event_kind, CASE WHEN t = 'signup' THEN 'network,intrusion_detection' ELSE 'network' END AS category,
  source_ip, source_port, sent AS source_bytes, destination_ip, destination_port, got AS destination_bytes, network_transport, sent + got AS network_bytes, rule_name,
  observer_ingress_zone, observer_egress_zone, CASE WHEN n % 11 = 0 THEN '' ELSE 'vsrx-br0' || CAST(n % 3 + 1 AS VARCHAR) || '.lab' END AS observer_hostname,
  CASE WHEN n % 4 = 0 THEN '' ELSE user_name END AS user_name FROM b""")
def srx(spark, sf_dir):
    df = normalise_srx(lines.srx_lines(spark, sf_dir), ("vsrx-br01", "vsrx-br02", "vsrx-br03"))
    return df.select(
        "timestamp", "event_action", "event_outcome", "event_kind", _cats(), "source_ip", "source_port", "source_bytes", "destination_ip", "destination_port",
        "destination_bytes", "network_transport", "network_bytes", "rule_name", "observer_ingress_zone", "observer_egress_zone", "observer_hostname", "user_name",
    )


@REGISTRY.add("normalise_panos", f"""{EV}, f AS (SELECT *, t IN ('view', 'click', 'purchase') AS flow FROM b) SELECT date_trunc('second', ms) AS timestamp,
  CASE t WHEN 'view' THEN 'flow_start' WHEN 'click' THEN 'flow_end' WHEN 'purchase' THEN 'threat_url' WHEN 'signup' THEN 'config_0' ELSE 'system_general' END AS event_action,
  CASE WHEN NOT flow THEN 'unknown' WHEN n % 3 = 0 THEN 'failure' ELSE 'success' END AS event_outcome,
  CASE t WHEN 'purchase' THEN 'network,intrusion_detection' WHEN 'signup' THEN 'configuration' WHEN 'error' THEN 'host' ELSE 'network' END AS category,
  CASE WHEN flow THEN source_ip END AS source_ip, CASE WHEN flow THEN source_port END AS source_port, CASE WHEN flow THEN destination_ip END AS destination_ip,
  CASE WHEN flow THEN destination_port END AS destination_port, CASE WHEN flow THEN network_transport ELSE '' END AS network_transport,
  CASE WHEN t IN ('view', 'click') THEN sent + got END AS network_bytes, CASE WHEN t IN ('view', 'click') THEN sent END AS source_bytes,
  CASE WHEN flow THEN rule_name ELSE '' END AS rule_name, CASE WHEN t = 'signup' THEN user_name ELSE '' END AS user_name, 'panosvm' AS observer_hostname,
  CASE t WHEN 'purchase' THEN 'critical' WHEN 'error' THEN 'high' ELSE '' END AS severity, CASE WHEN flow THEN '192.0.2.9' WHEN t = 'signup' THEN user_name ELSE user_name END AS nat_dst,
  CASE WHEN t = 'signup' THEN 'set' ELSE '' END AS command FROM f""")
def panos(spark, sf_dir):
    df = normalise_panos(lines.panos_lines(spark, sf_dir))
    return df.select(
        "timestamp", "event_action", "event_outcome", _cats(), "source_ip", "source_port", "destination_ip", "destination_port", "network_transport", "network_bytes",
        "source_bytes", "rule_name", "user_name", "observer_hostname", _ext("panw.panos.severity").alias("severity"),
        _ext("panw.panos.nat_destination_ip").alias("nat_dst"), _ext("panw.panos.command").alias("command"),
    )


@REGISTRY.add("normalise_unifi", f"""{EV} SELECT ms AS timestamp, 'alert_scanning-activity-' || t AS event_action, CASE WHEN n % 2 = 0 THEN 'failure' ELSE 'detection' END AS event_outcome,
  'alert' AS event_kind, source_port, destination_ip, destination_port, network_transport, sent AS network_bytes, 'Gateway Max' AS observer_hostname,
  'ET SCAN a=b number ' || CAST(n AS VARCHAR) AS signature, CASE WHEN destination_ip IS NULL THEN 'fe80::2' ELSE '' END AS dst_addr FROM b WHERE n % 7 <> 0""")
def unifi(spark, sf_dir):
    df = normalise_unifi(lines.unifi_lines(spark, sf_dir))
    return df.select(
        "timestamp", "event_action", "event_outcome", "event_kind", "source_port", "destination_ip", "destination_port", "network_transport", "network_bytes",
        "observer_hostname", _ext("unifi.ips.signature").alias("signature"), _ext("unifi.dst_addr").alias("dst_addr"),
    )


@REGISTRY.add("parse_cef", f"""{EV} SELECT n, CASE WHEN n % 7 = 0 THEN 'Admin Login' ELSE 'Threat Detected' END AS name, '7' AS severity, 10 AS fields, 'Gateway Max' AS device FROM b""")
def parse_cef(spark, sf_dir):
    from netfabric.sources.unifi import parse_cef as op

    df = op(lines.unifi_lines(spark, sf_dir)).filter("cef_ok")
    return df.select(
        F.col("event_no").alias("n"), F.col("cef_name").alias("name"), F.col("cef_severity").alias("severity"), F.size("cef").alias("fields"),
        F.col("cef")["UNIFIdeviceName"].alias("device"),
    )


PVE_FAILED = "CASE t WHEN 'click' THEN user_name WHEN 'error' THEN user_name || '@pam' END"


@REGISTRY.add("normalise_proxmox", f"""{EV} SELECT ms AS timestamp, CASE t WHEN 'purchase' THEN 'task_end_qmstart' WHEN 'click' THEN 'auth_failure' WHEN 'error' THEN 'auth_failure' ELSE 'auth_success' END AS event_action,
  CASE WHEN t IN ('click', 'error') OR (t = 'purchase' AND n % 2 <> 0) THEN 'failure' ELSE 'success' END AS event_outcome,
  CASE t WHEN 'purchase' THEN 'configuration' ELSE 'authentication' END AS category, CASE WHEN t IN ('view', 'click') THEN source_ip END AS source_ip,
  CASE WHEN t IN ('view', 'click') THEN source_port END AS source_port,
  CASE t WHEN 'view' THEN user_name WHEN 'purchase' THEN user_name || '@pam' WHEN 'signup' THEN user_name || '@pve' ELSE {duck_hmac(PVE_FAILED)} END AS user_name,
  CASE t WHEN 'purchase' THEN 'pam' WHEN 'signup' THEN 'pve' ELSE '' END AS realm, CASE t WHEN 'error' THEN '::ffff:10.9.9.9' ELSE '' END AS peer,
  CASE t WHEN 'purchase' THEN CASE WHEN n % 2 = 0 THEN 'OK' ELSE 'unexpected status' END ELSE '' END AS status, t IN ('click', 'error') AS hashed
FROM b WHERE n % 7 <> 0""")
def proxmox(spark, sf_dir):
    df = normalise_proxmox(lines.proxmox_lines(spark, sf_dir), KEY)
    return df.select(
        "timestamp", "event_action", "event_outcome", _cats(), "source_ip", "source_port", "user_name", _ext("proxmox.realm").alias("realm"),
        _ext("proxmox.source_addr").alias("peer"), _ext("proxmox.task_status").alias("status"), F.col("raw").contains(redact.HASHED).alias("hashed"),
    )


SECRET_VALUE = """CASE WHEN n % 3 = 2 THEN '{v}pw-' || CAST(n AS VARCHAR) || '{q}' ELSE '[REDACTED]' END"""
BQ = chr(92) + '"q'
SHOWN_PATH = "CASE n % 3 WHEN 0 THEN '[snmp community [REDACTED] authorization]' WHEN 1 THEN '[system radius-server 192.0.2.1 secret]' ELSE '[interfaces ge-0/0/0 mtu]' END"


@REGISTRY.add("normalise_junos_audit", f"""{EV} SELECT ms AS timestamp, CASE t WHEN 'view' THEN 'configuration_commit' WHEN 'click' THEN 'configuration_change' WHEN 'purchase' THEN 'auth_failure' ELSE 'auth_login' END AS event_action,
  CASE WHEN t = 'purchase' THEN 'failure' ELSE 'success' END AS event_outcome, CASE WHEN t IN ('view', 'click') THEN 'configuration' ELSE 'authentication' END AS category,
  CASE WHEN t = 'purchase' THEN source_ip END AS source_ip, 'vsrx-ci' AS observer_hostname, CASE WHEN t = 'purchase' THEN {duck_hmac("user_name")} ELSE user_name END AS user_name,
  CASE WHEN t = 'view' THEN 'change ' || CAST(n AS VARCHAR) ELSE '' END AS commit_message, CASE WHEN t = 'click' THEN {SHOWN_PATH} ELSE '' END AS path,
  CASE WHEN t = 'click' THEN {SECRET_VALUE.format(v="old-", q="")} ELSE '' END AS old_value, CASE WHEN t = 'click' THEN {SECRET_VALUE.format(v="", q=BQ)} ELSE '' END AS new_value,
  t = 'click' AND n % 3 = 2 AS secret_left, false AS marker_left, false AS community_left FROM b WHERE t <> 'error'""")
def junos_audit(spark, sf_dir):
    df = normalise_junos_audit(lines.junos_lines(spark, sf_dir), KEY)
    return df.select(
        "timestamp", "event_action", "event_outcome", _cats(), "source_ip", "observer_hostname", "user_name", _ext("junos.sys.commit_message").alias("commit_message"),
        _ext("junos.sys.pathname").alias("path"), _ext("junos.sys.data").alias("old_value"), _ext("junos.sys.value").alias("new_value"),
        F.col("raw").contains("pw-").alias("secret_left"), F.col("raw").contains("$9$").alias("marker_left"), F.col("raw").contains("name-").alias("community_left"),
    )


@REGISTRY.add("normalise_events", f"""{EV}, k AS (SELECT *, t IN ('view', 'click', 'purchase') AS flow FROM b)
SELECT 'juniper' AS event_provider, CASE t WHEN 'view' THEN 'flow_session_create' WHEN 'click' THEN 'flow_session_close' WHEN 'purchase' THEN 'unknown'
    WHEN 'signup' THEN 'screen_syn_flood_' || CAST(n % 4 AS VARCHAR) ELSE 'flow_session_deny' END AS event_action, count(*) AS events, CAST(sum(sent + got) AS BIGINT) AS bytes FROM k GROUP BY ALL
UNION ALL SELECT 'paloalto', CASE t WHEN 'view' THEN 'flow_start' WHEN 'click' THEN 'flow_end' WHEN 'purchase' THEN 'threat_url' WHEN 'signup' THEN 'config_0' ELSE 'system_general' END, count(*),
  CAST(sum(CASE WHEN t IN ('view', 'click') THEN sent + got END) AS BIGINT) FROM k GROUP BY ALL
UNION ALL SELECT 'unifi', 'alert_scanning-activity-' || t, count(*), CAST(sum(sent) AS BIGINT) FROM k WHERE n % 7 <> 0 GROUP BY ALL
UNION ALL SELECT 'proxmox', CASE t WHEN 'purchase' THEN 'task_end_qmstart' WHEN 'click' THEN 'auth_failure' WHEN 'error' THEN 'auth_failure' ELSE 'auth_success' END, count(*), NULL FROM k WHERE n % 7 <> 0 GROUP BY ALL
UNION ALL SELECT 'juniper', CASE t WHEN 'view' THEN 'configuration_commit' WHEN 'click' THEN 'configuration_change' WHEN 'purchase' THEN 'auth_failure' ELSE 'auth_login' END, count(*), NULL FROM k WHERE t <> 'error' GROUP BY ALL""")
def all_feeds(spark, sf_dir):
    df = normalise_events(lines.all_lines(spark, sf_dir), KEY)
    return df.groupBy("event_provider", "event_action").agg(F.count(F.lit(1)).alias("events"), F.sum("network_bytes").alias("bytes"))


@REGISTRY.add("known_device_gate", f"""{EV} SELECT n, CASE WHEN n % 11 = 0 OR n % 3 = 2 THEN '' ELSE 'vsrx-br0' || CAST(n % 3 + 1 AS VARCHAR) || '.lab' END AS hostname FROM b""")
def known_device_gate(spark, sf_dir):
    devices = spark.createDataFrame([("vsrx-br01",), ("VSRX-br02",)], "device string")
    df = syslog.parse_syslog_header(lines.srx_lines(spark, sf_dir))
    return syslog.known_device_gate(df, devices).select(F.col("event_no").alias("n"), "hostname")


@REGISTRY.add("ipv4_or_null", f"""{EV}, a AS (SELECT n, CASE n % 5 WHEN 0 THEN source_ip WHEN 1 THEN '10.0.0.' || CAST(256 + n % 100 AS VARCHAR) WHEN 2 THEN 'fe80::' || CAST(n AS VARCHAR)
  WHEN 3 THEN source_ip || '.1' ELSE coalesce(destination_ip, '') END AS v FROM b) SELECT n, v, CASE WHEN n % 5 = 0 OR (n % 5 = 4 AND v <> '') THEN v END AS ip FROM a""")
def ipv4_or_null(spark, sf_dir):
    n, src = F.col("event_no"), F.col("source_ip")
    v = (
        F.when(n % 5 == 0, src).when(n % 5 == 1, F.concat(F.lit("10.0.0."), (256 + n % 100).cast("string")))
        .when(n % 5 == 2, F.concat(F.lit("fe80::"), n.cast("string"))).when(n % 5 == 3, F.concat(src, F.lit(".1"))).otherwise(F.coalesce("destination_ip", F.lit("")))
    )
    return ad.view(spark, sf_dir, "net_events").select(n.alias("n"), v.alias("v")).withColumn("ip", net.ipv4_or_null("v"))


@REGISTRY.add("hash_failed_user", f"""{EV} SELECT n, {duck_hmac("user_name")} AS user_hash, 'login ' || '[HASHED]' || ' denied' AS raw FROM b""")
def hash_failed_user(spark, sf_dir):
    df = ad.view(spark, sf_dir, "net_events").withColumn("line", F.concat(F.lit("login "), "user_name", F.lit(" denied")))
    return df.select(
        F.col("event_no").alias("n"), redact.hash_user(F.col("user_name"), KEY).alias("user_hash"), redact.scrub_user(F.col("line"), F.col("user_name")).alias("raw")
    )


# Config values come from whole document texts, so escapes and alphabets vary.
@REGISTRY.add("redact_config_secrets", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[REDACTED]' ELSE text END AS shown,
  CASE WHEN doc_id % 2 = 0 THEN 'value: [REDACTED] end' ELSE 'value: ' || text || ' end' END AS raw FROM documents""")
def redact_config_secrets(spark, sf_dir):
    df = ad.table(spark, sf_dir, "documents").withColumns({
        "path": F.when(F.col("doc_id") % 2 == 0, "[security ike pre-shared-key ascii-text]").otherwise("[interfaces description]"),
        "line": F.concat(F.lit("value: "), "text", F.lit(" end")),
    })
    return df.select(
        "doc_id", redact.shown_value(F.col("path"), F.col("text")).alias("shown"),
        redact.redact_value(F.col("line"), F.col("path"), F.col("text")).alias("raw"),
    )


@REGISTRY.add("parse_evidence", f"""{with_views(DUCK, "audit_calls")} SELECT a.ts, 'srv-' || CAST(a.conv_id AS VARCHAR) AS server_id, 'run-' || CAST(a.conv_id AS VARCHAR) AS run_id, a.turn AS segment_seq FROM audit_calls a""")
def evidence(spark, sf_dir):
    return parse_evidence(ad.audit_rows(spark, sf_dir)).select("ts", "server_id", "run_id", "segment_seq")
