"""Snapshot parsers over device outputs rendered from whole tables, one body per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.plans import adapter as ad
from netfabric.plans.queries import REGISTRY
from netfabric.sources import gauges, rulebases, snapshots

TAKEN = "2024-01-30 00:00:00"


def s(*parts) -> Column:
    """Concatenation of texts and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def bodies(df: DataFrame, provider: str, command: str, device: Column, body: Column, truncated: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(provider).alias("provider"), device.alias("device"), F.lit(command).alias("command"), F.lit(TAKEN).cast("timestamp").alias("collected_at"),
        (F.lit(False) if truncated is None else truncated).alias("truncated"), body.alias("body"),
    )


def _table(spark, sf_dir, name, key):
    return ad.spread(ad.table(spark, sf_dir, name)).withColumn("k", F.col(key))


# Functions, as a column needs a running session and this module is imported without one.
def key() -> Column:
    return F.col("k")


def mac() -> Column:
    return s("02:00:00:00:", F.lpad((key() % 90 + 10).cast("string"), 2, "0"), ":", F.lpad((key() % 77 + 10).cast("string"), 2, "0"))


MAC_SQL = "'02:00:00:00:' || CAST({k} % 90 + 10 AS VARCHAR) || ':' || CAST({k} % 77 + 10 AS VARCHAR)"
OBS = ("observation_type", "source_device", "subj_id", "obj_id")


def _arp_bodies(spark, sf_dir):
    df = _table(spark, sf_dir, "orders", "o_orderkey")
    body = s("MAC Address       Address         Interface     Flags\n", mac(), " 10.0.0.", F.col("o_custkey") % 250, " ge-0/0/", key() % 8, ".0 none\n\nTotal entries: 1\n")
    return bodies(df, "juniper", "show arp no-resolve", s("fw-", key() % 5), body, key() % 50 == 0)


ARP_ROWS = f"""SELECT 'arp_entry' AS observation_type, 'fw-' || CAST(o_orderkey % 5 AS VARCHAR) AS source_device, 'ip:10.0.0.' || CAST(o_custkey % 250 AS VARCHAR) AS subj_id,
  'mac:' || {MAC_SQL.format(k="o_orderkey")} AS obj_id, 'ge-0/0/' || CAST(o_orderkey % 8 AS VARCHAR) || '.0' AS interface FROM orders WHERE o_orderkey % 50 <> 0"""


@REGISTRY.add("arp_from_text", ARP_ROWS)
def arp_from_text(spark, sf_dir):
    df = snapshots.arp_from_text(snapshots.complete(_arp_bodies(spark, sf_dir)))
    return df.select(*OBS, F.col("attrs")["interface"].alias("interface"))


@REGISTRY.add("rejected_snapshots", """SELECT 'juniper' AS provider, 'fw-' || CAST(o_orderkey % 5 AS VARCHAR) AS device, 'show arp no-resolve' AS command, count(*) AS rejected
FROM orders WHERE o_orderkey % 50 = 0 GROUP BY ALL""")
def rejected_snapshots(spark, sf_dir):
    return snapshots.rejected(_arp_bodies(spark, sf_dir))


@REGISTRY.add("lldp_from_text", """SELECT 'lldp_neighbor' AS observation_type, 'sw-' || CAST(c_custkey % 7 AS VARCHAR) AS source_device, 'if:sw-' || CAST(c_custkey % 7 AS VARCHAR) || ':ge-0/0/' || CAST(c_custkey AS VARCHAR) AS subj_id,
  'if:host-' || CAST(c_custkey AS VARCHAR) || ':' || CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE 'Port ' || CAST(c_custkey % 48 AS VARCHAR) || ' ' || lower(c_mktsegment) END AS obj_id FROM customer""")
def lldp_from_text(spark, sf_dir):
    df = _table(spark, sf_dir, "customer", "c_custkey")
    port = F.when(key() % 4 == 0, F.lit("")).otherwise(s("Port ", key() % 48, " ", F.lower("c_mktsegment"), " "))
    body = s("Local Interface    Parent Interface    Chassis Id     Port info    System Name\nge-0/0/", key(), "  -  02:00:00:00:00:01  ", port, " host-", key(), "\n")
    return snapshots.lldp_from_text(bodies(df, "juniper", "show lldp neighbors", s("sw-", key() % 7), body)).select(*OBS)


@REGISTRY.add("mac_table_from_text", f"""SELECT 'mac_entry' AS observation_type, 'sw-' || CAST(c_custkey % 7 AS VARCHAR) AS source_device, 'mac:' || {MAC_SQL.format(k="c_custkey")} AS subj_id,
  'device:sw-' || CAST(c_custkey % 7 AS VARCHAR) AS obj_id, 'vlan' || CAST(c_nationkey AS VARCHAR) AS vlan FROM customer""")
def mac_table_from_text(spark, sf_dir):
    df = _table(spark, sf_dir, "customer", "c_custkey")
    body = s("MAC flags (S - static)\n\nVlan  MAC  address  age  interface\nvlan", F.col("c_nationkey"), "  ", mac(), "  D  -  ge-0/0/1.0\n")
    out = snapshots.mac_table_from_text(bodies(df, "juniper", "show ethernet-switching table", s("sw-", key() % 7), body))
    return out.select(*OBS, F.col("attrs")["vlan"].alias("vlan"))


@REGISTRY.add("arp_from_xml", f"""SELECT 'arp_entry' AS observation_type, 'pan-' || CAST(o_orderkey % 3 AS VARCHAR) AS source_device, 'ip:10.0.0.' || CAST(o_custkey % 250 AS VARCHAR) AS subj_id,
  'mac:' || {MAC_SQL.format(k="o_orderkey")} AS obj_id FROM orders WHERE o_orderkey % 6 <> 0""")
def arp_from_xml(spark, sf_dir):
    df = _table(spark, sf_dir, "orders", "o_orderkey")
    shown = F.when(key() % 6 == 0, F.lit("(incomplete)")).otherwise(mac())
    xml = s("<response><result><entries><entry><status> c </status><ip>10.0.0.", F.col("o_custkey") % 250, "</ip><mac>", shown, "</mac><interface>ethernet1/", key() % 9, "</interface></entry></entries></result></response>")
    body = F.to_json(F.struct(xml.alias("result")))
    return snapshots.arp_from_xml(bodies(df, "paloalto", "show arp all", s("pan-", key() % 3), body)).select(*OBS)


@REGISTRY.add("lldp_from_xml", """SELECT 'lldp_neighbor' AS observation_type, 'pan-' || CAST(s_suppkey % 3 AS VARCHAR) AS source_device, 'if:pan-' || CAST(s_suppkey % 3 AS VARCHAR) || ':ethernet1/' || CAST(s_suppkey AS VARCHAR) AS subj_id,
  'if:' || CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' ELSE s_name END || ':ge-' || CAST(s_suppkey AS VARCHAR) AS obj_id FROM supplier""")
def lldp_from_xml(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier", "s_suppkey")
    system = F.when(key() % 4 == 0, F.lit("")).otherwise(s("<system-name>", F.col("s_name"), "</system-name>"))
    body = s('<r><entry name="ethernet1/', key(), '">', system, "<port-id>ge-", key(), "</port-id></entry></r>")
    return snapshots.lldp_from_xml(bodies(df, "paloalto", "x", s("pan-", key() % 3), body)).select(*OBS)


@REGISTRY.add("clients_from_json", f"""WITH c AS (SELECT c_custkey AS k, {MAC_SQL.format(k="c_custkey")} AS mac, c_nationkey AS v FROM customer)
SELECT CASE WHEN k % 3 = 0 THEN 'wlan_assoc' ELSE 'mac_entry' END AS observation_type, 'mac:' || mac AS subj_id, 'device:02:ff:00:00:00:' || CAST(10 + v AS VARCHAR) AS obj_id, CAST(v AS VARCHAR) AS vlan FROM c WHERE k % 5 <> 0
UNION ALL SELECT 'arp_entry', 'ip:10.0.0.' || CAST(k % 250 AS VARCHAR), 'mac:' || mac, NULL FROM c""")
def clients_from_json(spark, sf_dir):
    df = _table(spark, sf_dir, "customer", "c_custkey")
    uplink = s("02:FF:00:00:00:", 10 + F.col("c_nationkey"))
    row = F.struct(
        F.upper(mac()).alias("mac"), s("10.0.0.", key() % 250).alias("ip"), (key() % 3 != 0).alias("is_wired"),
        F.when((key() % 5 != 0) & (key() % 3 != 0), uplink).alias("sw_mac"), F.when((key() % 5 != 0) & (key() % 3 == 0), uplink).alias("ap_mac"), F.col("c_nationkey").alias("vlan"),
    )
    body = F.to_json(F.struct(F.array(row).alias("result")))
    out = snapshots.clients_from_json(bodies(df, "unifi", "list active clients", F.lit("site"), body))
    return out.select("observation_type", "subj_id", "obj_id", F.col("attrs")["vlan"].alias("vlan"))


@REGISTRY.add("devices_from_json", f"""SELECT 'device_inventory' AS observation_type, 'device:' || {MAC_SQL.format(k="s_suppkey")} AS subj_id, s_name AS name,
  CASE s_suppkey % 4 WHEN 0 THEN 'switch' WHEN 1 THEN 'ap' WHEN 2 THEN 'gateway' ELSE 'device' END AS role FROM supplier""")
def devices_from_json(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier", "s_suppkey")
    model = F.when(key() % 4 == 0, "USW-24").when(key() % 4 == 1, "UAP-AC").when(key() % 4 == 2, "UDM-Pro").otherwise("other")
    body = F.to_json(F.array(F.struct(mac().alias("mac"), F.col("s_name").alias("name"), model.alias("model"))))
    out = snapshots.devices_from_json(bodies(df, "unifi", "list devices", F.lit("site"), body))
    return out.select("observation_type", "subj_id", F.col("attrs")["name"].alias("name"), F.col("attrs")["role"].alias("role"))


@REGISTRY.add("vms_from_snapshots", f"""SELECT 'vm_host' AS observation_type, 'device:pve' || CAST(c_nationkey AS VARCHAR) AS subj_id, 'vm:pve' || CAST(c_nationkey AS VARCHAR) || '/' || CAST(c_custkey AS VARCHAR) AS obj_id, c_name AS name FROM customer
UNION ALL SELECT 'vm_nic', 'mac:' || {MAC_SQL.format(k="c_custkey")}, 'device:pve' || CAST(c_nationkey AS VARCHAR) || ':vmbr' || CAST(c_custkey % 3 AS VARCHAR), c_name FROM customer""")
def vms_from_snapshots(spark, sf_dir):
    df = _table(spark, sf_dir, "customer", "c_custkey")
    node = s("pve", F.col("c_nationkey"))
    listing = bodies(df, "proxmox", "list vms", F.lit("pve"), s("[vm] ", F.col("c_name"), " (ID: ", key(), ")\n  - Status: running\n  - Node: ", node, "\n"))
    nic = s("virtio=", F.upper(mac()), ",bridge=vmbr", key() % 3, ",tag=20")
    configs = bodies(df, "proxmox", "vm config", s(node, "/", key()), F.to_json(F.struct(nic.alias("net0"), F.lit("4").alias("cores"))))
    out = snapshots.vms_from_snapshots(listing, configs)
    return out.select("observation_type", "subj_id", "obj_id", F.col("attrs")["name"].alias("name"))


@REGISTRY.add("firewall_inventory", "SELECT DISTINCT 'fw-' || CAST(o_orderkey % 5 AS VARCHAR) AS source_device, 'firewall' AS role FROM orders")
def firewall_inventory(spark, sf_dir):
    out = snapshots.firewall_inventory(_arp_bodies(spark, sf_dir))
    return out.select("source_device", F.col("attrs")["role"].alias("role"))


# ---------------------------------------------------------------- rules and objects

def _rule_bodies(spark, sf_dir):
    """Two rules per device: a zone-pair rule with several terms and a global one."""
    df = _table(spark, sf_dir, "part", "p_partkey")
    pre = s("set security policies from-zone z", F.col("p_size") % 3, " to-zone z", F.col("p_size") % 4, " policy rule-", key(), " ")
    action = F.when(F.col("p_size") % 2 == 0, "permit").otherwise("deny")
    off = F.when(key() % 9 == 0, F.lit("inactive: ")).otherwise(F.lit(""))
    body = s(
        pre, "match source-address any\n", pre, "match destination-address srv-", key(), "\n", pre, "match destination-address all\n", off, pre, "match application ", F.split_part("p_type", F.lit(" "), F.lit(1)), "\n",
        pre, "then ", action, "\n", pre, "then log session-init\n", "set security policies global policy last match from-zone edge\nset security policies global policy last then reject\n",
        F.when(key() % 4 == 0, F.lit("set security policies global policy last match vlan 7\n")).otherwise(F.lit("")),
    )
    return bodies(df, "juniper", "policies", s("fw-", key()), body)


RULE_ROWS = """SELECT 'fw-' || CAST(p_partkey AS VARCHAR) AS device_name, 'rule-' || CAST(p_partkey AS VARCHAR) AS rule_name, CASE WHEN p_size % 2 = 0 THEN 'allow' ELSE 'deny' END AS action,
  'z' || CAST(p_size % 3 AS VARCHAR) AS from_zone, 'z' || CAST(p_size % 4 AS VARCHAR) AS to_zone, 'srv-' || CAST(p_partkey AS VARCHAR) || ',all' AS dest, split_part(p_type, ' ', 1) AS app,
  0 AS position, p_partkey % 9 <> 0 AS enabled, false AS match_unknown FROM part
UNION ALL SELECT 'fw-' || CAST(p_partkey AS VARCHAR), 'last', 'reject', 'edge', 'any', '', '', 1, true, p_partkey % 4 = 0 FROM part"""


@REGISTRY.add("rules_from_text", RULE_ROWS)
def rules_from_text(spark, sf_dir):
    df = rulebases.rules_from_text(_rule_bodies(spark, sf_dir))
    j = lambda c: F.array_join(c, ",")
    return df.select(
        "device_name", "rule_name", "action", j("from_zone").alias("from_zone"), j("to_zone").alias("to_zone"), j("dest_addresses").alias("dest"),
        j("application").alias("app"), "position", "enabled", "match_unknown",
    )


@REGISTRY.add("rules_from_xml", """SELECT 'pan-' || CAST(p_partkey AS VARCHAR) AS device_name, 'r-' || CAST(p_partkey AS VARCHAR) AS rule_name, 'allow' AS action, 'trust' AS from_zone, p_brand || ',any' AS dest,
  0 AS position, p_partkey % 5 <> 0 AS enabled, p_partkey % 3 = 0 AS match_unknown, 'u-' || CAST(p_partkey AS VARCHAR) AS uuid FROM part
UNION ALL SELECT 'pan-' || CAST(p_partkey AS VARCHAR), 'final', 'deny', '', '', 1, true, false, '' FROM part""")
def rules_from_xml(spark, sf_dir):
    df = _table(spark, sf_dir, "part", "p_partkey")
    xml = s(
        "<config><zone><entry name='t'/></zone><rulebase><security><rules><entry name=\"r-", key(), "\" uuid=\"u-", key(), "\"><from><member>trust</member></from><destination><member>", F.col("p_brand"),
        "</member><member> any </member></destination><action>allow</action>", F.when(key() % 5 == 0, F.lit("<disabled>yes</disabled>")).otherwise(F.lit("")),
        F.when(key() % 3 == 0, F.lit("<schedule>night</schedule>")).otherwise(F.lit("<category><member>any</member></category>")),
        "</entry><entry name='final'><action>deny</action></entry></rules></security></rulebase></config>",
    )
    out = rulebases.rules_from_xml(bodies(df, "paloalto", "config", s("pan-", key()), xml))
    return out.select(
        "device_name", "rule_name", "action", F.array_join("from_zone", ",").alias("from_zone"), F.array_join("dest_addresses", ",").alias("dest"), "position", "enabled",
        "match_unknown", "uuid",
    )


def _hit_bodies(spark, sf_dir):
    df = _table(spark, sf_dir, "part", "p_partkey")
    twice = F.when(key() % 7 == 0, s("3 z1 z2 rule-", key(), " 9 Permit\n")).otherwise(F.lit(""))
    body = s("Logical system: root\nIndex From zone To zone Name Policy count Action\n1 z0 z1 rule-", key(), " ", F.col("p_size"), " Permit\n2 z1 z1 last 0 Deny\n", twice)
    return bodies(df, "juniper", "hits", s("fw-", key()), body)


@REGISTRY.add("hit_counts_from_text", """SELECT 'fw-' || CAST(p_partkey AS VARCHAR) AS device_name, 'rule-' || CAST(p_partkey AS VARCHAR) AS rule_name, CAST(p_size AS BIGINT) AS hit_count FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT 'fw-' || CAST(p_partkey AS VARCHAR), 'last', 0 FROM part""")
def hit_counts_from_text(spark, sf_dir):
    return rulebases.hit_counts_from_text(_hit_bodies(spark, sf_dir)).select("device_name", "rule_name", "hit_count")


@REGISTRY.add("hit_counts_from_xml", """SELECT 'pan-' || CAST(p_partkey AS VARCHAR) AS device_name, 'r-' || CAST(p_partkey AS VARCHAR) AS rule_name, CAST(p_size AS BIGINT) AS hit_count FROM part WHERE p_partkey % 6 <> 0""")
def hit_counts_from_xml(spark, sf_dir):
    df = _table(spark, sf_dir, "part", "p_partkey")
    one = s("<entry name='r-", key(), "'><latest>yes</latest><hit-count>", F.col("p_size"), "</hit-count></entry>")
    xml = s("<r><vsys><entry name='vsys1'><rules>", one, F.when(key() % 6 == 0, one).otherwise(F.lit("")), "<entry name='n'><x/></entry></rules></entry></vsys></r>")
    return rulebases.hit_counts_from_xml(bodies(df, "paloalto", "hits", s("pan-", key()), xml)).select("device_name", "rule_name", "hit_count")


@REGISTRY.add("attach_hit_counts", """SELECT 'fw-' || CAST(p_partkey AS VARCHAR) AS device_name, 'rule-' || CAST(p_partkey AS VARCHAR) AS rule_name, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS BIGINT) END AS hit_count FROM part
UNION ALL SELECT 'fw-' || CAST(p_partkey AS VARCHAR), 'last', 0 FROM part""")
def attach_hit_counts(spark, sf_dir):
    rules = rulebases.rules_from_text(_rule_bodies(spark, sf_dir))
    return rulebases.attach_hit_counts(rules, rulebases.hit_counts_from_text(_hit_bodies(spark, sf_dir))).select("device_name", "rule_name", "hit_count")


@REGISTRY.add("object_books_from_text", """SELECT 'fw-' || CAST(c_custkey AS VARCHAR) AS device_name, '{"address_books": {"global": {"address_sets": {"S": {"members": ["A", "B"]}}, "addresses": {"A": {"kind": "address", "value": "10.'
  || CAST(c_nationkey AS VARCHAR) || '.0.0/16"}, "B": {"kind": "unknown", "reason": "dns-name"}}, "attached_zones": ["' || c_mktsegment || '"]}}, "application_sets": {}, "applications": {"web": '
  || CASE WHEN c_custkey % 4 = 0 THEN '{"kind": "unknown", "reason": "multi-term"}' ELSE '{"destination_port": "' || CAST(c_custkey AS VARCHAR) || '", "kind": "application", "protocol": "tcp"}' END
  || '}, "predefined_application_sets": {}, "predefined_applications": {"junos-ssh": {"kind": "application", "protocol": "tcp"}}}' AS object_book FROM customer""")
def object_books_from_text(spark, sf_dir):
    df = _table(spark, sf_dir, "customer", "c_custkey")
    a = "set security address-book global "
    body = s(
        a, "address A 10.", F.col("c_nationkey"), ".0.0/16\n", a, "address B dns-name host.example\n", a, "address-set S address A\n", a, "address-set S address B\n", a, "attach zone ", F.col("c_mktsegment"),
        "\nset applications application web protocol tcp\nset applications application web destination-port ", key(), "\n",
        F.when(key() % 4 == 0, F.lit("set applications application web term t1 protocol udp\n")).otherwise(F.lit("")), "set groups junos-defaults applications application junos-ssh protocol tcp\n",
    )
    return rulebases.object_books_from_text(bodies(df, "juniper", "objects", s("fw-", key()), body)).select("device_name", "object_book")


@REGISTRY.add("object_books_from_xml", """SELECT 'pan-' || CAST(c_custkey AS VARCHAR) AS device_name, '{"address_groups": {"g": {"kind": "static", "members": ["a"]}}, "addresses": {"a": {"kind": "ip-netmask", "value": "10.0.0.'
  || CAST(c_custkey % 250 AS VARCHAR) || '"}}, "schedules": {}, "service_groups": {}, "services": {"s": {"port": "' || CAST(c_custkey AS VARCHAR) || '", "protocol": "udp", "source_port": ""}}}' AS object_book
FROM customer WHERE c_custkey % 8 <> 0 AND c_custkey % 11 <> 0""")
def object_books_from_xml(spark, sf_dir):
    df = _table(spark, sf_dir, "customer", "c_custkey")
    parts = {
        "address": s("<address><entry name='a'><ip-netmask>10.0.0.", key() % 250, "</ip-netmask></entry></address>"),
        "address-group": F.lit("<address-group><entry name='g'><static><member>a</member></static></entry></address-group>"),
        "service": s("<service><entry name='s'><protocol><udp><port>", key(), "</port></udp></protocol></entry></service>"),
        "service-group": F.lit("<service-group/>"), "schedule": F.when(key() % 11 == 0, F.lit("<schedule><entry></schedule>")).otherwise(F.lit("<schedule/>")),
    }
    out = None
    for command, body in parts.items():
        cut = (key() % 8 == 0) if command == "service" else None
        part = bodies(df, "paloalto", command, s("pan-", key()), body, cut)
        out = part if out is None else out.unionByName(part)
    return rulebases.object_books_from_xml(out).select("device_name", "object_book")


# ---------------------------------------------------------------- health

@REGISTRY.add("gauges_routing_engine", """SELECT 'fw-' || CAST(o_orderkey % 50 AS VARCHAR) AS device, m.n AS metric_name, CASE m.n WHEN 'mem_util_pct' THEN CAST(o_custkey % 101 AS DOUBLE) ELSE CAST(100 - o_orderkey % 101 AS DOUBLE) END AS metric_value
FROM orders, (SELECT 'mem_util_pct' AS n UNION ALL SELECT 'cpu_util_pct') m""")
def gauges_routing_engine(spark, sf_dir):
    df = _table(spark, sf_dir, "orders", "o_orderkey")
    body = s("Routing Engine status:\n  Memory utilization  ", F.col("o_custkey") % 101, " percent\n  CPU utilization:\n    Idle   ", key() % 101, " percent\n")
    out = gauges.routing_engine(bodies(df, "juniper", "show chassis routing-engine", s("fw-", key() % 50), body))
    return out.select("device", "metric_name", "metric_value")


@REGISTRY.add("gauges_environment", "SELECT 'fw-' || CAST(l_suppkey AS VARCHAR) AS device, 'Slot ' || CAST(l_linenumber AS VARCHAR) || ' CPU' AS sensor, floor(l_quantity) AS metric_value FROM lineitem")
def gauges_environment(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem", "l_suppkey")
    q = F.floor("l_quantity")
    body = s("Class Item            Status  Measurement\nTemp Slot ", F.col("l_linenumber"), " CPU   OK   ", q, " degrees C / 99 degrees F\nFans Fan 1 OK\n")
    return gauges.chassis_environment(bodies(df, "juniper", "show chassis environment", s("fw-", key()), body)).select("device", "sensor", "metric_value")


@REGISTRY.add("gauges_system_resources", """SELECT 'pan-' || CAST(o_orderkey % 9 AS VARCHAR) AS device, m.n AS metric_name,
  CASE m.n WHEN 'mem_util_pct' THEN (o_custkey % 4001)::DOUBLE / 4000.0::DOUBLE * 100 ELSE 100 - (o_orderkey % 100 + 0.5)::DOUBLE END AS metric_value FROM orders, (SELECT 'mem_util_pct' AS n UNION ALL SELECT 'cpu_util_pct') m
WHERE m.n = 'cpu_util_pct' OR o_custkey % 4001 <= 4000""")
def gauges_system_resources(spark, sf_dir):
    df = _table(spark, sf_dir, "orders", "o_orderkey")
    body = F.to_json(F.struct(s("%Cpu(s): 3.0 us, ", key() % 100, ".5 id, 0.0 wa\nMiB Mem :   4000.0 total,   12.5 free,   ", F.col("o_custkey") % 4001, ".0 used,  9 buff/cache\n").alias("result")))
    return gauges.system_resources(bodies(df, "paloalto", "show system resources", s("pan-", key() % 9), body)).select("device", "metric_name", "metric_value")


@REGISTRY.add("gauges_guests", """SELECT c_name AS device, 'cpu_util_pct' AS metric_name, least(CAST(c_custkey % 130 AS DOUBLE), 100.0::DOUBLE) AS metric_value FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_name, 'mem_util_pct', CAST(c_nationkey AS DOUBLE) + 0.5 FROM customer WHERE c_custkey % 3 <> 0""")
def gauges_guests(spark, sf_dir):
    df = _table(spark, sf_dir, "customer", "c_custkey")
    status = F.when(key() % 3 == 0, "STOPPED").otherwise("RUNNING")
    body = s(F.col("c_name"), " (ID: ", key(), ")\n  - Status: ", status, "\n  - CPU: ", key() % 130, ".0%\n  - Memory: 1.0 GB / 2.0 GB (", F.col("c_nationkey"), ".5%)\n\n\n")
    return gauges.hypervisor_guests(bodies(df, "proxmox", "list containers", F.lit("pve"), body)).select("device", "metric_name", "metric_value")


@REGISTRY.add("gauges_nodes", """SELECT s_name AS device, 'mem_util_pct' AS metric_name, CAST(s_nationkey AS DOUBLE) + 0.25 AS metric_value FROM supplier WHERE s_suppkey % 4 <> 0""")
def gauges_nodes(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier", "s_suppkey")
    status = F.when(key() % 4 == 0, "offline").otherwise("online")
    body = s("[ok] Node: ", F.col("s_name"), "\n  - Status: ", status, "\n  - Memory: 10.0 GB / 64.0 GB (", F.col("s_nationkey"), ".25%)\n\n")
    return gauges.hypervisor_nodes(bodies(df, "proxmox", "list nodes", F.lit("pve"), body)).select("device", "metric_name", "metric_value")


@REGISTRY.add("gauges_environmentals", """SELECT 'pan-' || CAST(s_suppkey AS VARCHAR) AS device, 'Temperature ' || CAST(s_nationkey AS VARCHAR) AS sensor,
  CAST(s_suppkey % 60 AS DOUBLE) + 0.5 AS metric_value FROM supplier""")
def gauges_environmentals(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier", "s_suppkey")
    body = s("<response><result><thermal><Slot1><entry><description>Temperature ", F.col("s_nationkey"), "</description><DegreesC>", key() % 60,
             ".5</DegreesC></entry><entry><description>broken</description><DegreesC>n/a</DegreesC></entry></Slot1></thermal></result></response>")
    return gauges.environmentals(bodies(df, "paloalto", "show system environmentals", s("pan-", key()), body)).select("device", "sensor", "metric_value")


@REGISTRY.add("gauges_from_snapshots", """SELECT 'juniper' AS provider, count(*) AS n, CAST(sum(o_custkey % 101) + sum(100 - o_orderkey % 101) AS DOUBLE) AS total FROM orders
UNION ALL SELECT 'proxmox', count(*), CAST(sum(s_nationkey) AS DOUBLE) + 0.25 * count(*) FROM supplier WHERE s_suppkey % 4 <> 0""")
def gauges_from_snapshots(spark, sf_dir):
    """The dispatcher over snapshots of two vendors; a truncated one is left out."""
    orders, nodes = _table(spark, sf_dir, "orders", "o_orderkey"), _table(spark, sf_dir, "supplier", "s_suppkey")
    engine = s("  Memory utilization  ", F.col("o_custkey") % 101, " percent\n    Idle   ", key() % 101, " percent\n")
    status = F.when(key() % 4 == 0, "OFFLINE").otherwise("ONLINE")
    node = s("Node: ", F.col("s_name"), "\n  - Status: ", status, "\n  - Memory: 1 GB / 2 GB (", F.col("s_nationkey"), ".25%)\n\n")
    both = bodies(orders, "juniper", "show chassis routing-engine", s("fw-", key()), engine).unionByName(
        bodies(nodes, "proxmox", "list nodes", F.lit("pve"), node)).unionByName(
        bodies(nodes, "proxmox", "list nodes", F.lit("pve"), node, F.lit(True)))
    out = gauges.gauges_from_snapshots(both)
    return out.groupBy("provider").agg((F.count(F.lit(1)) / F.when(F.col("provider") == "juniper", 2).otherwise(1)).cast("long").alias("n"), F.sum("metric_value").alias("total"))


@REGISTRY.add("gauges_controller_devices", """SELECT s_name AS device, 'cpu_util_pct' AS metric_name, '' AS sensor, CAST(s_suppkey % 100 AS DOUBLE) AS metric_value FROM supplier
UNION ALL SELECT s_name, 'temp_celsius', 'PHY', CAST(s_nationkey + 30 AS DOUBLE) FROM supplier""")
def gauges_controller_devices(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier", "s_suppkey")
    body = s('{"data":{"name":"', F.col("s_name"), '","system-stats":{"cpu":"', key() % 100, '"},"temperatures":[{"name":"PHY","value":', F.col("s_nationkey") + 30, '},{"name":"bad","value":"x"}]}}')
    return gauges.controller_devices(bodies(df, "unifi", "device", mac(), body)).select("device", "metric_name", "sensor", "metric_value")


@REGISTRY.add("alarms", """WITH d AS (SELECT 'fw-' || CAST(o_orderkey AS VARCHAR) AS device, o_orderkey % 4 AS kind FROM orders)
SELECT device, 'active_alarm_count' AS metric_name, '' AS sensor, CASE kind WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS metric_value FROM d WHERE kind < 3
UNION ALL SELECT device, 'alarm', 'minor', 1.0::DOUBLE FROM d WHERE kind IN (1, 2) UNION ALL SELECT device, 'alarm', 'major', 1.0::DOUBLE FROM d WHERE kind = 2""")
def alarms(spark, sf_dir):
    df = _table(spark, sf_dir, "orders", "o_orderkey")
    one = "2024-01-29 10:00:00 UTC  Minor  Rescue configuration is not set\n"
    two = "2024-01-29 11:00:00 UTC  Major  Fan tray failure\n"
    body = F.when(key() % 4 == 0, F.lit("No alarms currently active\n")).when(key() % 4 == 1, F.lit("1 alarms currently active\n" + one)).when(
        key() % 4 == 2, F.lit("2 alarms currently active\n" + one + two)).otherwise(F.lit("error: command not supported\n"))
    both = bodies(df, "juniper", "show system alarms", s("fw-", key()), body).unionByName(bodies(df, "juniper", "show chassis alarms", s("fw-", key()), body))
    return gauges.alarms(both).select("device", "metric_name", "sensor", "metric_value")
