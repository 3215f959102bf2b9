"""The driver's tables seen as network data.

Each view is one SELECT that Spark and DuckDB both accept, so a query and its
check read the same rows.  The few spellings that differ go through a dialect.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The instant that stands for "now" and the start of the event data.
AS_OF = "2024-01-31 00:00:00"
SINCE = "2024-01-01 00:00:00"
ARP_AS_OF = "2001-08-02 00:00:00"
ARP_SINCE = "1995-01-01 00:00:00"
EPOCH_2024 = 1704067200


@dataclass(frozen=True)
class Dialect:
    """Where tables are and how an epoch becomes a timestamp."""

    sf_dir: str | None = None

    def table(self, name: str) -> str:
        return name if self.sf_dir is None else f"parquet.`{self.sf_dir}/{name}.parquet`"

    def epoch(self, seconds: str) -> str:
        if self.sf_dir is None:
            return f"make_timestamp(CAST(({seconds}) AS BIGINT) * 1000000)"
        return f"timestamp_seconds({seconds})"

    def json_text(self, column: str) -> str:
        """A string as a JSON string literal."""
        return f"CAST(to_json({column}) AS VARCHAR)" if self.sf_dir is None else column


DUCK = Dialect()


def _net_events(d: Dialect) -> str:
    return f"""
SELECT CAST(ts AS TIMESTAMP) AS timestamp, event_id AS event_no, event_type, sha1(CAST(event_id AS STRING)) AS event_id,
  't_main' AS tenant_id,
  CASE WHEN event_type = 'error' THEN 'alert' ELSE 'event' END AS event_kind,
  CASE event_type WHEN 'view' THEN 'flow_session_create' WHEN 'click' THEN 'flow_session_close'
    WHEN 'purchase' THEN 'flow_end' WHEN 'signup' THEN 'auth_login' ELSE 'flow_session_deny' END AS event_action,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS event_outcome,
  CASE event_id % 4 WHEN 0 THEN 'juniper' WHEN 1 THEN 'paloalto' WHEN 2 THEN 'unifi' ELSE 'proxmox' END AS event_provider,
  concat('10.0.0.', CAST(user_id % 250 AS STRING)) AS source_ip,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('10.1.0.', CAST((event_id * 7) % 40 AS STRING)) END AS destination_ip,
  CAST(1024 + event_id % 1000 AS INT) AS source_port,
  CASE event_id % 5 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 22 WHEN 3 THEN 53 ELSE 3389 END AS destination_port,
  CASE event_id % 5 WHEN 3 THEN 'udp' ELSE 'tcp' END AS network_transport,
  CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS network_bytes,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('rule-', CAST(event_id % 6 AS STRING)) END AS rule_name,
  concat('zone-', CAST(user_id % 3 AS STRING)) AS observer_ingress_zone,
  concat('zone-', CAST(event_id % 4 AS STRING)) AS observer_egress_zone,
  CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 2 = 0
    THEN concat('fw-', CAST(event_id % 5 AS STRING), '.lab.example')
    ELSE concat('fw-', CAST(event_id % 5 AS STRING)) END AS observer_hostname,
  concat('user-', CAST(user_id AS STRING)) AS user_name,
  CASE WHEN event_id % 4 = 2 AND event_type = 'error' THEN CAST(1 + event_id % 3 AS STRING) END AS ids_severity,
  CASE WHEN event_id % 4 = 2 AND event_type = 'error' AND event_id % 8 = 2
    THEN concat('scan-', CAST(event_id % 17 AS STRING)) END AS ids_signature,
  CASE WHEN event_id % 4 = 1 AND event_type IN ('error', 'purchase') THEN
    CASE event_id % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'high' WHEN 2 THEN 'informational' WHEN 3 THEN 'odd' ELSE 'low' END
  END AS pan_severity,
  CASE WHEN event_id % 4 = 0 AND event_type <> 'view' THEN CASE WHEN event_id % 16 = 0 THEN 'none' ELSE CAST(event_id % 7 AS STRING) END
  END AS syslog_severity
FROM {d.table("events")}"""


def _arp_obs(d: Dialect) -> str:
    """Client addresses change MACs; servers up to .24 keep one, later ones are never seen."""
    return f"""
SELECT CAST(o_orderdate AS TIMESTAMP) AS observed_at, concat('FW-', CAST(o_orderkey % 5 AS STRING), '.lab') AS source_device,
  concat('10.0.0.', CAST(o_custkey % 250 AS STRING)) AS ip,
  concat('02:00:00:00:0', CAST(o_custkey % 2 AS STRING), ':', CAST(10 + o_custkey % 90 AS STRING)) AS mac
FROM {d.table("orders")}
UNION ALL
SELECT CAST(ts AS TIMESTAMP), concat('fw-', CAST(event_id % 5 AS STRING)), concat('10.1.0.', CAST((event_id * 7) % 40 AS STRING)),
  concat('02:00:00:00:bb:', CAST(10 + (event_id * 7) % 40 AS STRING))
FROM {d.table("events")} WHERE (event_id * 7) % 40 < 25"""


def _rules(d: Dialect) -> str:
    now = EPOCH_2024 + 30 * 86400
    return f"""
SELECT CASE WHEN p_partkey % 5 < 3 THEN 'juniper' ELSE 'paloalto' END AS provider,
  concat('fw-', CAST(p_partkey % 5 AS STRING)) AS device_name,
  concat('rule-', CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS STRING)) AS rule_name,
  CASE p_size % 3 WHEN 0 THEN 'deny' WHEN 1 THEN 'allow' ELSE 'reject' END AS action,
  concat('zone-', CAST(p_size % 3 AS STRING)) AS from_zone,
  concat('zone-', CAST(p_size % 4 AS STRING)) AS to_zone,
  p_brand AS source_address, p_type AS application,
  CAST(floor(p_partkey / 5) AS INT) AS position,
  p_partkey % 9 <> 0 AS enabled,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size % 4 AS BIGINT) END AS hit_count,
  CASE WHEN p_partkey % 11 = 0 THEN NULL
    WHEN p_partkey % 3 = 0 THEN {d.epoch(f"{now} - 259200 - p_partkey")}
    ELSE {d.epoch(f"{now} - 3600")} END AS hit_count_collected_at,
  {d.epoch(str(now - 3600))} AS collected_at
FROM {d.table("part")}"""


def _rule_history(d: Dialect) -> str:
    """Three past versions per rule; the newest equals the current one for some rules."""
    return f"""
SELECT 't_main' AS tenant_id, r.provider, r.device_name, r.rule_name, r.n AS version_no,
  {d.epoch(f"{EPOCH_2024} + r.n * 86400 + r.position")} AS valid_from,
  CASE WHEN r.n = 2 AND r.position % 2 = 0 THEN r.action ELSE concat('old-', CAST(r.n AS STRING)) END AS action,
  r.from_zone, r.to_zone, r.enabled, CAST(r.position AS STRING) AS position
FROM (SELECT *, 0 AS n FROM rules UNION ALL SELECT *, 1 FROM rules WHERE position % 4 >= 1
  UNION ALL SELECT *, 2 FROM rules WHERE position % 4 >= 2) r"""


def _graph_nodes(d: Dialect) -> str:
    nid = "substring(sha1(concat('t_main|', {k}, '|', {key})), 1, 16)"
    rows = [
        ("region", "'device'", "concat('router-', CAST(r_regionkey AS STRING))", "'router'", "r_regionkey"),
        ("nation", "'device'", "concat('site-', CAST(n_nationkey AS STRING))",
         "CASE WHEN n_nationkey % 3 = 0 THEN 'firewall' ELSE 'switch' END", "n_nationkey"),
        ("supplier", "'device'", "concat('srv-', CAST(s_suppkey AS STRING))", "'hypervisor'", "s_suppkey"),
        ("customer", "'host'", "concat('host-', CAST(c_custkey AS STRING))", "''", "c_custkey"),
    ]
    parts = [
        f"""SELECT {nid.format(k=kind, key=key)} AS node_id, 't_main' AS tenant_id, {kind} AS kind, {key} AS name,
  {role} AS role, {d.epoch(f"{EPOCH_2024} + {num} % 1000")} AS first_seen,
  {d.epoch(f"{EPOCH_2024} + 2500000 + {num} % 90000")} AS last_seen FROM {d.table(table)}"""
        for table, kind, key, role, num in rows
    ]
    return "\nUNION ALL ".join(parts)


def _graph_edges(d: Dialect) -> str:
    nid = "substring(sha1(concat('t_main|', '{k}', '|{p}-', CAST({v} AS STRING))), 1, 16)"
    region, site = nid.format(k="device", p="router", v="{r}"), nid.format(k="device", p="site", v="{n}")
    host, srv = nid.format(k="host", p="host", v="{c}"), nid.format(k="device", p="srv", v="{s}")
    rows = [
        (site.format(n="n_nationkey"), region.format(r="n_regionkey"), "physical_link", "l1", "n_nationkey", "nation"),
        (host.format(c="c_custkey"), site.format(n="c_nationkey"), "attaches_to", "l2", "c_custkey", "customer"),
        (srv.format(s="s_suppkey"), site.format(n="s_nationkey"), "hosts", "virt", "s_suppkey", "supplier"),
    ]
    parts = [
        f"""SELECT {src} AS src_id, {dst} AS dst_id, '{etype}' AS edge_type, '{layer}' AS layer,
  CAST({num} AS BIGINT) AS num, CAST({num} % 48 AS STRING) AS port, CAST({num} % 100 AS STRING) AS vlan FROM {d.table(table)}"""
        for src, dst, etype, layer, num, table in rows
    ]
    union = "\nUNION ALL ".join(parts)
    return f"""
SELECT substring(sha1(concat_ws('|', 't_main', src_id, dst_id, edge_type, layer)), 1, 16) AS edge_id, 't_main' AS tenant_id,
  src_id, dst_id, edge_type, layer, {d.epoch(f"{EPOCH_2024} + num % 1000")} AS first_seen,
  {d.epoch(f"{EPOCH_2024} + 2500000 + num % 90000")} AS last_seen, CAST(1.0 AS DOUBLE) AS confidence, port, vlan
FROM ({union}) u"""


def _audit_calls(d: Dialect) -> str:
    return f"""
SELECT {d.epoch(f"{EPOCH_2024} + conv_id * 100 + turn")} AS ts, concat('user-', CAST(conv_id % 7 AS STRING)) AS principal,
  CASE WHEN conv_id % 4 = 0 THEN 'sovereign' ELSE 'evidence' END AS tier,
  concat('tool-', CAST((conv_id + turn) % 5 AS STRING)) AS tool,
  concat('{{"run_id":"run-', CAST(conv_id AS STRING), '","server_id":"srv-', CAST(conv_id AS STRING), '","segment_seq":', CAST(turn AS STRING), '}}') AS args,
  role AS data_class, CASE WHEN turn % 6 = 5 THEN 'deny' ELSE 'allow' END AS decision, CAST(turn * 3 AS BIGINT) AS row_count,
  text AS error, CASE WHEN conv_id % 3 = 0 THEN 'agent' ELSE '' END AS actor_type, conv_id, turn
FROM {d.table("conversations")}"""


def _questions(d: Dialect) -> str:
    return f"""
SELECT q.doc_id AS id, CASE WHEN q.doc_id % 5 = 0 THEN 'public' ELSE 'sovereign' END AS tier, t.source AS category,
  t.lang AS difficulty, concat('tool-', CAST(q.doc_id % 4 AS STRING)) AS required_tool,
  CASE q.doc_id % 5 WHEN 0 THEN 'refusal' WHEN 1 THEN 'expected_json' ELSE 'reference' END AS ptype,
  CASE q.doc_id % 5 WHEN 2 THEN 'exact' WHEN 3 THEN 'set_overlap' ELSE 'numeric_tolerance' END AS match,
  2 AS min_overlap, CASE WHEN q.doc_id % 2 = 0 THEN CAST(q.doc_id % 40 AS DOUBLE) END AS tolerance,
  CAST(10 AS DOUBLE) AS tolerance_pct, t.n_chars, q.quality, q.toxic
FROM {d.table("labels")} q JOIN {d.table("documents")} t ON t.doc_id = q.doc_id"""


VIEWS: dict[str, tuple[Callable[[Dialect], str], tuple[str, ...]]] = {
    "net_events": (_net_events, ()),
    "arp_obs": (_arp_obs, ()),
    "rules": (_rules, ()),
    "rule_history": (_rule_history, ("rules",)),
    "graph_nodes": (_graph_nodes, ()),
    "graph_edges": (_graph_edges, ()),
    "audit_calls": (_audit_calls, ()),
    "questions": (_questions, ()),
}


def with_views(d: Dialect, *names: str, recursive: bool = False) -> str:
    """``WITH a AS (...), b AS (...)`` for the named views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][1]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    body = ",\n".join(f"{n} AS ({VIEWS[n][0](d)})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(f"{with_views(Dialect(sf_dir), name)} SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores: a file of narrow rows is read in few pieces, however long each row takes afterwards."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


# ---------------------------------------------------------------- typed forms for the operators

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with the ``ext`` map."""
    pairs = F.create_map(
        F.lit("unifi.ips.severity"), F.col("ids_severity"), F.lit("unifi.ips.signature"), F.col("ids_signature"),
        F.lit("panw.panos.severity"), F.col("pan_severity"), F.lit("syslog.severity"), F.col("syslog_severity"),
    )
    df = view(spark, sf_dir, "net_events").withColumn("ext", F.map_filter(pairs, lambda _k, v: v.isNotNull()))
    return df.drop("ids_severity", "ids_signature", "pan_severity", "syslog_severity", "event_type")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARP observations in the canonical observation shape."""
    return view(spark, sf_dir, "arp_obs").select(
        "observed_at", F.lit("junos").alias("collector"), "source_device", F.lit("t_main").alias("tenant_id"),
        F.lit("l3").alias("layer"), F.lit("arp_entry").alias("observation_type"), F.lit("host").alias("subj_kind"),
        F.concat(F.lit("ip:"), "ip").alias("subj_id"), F.lit("host").alias("obj_kind"),
        F.concat(F.lit("mac:"), "mac").alias("obj_id"), F.create_map().cast("map<string,string>").alias("attrs"),
        F.lit("").alias("raw"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "rules")
    return df.select(
        "provider", "device_name", "rule_name", "action", F.array("from_zone").alias("from_zone"), F.array("to_zone").alias("to_zone"),
        F.array("source_address", F.lit("")).alias("source_addresses"), F.array(F.lit("any")).alias("dest_addresses"),
        F.array("application").alias("application"), F.array("application").alias("service"), "position", "enabled",
        F.when(F.col("position") % 3 == 0, "true").alias("source_negated"), "hit_count", "hit_count_collected_at", "collected_at",
    )


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "graph_nodes")
    return df.select(
        "node_id", "tenant_id", "kind", "name", F.create_map(F.lit("name"), F.col("name")).alias("identifiers"),
        "first_seen", "last_seen",
        F.when(F.col("role") != "", F.create_map(F.lit("role"), F.col("role"))).otherwise(F.create_map().cast("map<string,string>")).alias("attrs"),
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "graph_edges")
    return df.select(
        "edge_id", "tenant_id", "src_id", "dst_id", "edge_type", "layer", "first_seen", "last_seen", "confidence",
        F.create_map(F.lit("port"), F.col("port"), F.lit("vlan"), F.col("vlan")).alias("attrs"),
    )


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "audit_calls").select(
        "ts", "principal", "tier", "tool", "args", F.array("data_class").alias("data_classes"), "decision", "row_count",
        "error", F.lit("").alias("client_name"), F.lit("").alias("model_id"), "actor_type",
    )
