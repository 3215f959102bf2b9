"""Public metrics, de-identification and liveness."""

from __future__ import annotations

from pyspark.sql import functions as F

from netfabric.functions.siphash import INITIAL, LAST_MARK, ROTATIONS
from netfabric.operators import liveness, metrics as op
from netfabric.plans import adapter as ad
from netfabric.plans.adapter import AS_OF, DUCK, SINCE, with_views
from netfabric.plans.queries import REGISTRY

EV = with_views(DUCK, "net_events")
FLOW = "e.event_action LIKE 'flow_%'"
BUCKET = "time_bucket(INTERVAL '5 minutes', e.timestamp)"
KEY = b"example-key"
CONN = "(e.source_ip, e.source_port, coalesce(e.destination_ip, '-'), e.destination_port, e.network_transport)"


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


SIP_KEY = (506097522914230528, 1084818905618843912)


def duck_siphash(message: str, key: tuple[int, int] = SIP_KEY) -> str:
    """SipHash-2-4 of 128 bits over an ASCII text in SQL, a list of half rounds folded over the state."""
    two64 = "18446744073709551616::HUGEINT"
    start = "[" + ", ".join(f"{v ^ key[k % 2]}::HUGEINT" for k, v in enumerate(INITIAL)) + ", 0]"
    powers = "[" + ", ".join(f"{256 ** j}::HUGEINT" for j in range(8)) + "]"
    n = f"length({message})"
    byte = f"CASE WHEN 8 * i + j < {n} THEN ord({message}[8 * i + j + 1]) WHEN j = 7 THEN {n} % 256 ELSE 0 END"
    blocks = f"list_transform(range({n} // 8 + 1), lambda i: list_reduce(list_transform(range(8), lambda j: ({byte})::HUGEINT * {powers}[j + 1]), lambda x, y: x + y))"
    steps = f"flatten(list_transform({blocks}, lambda m: [[0, m, 0, 0, 0], [1, 0, 0, 0, 0], [0, 0, 0, 0, 0], [1, 0, 0, m, 0]]))"
    last = ", ".join(f"[{k % 2}::HUGEINT, 0, {LAST_MARK if k == 0 else 0}, 0, 0]" for k in range(8))

    def rotate(x: str, bits: tuple[int, int] | int) -> str:
        a, b = (bits, bits) if isinstance(bits, int) else bits
        by = lambda f: f"(CASE WHEN t[1] = 0 THEN {f(a)} ELSE {f(b)} END)::HUGEINT"
        return f"(({x}) * {by(lambda k: 1 << k)} % {two64} + ({x}) // {by(lambda k: 1 << (64 - k))})"

    (a1, a2), (b1, b2) = ROTATIONS
    pq, r, s = f"((s[1] + s[2]) % {two64})", "xor(s[3], t[3])", "xor(s[4], t[2])"
    rs = f"(({r} + {s}) % {two64})"
    state = f"[xor({rs}, t[4]), xor({rotate('s[2]', (a1, b1))}, {pq}), {rotate(pq, 32)}, xor({rotate(s, (a2, b2))}, {rs}), 0]"
    folded = f"list_reduce(list_concat([{start}], {steps}, [{last}]), lambda s, t: {state})"
    digits = lambda x: f"array_to_string(list_transform({powers}, lambda w: format('{{:02X}}', (({x}) // w % 256)::INTEGER)), '')"
    # One element, so that the fold is written once.
    return f"list_transform([{folded}], lambda v: {digits('xor(v[1], v[2])')} || {digits('xor(v[3], v[4])')})[1]"


def duck_hmac(message: str, key: bytes = KEY) -> str:
    """HMAC-SHA256 in the check engine, from two plain SHA-256 calls."""
    padded = key.ljust(64, b"\0")
    inner, outer = _blob(bytes(b ^ 0x36 for b in padded)), _blob(bytes(b ^ 0x5C for b in padded))
    return f"sha256({outer} || unhex(sha256({inner} || encode({message}))))"


def _series(metric: str, value: str) -> str:
    return f"""{EV} SELECT {BUCKET} AS bucket_start, '{metric}' AS metric, '' AS dim, CAST({value} AS DOUBLE) AS value
FROM net_events e WHERE {FLOW} GROUP BY ALL"""


@REGISTRY.add("metric_series_bytes", _series("bytes", "sum(coalesce(e.network_bytes, 0))"))
def metric_series_bytes(spark, sf_dir):
    return op.metric_series(ad.events(spark, sf_dir), "bytes", AS_OF, since=SINCE)


@REGISTRY.add("metric_series_flows", _series("flows", "count(*)"))
def metric_series_flows(spark, sf_dir):
    return op.metric_series(ad.events(spark, sf_dir), "flows", AS_OF, since=SINCE)


@REGISTRY.add("metric_series_connections", _series("connections", f"count(DISTINCT {CONN})"))
def metric_series_connections(spark, sf_dir):
    return op.metric_series(ad.events(spark, sf_dir), "connections", AS_OF, since=SINCE)


@REGISTRY.add("connection_sketches", f"""{EV} SELECT date_trunc('day', e.timestamp) AS bucket_start, count(DISTINCT {CONN}) AS connections, true AS within
FROM net_events e WHERE {FLOW} GROUP BY ALL""")
def connection_sketches(spark, sf_dir):
    """Days rolled up from sketches of buckets, beside the exact counts; within three hundredths of them."""
    events = ad.events(spark, sf_dir)
    days = op.roll_up_sketches(op.connection_sketches(events, AS_OF, since=SINCE), 86_400)
    exact = op.metric_series(events, "connections", AS_OF, since=SINCE, bucket_seconds=86_400).select("bucket_start", F.col("value").cast("long").alias("connections"))
    found = op.sketch_series(days).select("bucket_start", "value").join(exact, "bucket_start", "full")
    near = F.coalesce(F.abs(F.col("value") - F.col("connections")) <= 1 + 0.03 * F.col("connections"), F.lit(False))
    return found.select("bucket_start", "connections", near.alias("within"))


ENTITY = f"""{EV}, s AS (SELECT {BUCKET} AS bucket_start, e.source_ip AS ip, CAST(sum(coalesce(e.network_bytes, 0)) AS DOUBLE) AS value
FROM net_events e WHERE {FLOW} GROUP BY ALL)"""


def _entity(spark, sf_dir):
    return op.entity_series(ad.events(spark, sf_dir), "bytes", AS_OF, since=SINCE)


@REGISTRY.add("entity_series", f"{ENTITY} SELECT bucket_start, ip, 'bytes' AS metric, value FROM s")
def entity_series(spark, sf_dir):
    return _entity(spark, sf_dir)


@REGISTRY.add("top_entities", f"""{ENTITY}, t AS (SELECT ip FROM s GROUP BY ip ORDER BY sum(value) DESC, ip LIMIT 20)
SELECT bucket_start, ip, 'bytes' AS metric, value FROM s WHERE ip IN (SELECT ip FROM t)""")
def top_entities(spark, sf_dir):
    return op.top_entities(_entity(spark, sf_dir))


@REGISTRY.add("surrogates", f"""{EV}, v AS (SELECT DISTINCT user_name AS real_value FROM net_events)
SELECT real_value, 'h_' || substring({duck_hmac("'host:' || real_value")}, 1, 10) AS surrogate FROM v""")
def surrogates(spark, sf_dir):
    values = ad.events(spark, sf_dir).select(F.col("user_name").alias("real_value")).distinct()
    return values.withColumn("surrogate", op.surrogate("host", "real_value", KEY))


def _pseudonyms(spark, sf_dir):
    """A map that already knows the even users."""
    users = ad.table(spark, sf_dir, "events").select("user_id").distinct().filter(F.col("user_id") % 2 == 0)
    value = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    return users.select(
        F.lit("host").alias("kind"), value.alias("real_value"), F.concat(F.lit("h_known"), F.col("user_id").cast("string")).alias("surrogate"),
        F.lit(1).alias("key_version"), F.lit(SINCE).cast("timestamp").alias("first_seen"), F.lit(SINCE).cast("timestamp").alias("last_seen"),
    )


# A three-digit base makes prefixes collide, so the lengthening rule is exercised.
@REGISTRY.add("mint_surrogates", f"""WITH v AS (SELECT DISTINCT user_id, 'user-' || CAST(user_id AS VARCHAR) AS real_value FROM events),
d AS (SELECT *, {duck_hmac("'host:' || real_value")} AS digest FROM v WHERE user_id % 2 <> 0),
c AS (SELECT d.real_value, n AS len, 'h_' || substring(digest, 1, n) AS surrogate FROM d, (SELECT unnest(range(3, 65, 2)) AS n)),
u AS (SELECT surrogate, min(real_value) AS real_value, min(len) AS len FROM c GROUP BY surrogate HAVING count(*) = 1)
SELECT 'host' AS kind, real_value, arg_min(surrogate, len) AS surrogate, 1 AS key_version FROM u GROUP BY real_value
UNION ALL SELECT 'host', real_value, 'h_known' || CAST(user_id AS VARCHAR), 1 FROM v WHERE user_id % 2 = 0""")
def mint_surrogates(spark, sf_dir):
    values = ad.events(spark, sf_dir).select(F.col("user_name").alias("real_value"))
    minted = op.mint_surrogates(values, _pseudonyms(spark, sf_dir), "host", KEY, 1, AS_OF, base_length=3)
    return minted.select("kind", "real_value", "surrogate", "key_version")


@REGISTRY.add("public_nodes", f"""{with_views(DUCK, "graph_nodes")}
SELECT {duck_siphash("node_id")} AS node_id, tenant_id, kind, first_seen, last_seen FROM graph_nodes""")
def public_nodes(spark, sf_dir):
    return op.public_nodes(ad.spread(ad.graph_nodes(spark, sf_dir)), SIP_KEY)


@REGISTRY.add("public_edges", f"""{with_views(DUCK, "graph_edges")}
SELECT {duck_siphash("edge_id")} AS edge_id, tenant_id, {duck_siphash("src_id")} AS src_id, {duck_siphash("dst_id")} AS dst_id, edge_type, layer,
  first_seen, last_seen, confidence FROM graph_edges""")
def public_edges(spark, sf_dir):
    return op.public_edges(ad.spread(ad.graph_edges(spark, sf_dir)), SIP_KEY)


@REGISTRY.add("ratio_to_baseline", f"""{EV}, c AS (SELECT e.source_ip AS ip, count(*) FILTER (WHERE e.event_kind = 'alert') AS alerts,
  count(*) FILTER (WHERE e.event_outcome = 'success' AND e.event_action = 'flow_end') AS ends FROM net_events e GROUP BY ALL)
SELECT ip, CASE WHEN ends = 0 THEN 0.0::DOUBLE ELSE alerts::DOUBLE / ends END AS ratio FROM c""")
def ratio_to_baseline(spark, sf_dir):
    c = ad.events(spark, sf_dir).groupBy(F.col("source_ip").alias("ip")).agg(
        F.count_if(F.col("event_kind") == "alert").alias("alerts"),
        F.count_if((F.col("event_outcome") == "success") & (F.col("event_action") == "flow_end")).alias("ends"),
    )
    return c.select("ip", op.ratio_to_baseline(F.col("alerts"), F.col("ends")).alias("ratio"))


CUR = f"TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY"


@REGISTRY.add("deny_rate_index", f"""{EV}, c AS (SELECT
  count(*) FILTER (WHERE e.event_action = 'flow_session_deny' AND e.timestamp >= {CUR}) AS cd, count(*) FILTER (WHERE e.timestamp >= {CUR}) AS ct,
  count(*) FILTER (WHERE e.event_action = 'flow_session_deny') AS bd, count(*) AS bt
  FROM net_events e WHERE {FLOW} AND e.event_provider IN ('paloalto', 'juniper'))
SELECT {CUR} AS bucket_start, 'deny_rate_index' AS metric, '' AS dim, (cd::DOUBLE / ct) / (bd::DOUBLE / bt) AS value FROM c""")
def deny_rate_index(spark, sf_dir):
    return op.deny_rate_index(ad.events(spark, sf_dir), AS_OF, since="now-5d", baseline="now-30d")


@REGISTRY.add("ips_volume_index", f"""{EV}, c AS (SELECT count(*) FILTER (WHERE e.timestamp >= {CUR}) AS c, count(*) AS b FROM net_events e
  WHERE e.event_provider = 'unifi' AND e.event_kind = 'alert')
SELECT {CUR} AS bucket_start, 'ips_volume_index' AS metric, '' AS dim, c::DOUBLE / b AS value FROM c""")
def ips_volume_index(spark, sf_dir):
    return op.ips_volume_index(ad.events(spark, sf_dir), AS_OF, since="now-5d", baseline="now-30d")


def _versions(series, spark, sf_dir):
    """Two written versions of a series; the second adds one to each value."""
    first = series.withColumn("tenant_id", F.lit("t_main")).withColumn("inserted_at", F.lit(SINCE).cast("timestamp"))
    second = first.withColumn("value", F.col("value") + 1).withColumn("inserted_at", F.lit(AS_OF).cast("timestamp"))
    return first.unionByName(second)


def _metric_table(spark, sf_dir):
    return _versions(op.metric_series(ad.events(spark, sf_dir), "bytes", AS_OF, since=SINCE), spark, sf_dir)


def _entity_table(spark, sf_dir):
    series = _entity(spark, sf_dir).select("bucket_start", op.surrogate("host", "ip", KEY).alias("surrogate"), "metric", "value")
    return _versions(series, spark, sf_dir)


METRIC = f"""{EV}, s AS (SELECT {BUCKET} AS bucket_start, CAST(sum(coalesce(e.network_bytes, 0)) AS DOUBLE) + 1 AS value
FROM net_events e WHERE {FLOW} GROUP BY ALL)"""
ENTITY_T = f"""{EV}, s AS (SELECT {BUCKET} AS bucket_start, 'h_' || substring({duck_hmac("'host:' || e.source_ip")}, 1, 10) AS surrogate,
  CAST(sum(coalesce(e.network_bytes, 0)) AS DOUBLE) + 1 AS value FROM net_events e WHERE {FLOW} GROUP BY ALL)"""


@REGISTRY.add("metric_timeseries", f"{METRIC} SELECT bucket_start, value FROM s")
def metric_timeseries(spark, sf_dir):
    return op.metric_timeseries(_metric_table(spark, sf_dir), "bytes", AS_OF, since=SINCE, until="now")


@REGISTRY.add("metric_total", f"{METRIC} SELECT CAST(sum(value) AS BIGINT) AS total FROM s")
def metric_total(spark, sf_dir):
    return op.metric_total(_metric_table(spark, sf_dir), "bytes", AS_OF, since=SINCE)


@REGISTRY.add("top_series", f"{ENTITY_T} SELECT surrogate, sum(value) AS value FROM s GROUP BY surrogate ORDER BY value DESC, surrogate LIMIT 10")
def top_series(spark, sf_dir):
    return op.top_series(_entity_table(spark, sf_dir), "bytes", AS_OF, since=SINCE)


@REGISTRY.add("busiest_surrogate_total", f"{ENTITY_T}, t AS (SELECT sum(value) AS v FROM s GROUP BY surrogate) SELECT CAST(max(v) AS BIGINT) AS total FROM t")
def busiest_surrogate_total(spark, sf_dir):
    return op.busiest_surrogate_total(_entity_table(spark, sf_dir), "bytes", AS_OF, since=SINCE)


@REGISTRY.add("entity_metric_timeseries", f"{ENTITY_T} SELECT surrogate, bucket_start, value FROM s")
def entity_metric_timeseries(spark, sf_dir):
    series = _entity_table(spark, sf_dir)
    return op.entity_metric_timeseries(series, series.select("surrogate"), "bytes", AS_OF, since=SINCE)


@REGISTRY.add("reidentify", """WITH v AS (SELECT DISTINCT user_id FROM events)
SELECT 'h_known' || CAST(user_id AS VARCHAR) AS surrogate, CASE WHEN user_id % 2 = 0 THEN 'host' END AS kind,
  CASE WHEN user_id % 2 = 0 THEN 'user-' || CAST(user_id AS VARCHAR) END AS real_value FROM v""")
def reidentify(spark, sf_dir):
    asked = ad.table(spark, sf_dir, "events").select(F.concat(F.lit("h_known"), F.col("user_id").cast("string")).alias("surrogate"))
    return op.reidentify(asked, _pseudonyms(spark, sf_dir))


SALT = "fixed-salt"


def _snapshot(spark, sf_dir):
    allow = ad.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("site-"), F.col("n_nationkey").cast("string")).alias("name"),
        F.when(F.col("n_nationkey") % 4 == 0, "remote").otherwise("primary").alias("site"), (F.col("n_nationkey") % 5 == 0).alias("ollama"),
    ).unionByName(ad.table(spark, sf_dir, "region").select(
        F.concat(F.lit("router-"), F.col("r_regionkey").cast("string")).alias("name"), F.lit("primary").alias("site"), F.lit(False).alias("ollama")))
    return op.public_topology_snapshot(
        ad.graph_nodes(spark, sf_dir), ad.graph_edges(spark, sf_dir), allow, "2024-01-29 22:30:00", SALT
    )


SNAP = f"""{with_views(DUCK, "graph_nodes", "graph_edges")},
al AS (SELECT 'site-' || CAST(n_nationkey AS VARCHAR) AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'remote' ELSE 'primary' END AS site, n_nationkey % 5 = 0 AS ollama FROM nation
  UNION ALL SELECT 'router-' || CAST(r_regionkey AS VARCHAR), 'primary', false FROM region),
o AS (SELECT n.node_id, n.last_seen, al.site, al.ollama, 'n' || CAST(row_number() OVER (ORDER BY sha256('{SALT}' || n.name)) AS VARCHAR) AS id
  FROM graph_nodes n JOIN al ON al.name = n.name WHERE n.kind = 'device')"""


@REGISTRY.add("public_snapshot_nodes", f"""{SNAP}
SELECT id, last_seen >= TIMESTAMP '2024-01-29 21:30:00' AS reachable, ollama, site FROM o""")
def public_snapshot_nodes(spark, sf_dir):
    return _snapshot(spark, sf_dir)["nodes"]


@REGISTRY.add("public_snapshot_edges", f"""{SNAP}
SELECT s.id AS source, t.id AS target, s.site = 'remote' OR t.site = 'remote' AS remote,
  e.last_seen >= TIMESTAMP '2024-01-28 22:30:00' AS recent_activity
FROM graph_edges e JOIN o s ON s.node_id = e.src_id JOIN o t ON t.node_id = e.dst_id""")
def public_snapshot_edges(spark, sf_dir):
    return _snapshot(spark, sf_dir)["edges"]


# ---------------------------------------------------------------- liveness

LAST = f"""{EV}, l AS (SELECT e.observer_hostname, e.event_provider AS provider, max(e.timestamp) AS last_event FROM net_events e
  WHERE e.observer_hostname <> '' GROUP BY ALL),
h AS (SELECT *, date_diff('second', last_event, TIMESTAMP '{AS_OF}')::DOUBLE / 3600 AS hours_since FROM l)"""


@REGISTRY.add("last_event_by_observer", f"{LAST} SELECT * FROM h")
def last_event_by_observer(spark, sf_dir):
    return liveness.last_event_by_observer(ad.events(spark, sf_dir), AS_OF, since=SINCE)


STATUS = f"""{LAST}, g AS ({with_views(DUCK, "graph_nodes")} SELECT DISTINCT name FROM graph_nodes WHERE role = 'firewall'),
s AS (SELECT split_part(observer_hostname, '.', 1) AS name, arg_max((provider, last_event, hours_since), (last_event, provider)) AS r FROM h GROUP BY 1),
st AS (SELECT coalesce(g.name, s.name) AS name, r[1] AS provider, r[2] AS last_event, r[3] AS hours_since, coalesce(r[3] > 2, true) AS stale
  FROM g FULL OUTER JOIN s ON s.name = g.name)"""


def _status(spark, sf_dir):
    return liveness.ingest_status(ad.graph_nodes(spark, sf_dir), ad.events(spark, sf_dir), AS_OF, since=SINCE)


@REGISTRY.add("ingest_status", f"{STATUS} SELECT * FROM st")
def ingest_status(spark, sf_dir):
    return _status(spark, sf_dir)


@REGISTRY.add("ingest_summary", f"{STATUS} SELECT count(*) AS total, count(*) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE NOT stale) AS fresh FROM st")
def ingest_summary(spark, sf_dir):
    return liveness.ingest_summary(_status(spark, sf_dir))


def _fabric(spark, sf_dir):
    tables = {
        "events": ad.events(spark, sf_dir), "topo_observations": ad.observations(spark, sf_dir),
        "entity_edges": ad.graph_edges(spark, sf_dir),
        "entities": ad.rules(spark, sf_dir).select(F.lit("configured").alias("source"), F.col("collected_at").alias("last_seen")),
        # The column the probe needs is missing here, which must be reported.
        "health_metrics": ad.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("shipped")),
    }
    return liveness.fabric_status(spark, tables, AS_OF)


@REGISTRY.add("fabric_status", f"""{with_views(DUCK, "net_events", "arp_obs", "graph_edges", "rules")}, p AS (
SELECT event_provider AS name, 'source' AS kind, 'events(event_provider=' || event_provider || ')' AS signal,
  CASE WHEN event_provider = 'proxmox' THEN 24.0 ELSE 1.0 END AS budget_hours, max(e.timestamp) AS last_seen
  FROM net_events e WHERE event_provider <> 'unifi' GROUP BY ALL
UNION ALL SELECT 'topology', 'resolver', 'topo_observations.observed_at', 0.25, max(observed_at) FROM arp_obs
UNION ALL SELECT 'entity', 'resolver', 'entity_edges.last_seen', 0.25, max(last_seen) FROM graph_edges
UNION ALL SELECT 'policy', 'resolver', 'entities(source=configured)', 2.0, max(collected_at) FROM rules
UNION ALL SELECT 'unifi', 'source', 'health_metrics(provider=unifi)', 0.5, NULL
UNION ALL SELECT 'health', 'resolver', 'health_metrics.timestamp', 0.25, NULL
UNION ALL SELECT 'public-metrics', 'resolver', 'metric_timeseries.inserted_at', 0.25, NULL),
h AS (SELECT *, date_diff('second', last_seen, TIMESTAMP '{AS_OF}')::DOUBLE / 3600 AS hours_since FROM p)
SELECT name, kind, signal, CAST(budget_hours AS DOUBLE) AS budget_hours, last_seen, hours_since, coalesce(hours_since > budget_hours, true) AS stale,
  name IN ('unifi', 'health', 'public-metrics') AS errored FROM h""")
def fabric_status(spark, sf_dir):
    return _fabric(spark, sf_dir).withColumn("errored", F.col("error").isNotNull()).drop("error")


@REGISTRY.add("fabric_summary", f"""{with_views(DUCK, "net_events")}, m AS (SELECT event_provider, date_diff('second', max(e.timestamp), TIMESTAMP '{AS_OF}') / 3600.0 AS h
  FROM net_events e GROUP BY ALL), f AS (SELECT count(*) FILTER (WHERE (event_provider IN ('juniper', 'paloalto') AND h <= 1) OR (event_provider = 'proxmox' AND h <= 24)) AS n FROM m)
SELECT 9 AS total, 9 - (n + 1) AS stale, n + 1 AS fresh, 3 AS errored, false AS healthy FROM f""")
def fabric_summary(spark, sf_dir):
    return liveness.fabric_summary(_fabric(spark, sf_dir))


@REGISTRY.add("unparsed_rate", f"""{EV}, u AS (SELECT e.event_provider, strftime(e.timestamp, '%Y-%m-%d') AS day,
  count(*) FILTER (WHERE e.event_kind = 'alert') AS unparsed, count(*) AS total FROM net_events e GROUP BY ALL)
SELECT *, unparsed::DOUBLE / total AS rate FROM u""")
def unparsed_rate(spark, sf_dir):
    ev = ad.events(spark, sf_dir).withColumn(
        "event_action", F.when(F.col("event_kind") == "alert", "parse_error").otherwise(F.col("event_action"))
    )
    return liveness.unparsed_rate(ev).withColumn("day", F.col("day").cast("string"))
