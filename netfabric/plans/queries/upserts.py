"""Versioned reads, upserts, histories, deduplication, shifts and retention."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from netfabric.operators import upsert as op
from netfabric.plans import adapter as ad
from netfabric.plans.adapter import AS_OF, DUCK, with_views
from netfabric.plans.queries import REGISTRY

EV = with_views(DUCK, "net_events")
SLIM = ("source_ip", "destination_port", "timestamp", "event_id", "event_action")


@REGISTRY.add("latest_by_key", f"""{EV}
SELECT e.source_ip, e.destination_port, max(e.timestamp) AS timestamp, arg_max(e.event_id, (e.timestamp, e.event_id)) AS event_id,
  arg_max(e.event_action, (e.timestamp, e.event_id)) AS event_action
FROM net_events e GROUP BY e.source_ip, e.destination_port""")
def latest_by_key(spark, sf_dir):
    df = ad.events(spark, sf_dir).select(*SLIM)
    return op.latest_by_key(df, ["source_ip", "destination_port"], "timestamp", ["event_id"])


@REGISTRY.add("collapse_superseded", f"""{EV}
SELECT e.observer_hostname AS name, max(e.timestamp) AS last_seen, arg_max(e.event_id, e.timestamp) AS event_id FROM net_events e
WHERE e.observer_hostname <> '' GROUP BY e.observer_hostname
UNION ALL SELECT e.observer_hostname, e.timestamp, e.event_id FROM net_events e WHERE e.observer_hostname = ''""")
def collapse_superseded(spark, sf_dir):
    df = ad.events(spark, sf_dir).select(F.col("observer_hostname").alias("name"), F.col("timestamp").alias("last_seen"), "event_id")
    return op.collapse_superseded(df)


@REGISTRY.add("upsert", f"""{EV}
SELECT e.source_ip, e.destination_port, max(e.timestamp) AS timestamp, arg_max(e.event_id, (e.timestamp, e.event_id)) AS event_id,
  arg_max(e.event_action, (e.timestamp, e.event_id)) AS event_action
FROM net_events e GROUP BY e.source_ip, e.destination_port""")
def upsert(spark, sf_dir):
    df = ad.events(spark, sf_dir).select(*SLIM)
    keys = ["source_ip", "destination_port"]
    old, new = df.filter(F.col("event_action") != "flow_end"), df.filter(F.col("event_action") == "flow_end")
    return op.upsert(op.latest_by_key(old, keys, "timestamp", ["event_id"]), new, keys, "timestamp", ["event_id"])


CONTENT = """sha1('{"action": "' || action || '", "enabled": "' || CAST(enabled AS VARCHAR) || '", "from_zone": "' || from_zone
  || '", "position": "' || CAST(position AS VARCHAR) || '", "to_zone": "' || to_zone || '"}')"""


def _history(spark, sf_dir):
    return ad.view(spark, sf_dir, "rule_history").withColumn("content_hash", op.rule_content_hash())


def _policies(spark, sf_dir):
    from netfabric.operators.policy import policy_entities

    return policy_entities(ad.rules(spark, sf_dir))


@REGISTRY.add("append_changed_versions", f"""{with_views(DUCK, "rules", "rule_history")},
h AS (SELECT provider, device_name, rule_name, arg_max({CONTENT}, valid_from) AS last_hash FROM rule_history GROUP BY ALL),
n AS (SELECT *, {CONTENT} AS content_hash FROM rules)
SELECT 't_main' AS tenant_id, n.provider, n.device_name, n.rule_name, n.collected_at AS valid_from, n.content_hash, n.action,
  n.from_zone, n.to_zone, n.enabled, CAST(n.position AS VARCHAR) AS position
FROM n LEFT JOIN h USING (provider, device_name, rule_name) WHERE h.last_hash IS DISTINCT FROM n.content_hash""")
def append_changed_versions(spark, sf_dir):
    return op.policy_versions(_policies(spark, sf_dir), _history(spark, sf_dir))


BOOKS = """b AS (SELECT concat('fw-', CAST(c_custkey AS VARCHAR)) AS device_name,
  concat('{"addresses": {"lan": "', c_mktsegment, '"}}') AS object_book, c_custkey FROM customer)"""


@REGISTRY.add("object_book_versions", f"""WITH {BOOKS}
SELECT 't_main' AS tenant_id, 'juniper' AS provider, device_name, TIMESTAMP '2024-01-30 00:00:00' AS valid_from,
  sha1(object_book) AS content_hash, object_book FROM b WHERE c_custkey % 3 <> 1""")
def object_book_versions(spark, sf_dir):
    books = ad.table(spark, sf_dir, "customer").select(
        F.lit("t_main").alias("tenant_id"), F.lit("juniper").alias("provider"),
        F.concat(F.lit("fw-"), F.col("c_custkey").cast("string")).alias("device_name"),
        F.lit("2024-01-30 00:00:00").cast("timestamp").alias("collected_at"),
        F.concat(F.lit('{"addresses": {"lan": "'), "c_mktsegment", F.lit('"}}')).alias("object_book"), "c_custkey",
    )
    # Seen unchanged for remainder 1, seen with another content for 2, never seen for 0.
    past = F.when(F.col("c_custkey") % 3 == 1, F.sha1("object_book")).otherwise(F.lit("other"))
    history = books.filter(F.col("c_custkey") % 3 != 0).select(
        "tenant_id", "provider", "device_name", F.lit("2024-01-02 00:00:00").cast("timestamp").alias("valid_from"),
        past.alias("content_hash"), "object_book",
    )
    return op.object_book_versions(books.drop("c_custkey"), history)


def _segments(spark, sf_dir):
    calls = ad.view(spark, sf_dir, "audit_calls")
    return calls.select(
        F.concat(F.lit("srv-"), F.col("conv_id").cast("string")).alias("server_id"),
        F.concat(F.lit("run-"), F.col("conv_id").cast("string")).alias("run_id"), F.col("turn").alias("segment_seq"),
        "ts", "error", "conv_id",
    )


@REGISTRY.add("ingest_evidence", f"""{with_views(DUCK, "audit_calls")},
m AS (SELECT conv_id, max(turn) AS mark FROM audit_calls WHERE conv_id % 3 <> 0 AND turn <= conv_id % 4 GROUP BY conv_id)
SELECT 'srv-' || CAST(a.conv_id AS VARCHAR) AS server_id, 'run-' || CAST(a.conv_id AS VARCHAR) AS run_id, a.turn AS segment_seq
FROM audit_calls a LEFT JOIN m USING (conv_id) WHERE m.mark IS NULL OR a.turn > m.mark""")
def ingest_evidence(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    landed = seg.filter((F.col("conv_id") % 3 != 0) & (F.col("segment_seq") <= F.col("conv_id") % 4))
    return op.ingest_evidence(seg.select("server_id", "run_id", "segment_seq"), landed)


@REGISTRY.add("dedup_by_token", f"""{with_views(DUCK, "audit_calls")},
t AS (SELECT a.error AS server_id, 'run-' || CAST(a.conv_id AS VARCHAR) AS run_id, a.turn AS segment_seq, a.ts FROM audit_calls a)
SELECT CAST(octet_length(encode(server_id)) AS VARCHAR) || ':' || server_id || ':' || CAST(octet_length(encode(run_id)) AS VARCHAR)
  || ':' || run_id || ':' || CAST(segment_seq AS VARCHAR) AS token, min(ts) AS received_at FROM t GROUP BY ALL""")
def dedup_by_token(spark, sf_dir):
    # Free-form server names (whole texts) in several alphabets; every block is sent twice.
    seg = _segments(spark, sf_dir).select(F.col("error").alias("server_id"), "run_id", "segment_seq", F.col("ts").alias("received_at"))
    late = seg.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 5 MINUTES"))
    return op.dedup_by_token(op.with_dedup_token(seg.unionByName(late))).select("token", "received_at")


# Blocks of a few tokens each in turn, repeated near and far; the check walks them one by one.
WINDOW_BLOCKS = 40


@REGISTRY.add("dedup_in_window", f"""{with_views(DUCK, "audit_calls", recursive=True)},
b AS (SELECT conv_id, turn, 'run-' || CAST(CASE WHEN conv_id % 3 = 0 THEN conv_id % 12 ELSE (conv_id * 7) % 180 END AS VARCHAR) AS token,
  row_number() OVER (ORDER BY conv_id, turn) AS pos FROM audit_calls),
w AS (SELECT 0::BIGINT AS pos, []::VARCHAR[] AS kept, false AS keep
  UNION ALL SELECT b.pos, CASE WHEN list_contains(w.kept, b.token) THEN w.kept ELSE list_append(w.kept, b.token)[-{WINDOW_BLOCKS}:] END,
    NOT list_contains(w.kept, b.token) FROM w JOIN b ON b.pos = w.pos + 1)
SELECT b.conv_id, b.turn, b.token FROM w JOIN b USING (pos) WHERE w.keep""")
def dedup_in_window(spark, sf_dir):
    calls = ad.view(spark, sf_dir, "audit_calls")
    name = F.when(F.col("conv_id") % 3 == 0, F.col("conv_id") % 12).otherwise((F.col("conv_id") * 7) % 180)
    blocks = calls.select("conv_id", "turn", F.concat(F.lit("run-"), name.cast("string")).alias("token"))
    return op.dedup_in_window(blocks, order=("conv_id", "turn"), window=WINDOW_BLOCKS)


@REGISTRY.add("delete_ids", f"{EV} SELECT e.event_id, e.event_action FROM net_events e WHERE e.event_kind <> 'alert'")
def delete_ids(spark, sf_dir):
    ev = ad.events(spark, sf_dir).select("event_id", "event_action", "event_kind")
    return op.delete_ids(ev, ev.filter(F.col("event_kind") == "alert"), "event_id").select("event_id", "event_action")


@REGISTRY.add("backfill_shift", f"""{EV}
SELECT e.event_id, CASE WHEN e.event_provider = 'paloalto' THEN e.timestamp - INTERVAL 5 HOUR ELSE e.timestamp END AS timestamp FROM net_events e""")
def backfill_shift(spark, sf_dir):
    ev = ad.events(spark, sf_dir).select("event_id", "timestamp", "event_provider")
    return op.backfill_shift(ev, "timestamp", F.col("event_provider") == "paloalto", timedelta(hours=-5)).select("event_id", "timestamp")


@REGISTRY.add("backfill_check", f"{EV} SELECT count(*) AS rows_before, count(*) AS rows_after, count(DISTINCT e.event_id) AS ids_before, count(DISTINCT e.event_id) AS ids_after, true AS ok FROM net_events e")
def backfill_check(spark, sf_dir):
    ev = ad.events(spark, sf_dir).select("event_id", "timestamp", "event_provider")
    return op.backfill_check(ev, op.backfill_shift(ev, "timestamp", F.col("event_provider") == "paloalto", timedelta(hours=-5)))


@REGISTRY.add("expire", f"""{EV}
SELECT e.event_id, e.timestamp FROM net_events e WHERE e.timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY""")
def expire(spark, sf_dir):
    return op.expire(ad.events(spark, sf_dir).select("event_id", "timestamp"), "timestamp", 14, AS_OF)
