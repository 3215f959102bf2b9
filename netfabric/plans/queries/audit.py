"""Audit chain: hashing, verification of a tampered copy, appending and reports.

One chain per conversation, its turns in order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from netfabric.operators import audit as op
from netfabric.plans import adapter as ad
from netfabric.plans.adapter import DUCK, with_views
from netfabric.plans.queries import REGISTRY
from netfabric.session import cut_lineage, shared_path

CALLS = with_views(DUCK, "audit_calls", recursive=True)


def canon(a: str = "a", tool: str = "tool", args: str = "args") -> str:
    """The canonical JSON array spelled in the check engine."""
    q = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
    return f"""('[' || {q(f"strftime({a}.ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(date_part('millisecond', {a}.ts) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || 'Z'")}
  || ',' || {q(f"{a}.principal")} || ',' || {q(f"{a}.tier")} || ',' || {q(f"{a}.{tool}")} || ',' || {q(f"{a}.{args}")} || ',[' || {q(f"{a}.data_class")} || '],'
  || {q(f"{a}.decision")} || ',' || CAST({a}.row_count AS VARCHAR) || ',' || {q(f"{a}.error")}
  || CASE WHEN {a}.actor_type <> '' THEN ',"","",' || {q(f"{a}.actor_type")} ELSE '' END || ']')"""


def _rows(spark, sf_dir):
    ids = ad.view(spark, sf_dir, "audit_calls")
    return ids.select(
        "ts", "principal", "tier", "tool", "args", F.array("data_class").alias("data_classes"), "decision", "row_count", "error",
        F.lit("").alias("client_name"), F.lit("").alias("model_id"), "actor_type", "conv_id", "turn",
    )


def _chained(spark, sf_dir):
    none = spark.createDataFrame([], "tier string, server_id string, row_hash string")
    return op.append_chained(_rows(spark, sf_dir), none)


@REGISTRY.add("audit_canonical", f"{CALLS} SELECT a.conv_id, a.turn, {canon()} AS canonical FROM audit_calls a")
def audit_canonical(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.select("conv_id", "turn", op.canonical(rows).alias("canonical"))


@REGISTRY.add("audit_row_hash", f"{CALLS} SELECT a.conv_id, a.turn, sha256('' || chr(10) || {canon()}) AS row_hash FROM audit_calls a")
def audit_row_hash(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("prev_hash", F.lit(""))
    return rows.select("conv_id", "turn", op.row_hash(rows).alias("row_hash"))


@REGISTRY.add("audit_chain_key", f"{CALLS} SELECT a.tier, 'srv-' || CAST(a.conv_id AS VARCHAR) AS server_id, count(*) AS n FROM audit_calls a GROUP BY ALL")
def audit_chain_key(spark, sf_dir):
    return op.with_chain_key(_rows(spark, sf_dir)).groupBy("tier", "server_id").agg(F.count(F.lit(1)).alias("n"))


CHAIN = f"""ch AS (SELECT a.conv_id, a.turn, '' AS prev_hash, sha256(chr(10) || {canon()}) AS row_hash FROM audit_calls a WHERE a.turn = 0
  UNION ALL SELECT a.conv_id, a.turn, c.row_hash, sha256(c.row_hash || chr(10) || {canon()}) FROM audit_calls a JOIN ch c ON c.conv_id = a.conv_id AND a.turn = c.turn + 1)"""


@REGISTRY.add("append_chained", f"{CALLS}, {CHAIN} SELECT conv_id, turn, prev_hash, row_hash FROM ch")
def append_chained(spark, sf_dir):
    return _chained(spark, sf_dir).select("conv_id", "turn", "prev_hash", "row_hash")


def _tampered(spark, sf_dir):
    """A copy with edits, deletions, duplicates, unreadable arguments and blanked hashes."""
    rows = cut_lineage(_chained(spark, sf_dir))
    kind, turn = F.col("conv_id") % 10, F.col("turn")
    edited = rows.filter(~((kind == 4) & (turn == 1))).withColumn(
        "tool", F.when((kind == 3) & (turn == 1), F.lit("tampered")).otherwise(F.col("tool"))
    ).withColumn("args", F.when((kind == 6) & (turn == 2), F.lit("{bad")).otherwise(F.col("args"))).withColumn(
        "row_hash", F.when((kind == 7) & (turn == 0), F.lit("")).otherwise(F.col("row_hash"))
    ).select(*[c for c in rows.columns if c != "server_id"])
    return edited.unionByName(edited.filter((kind == 5) & (turn == 2)))


TAMPERED = f"""{CALLS}, {CHAIN}, td AS (SELECT a.* EXCLUDE (tool, args), c.prev_hash,
    CASE WHEN a.conv_id % 10 = 7 AND a.turn = 0 THEN '' ELSE c.row_hash END AS row_hash,
    CASE WHEN a.conv_id % 10 = 3 AND a.turn = 1 THEN 'tampered' ELSE a.tool END AS tool,
    CASE WHEN a.conv_id % 10 = 6 AND a.turn = 2 THEN '{{bad' ELSE a.args END AS args,
    CASE WHEN a.conv_id % 10 = 6 AND a.turn = 2 THEN '' ELSE 'srv-' || CAST(a.conv_id AS VARCHAR) END AS server_id
  FROM audit_calls a JOIN ch c USING (conv_id, turn) WHERE NOT (a.conv_id % 10 = 4 AND a.turn = 1)),
tm AS (SELECT *, 1 AS copy FROM td UNION ALL SELECT *, 2 FROM td WHERE conv_id % 10 = 5 AND turn = 2),
hs AS (SELECT * FROM tm WHERE row_hash <> ''),
rc AS (SELECT tier, server_id, row_hash FROM hs WHERE prev_hash = ''
  UNION SELECT h.tier, h.server_id, h.row_hash FROM hs h JOIN rc r ON r.tier = h.tier AND r.server_id = h.server_id AND r.row_hash = h.prev_hash),
tails AS (SELECT DISTINCT tier, server_id, row_hash FROM hs h WHERE NOT EXISTS
  (SELECT 1 FROM hs p WHERE p.tier = h.tier AND p.server_id = h.server_id AND p.prev_hash = h.row_hash)),
iss AS (SELECT tier, server_id, 'duplicate_row' AS type, row_hash FROM hs GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT a.tier, a.server_id, 'content_edit', a.row_hash FROM hs a WHERE sha256(a.prev_hash || chr(10) || {canon()}) <> a.row_hash
  UNION ALL SELECT h.tier, h.server_id, 'missing_predecessor', h.row_hash FROM hs h WHERE h.prev_hash <> '' AND NOT EXISTS
    (SELECT 1 FROM hs p WHERE p.tier = h.tier AND p.server_id = h.server_id AND p.row_hash = h.prev_hash)
  UNION ALL SELECT h.tier, h.server_id, 'unreachable', h.row_hash FROM hs h WHERE NOT EXISTS
    (SELECT 1 FROM rc r WHERE r.tier = h.tier AND r.server_id = h.server_id AND r.row_hash = h.row_hash)
  UNION ALL SELECT tier, server_id, 'unidentified_writer', row_hash FROM tm WHERE tier = 'evidence' AND server_id = ''
  UNION ALL SELECT t.tier, t.server_id, 'fork', t.row_hash FROM tails t WHERE (SELECT count(*) FROM tails u WHERE u.tier = t.tier AND u.server_id = t.server_id) > 1)"""


@REGISTRY.add("verify_chain", f"{TAMPERED} SELECT * FROM iss")
def verify_chain(spark, sf_dir):
    return op.verify_chain(_tampered(spark, sf_dir))


@REGISTRY.add("verify_chain_onward", f"{TAMPERED} SELECT * FROM iss")
def verify_chain_onward(spark, sf_dir):
    """The log is verified as written, then tampered with and verified onward from there."""
    state = shared_path(spark, "verified")
    op.verify_chain_onward(_chained(spark, sf_dir).drop("server_id"), state, "digest-key")
    return op.verify_chain_onward(_tampered(spark, sf_dir), state, "digest-key")


@REGISTRY.add("chain_report", f"""{TAMPERED}, n AS (SELECT tier, server_id, count(*) AS issues FROM iss GROUP BY ALL)
SELECT t.tier, t.server_id, count(*) AS row_count, count(*) FILTER (WHERE t.row_hash = '') AS legacy_unhashed, coalesce(any_value(n.issues), 0) AS issues,
  coalesce(any_value(n.issues), 0) = 0 AS ok FROM tm t LEFT JOIN n USING (tier, server_id) GROUP BY t.tier, t.server_id""")
def chain_report(spark, sf_dir):
    rows = cut_lineage(_tampered(spark, sf_dir))
    return op.chain_report(rows, op.verify_chain(rows))


@REGISTRY.add("chain_tails", f"{TAMPERED} SELECT * FROM tails")
def chain_tails(spark, sf_dir):
    return op.chain_tails(op.with_chain_key(_tampered(spark, sf_dir)))


@REGISTRY.add("build_audit_rows", f"""{CALLS} SELECT a.ts, a.tool, '{{"decision": "' || a.decision || '", "role": "' || a.data_class || '"}}' AS args, '' AS client_name,
  CASE WHEN a.conv_id % 3 = 0 THEN 'agent' ELSE 'unknown' END AS actor_type FROM audit_calls a""")
def build_audit_rows(spark, sf_dir):
    calls = _rows(spark, sf_dir).withColumn(
        "arguments", F.create_map(F.lit("role"), F.col("data_classes")[0], F.lit("decision"), F.col("decision"))
    ).withColumn("actor_type", F.when(F.col("conv_id") % 3 == 0, " Agent ").otherwise("robot"))
    return op.build_audit_rows(calls).select("ts", "tool", "args", "client_name", "actor_type")


@REGISTRY.add("calls_in_trailing_window", f"""{with_views(DUCK, "net_events")}, c AS (SELECT e.user_name AS principal, date_trunc('millisecond', e.timestamp) AS ts, count(*) AS calls FROM net_events e GROUP BY ALL)
SELECT principal, ts, calls, CAST(w AS BIGINT) AS calls_in_window, w > 3 AS breach FROM (SELECT *, sum(calls) OVER (PARTITION BY principal ORDER BY ts
  RANGE BETWEEN INTERVAL 86399999 MILLISECONDS PRECEDING AND CURRENT ROW) AS w FROM c)""")
def calls_in_trailing_window(spark, sf_dir):
    calls = ad.events(spark, sf_dir).select(F.col("user_name").alias("principal"), F.col("timestamp").alias("ts"))
    return op.calls_in_trailing_window(calls, 86400, 3)


@REGISTRY.add("tools_used", f"""{with_views(DUCK, "audit_calls")}, i AS (SELECT conv_id AS interval_id, any_value(principal) AS principal, min(ts) AS s, max(ts) AS f FROM audit_calls GROUP BY conv_id)
SELECT i.interval_id, i.principal, (SELECT coalesce(string_agg(tool, ',' ORDER BY tool), '') FROM (SELECT DISTINCT tool FROM audit_calls a WHERE a.principal = i.principal
  AND a.decision = 'allow' AND a.ts BETWEEN i.s - INTERVAL 700 SECOND AND i.f + INTERVAL 700 SECOND)) AS tools FROM i""")
def tools_used(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    spans = rows.groupBy(F.col("conv_id").alias("interval_id"), "principal").agg(F.min("ts").alias("started"), F.max("ts").alias("finished"))
    return op.tools_used(rows, spans, slop_seconds=700).withColumn("tools", F.array_join("tools", ","))
