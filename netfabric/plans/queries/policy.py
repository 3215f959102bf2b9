"""Configured rules, their usage and the unused-rule verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from netfabric.operators import policy as op
from netfabric.operators.upsert import rule_content_hash
from netfabric.plans import adapter as ad
from netfabric.plans.adapter import AS_OF, DUCK, with_views
from netfabric.plans.queries import REGISTRY
from netfabric.plans.queries.upserts import CONTENT

RULES = with_views(DUCK, "rules")


def eid(key: str) -> str:
    return f"substring(sha1('t_main|entity|' || {key}), 1, 16)"


def edge_id(src: str, dst: str, etype: str, source: str) -> str:
    return f"substring(sha1('t_main|entity_edge|' || {src} || '|' || {dst} || '|{etype}|{source}'), 1, 16)"


FW = eid("'firewall|device:' || device_name")
POL = eid("'policy|' || provider || ':' || device_name || ':' || rule_name")


@REGISTRY.add("firewall_entities", f"""{RULES} SELECT {FW} AS entity_id, 't_main' AS tenant_id, 'firewall' AS kind, device_name AS name,
  arg_min(provider, position) AS provider, count(*) AS rule_count, 'configured' AS source, 'device_name' AS identity_basis,
  CAST(1.0 AS DOUBLE) AS confidence, min(collected_at) AS first_seen, max(collected_at) AS last_seen FROM rules GROUP BY device_name""")
def firewall_entities(spark, sf_dir):
    return op.firewall_entities(ad.rules(spark, sf_dir))


@REGISTRY.add("policy_entities", f"""{RULES} SELECT {POL} AS entity_id, rule_name AS name, provider, device_name, action, from_zone, to_zone,
  source_address AS source_addresses, 'any' AS dest_addresses, application, application AS service, position, enabled, hit_count FROM rules""")
def policy_entities(spark, sf_dir):
    return op.policy_entities(ad.rules(spark, sf_dir)).select(
        "entity_id", "name", "provider", "device_name", "action", *op.LIST_ATTRS, "position", "enabled", "hit_count"
    )


@REGISTRY.add("policy_edges", f"""{RULES} SELECT {edge_id(FW, POL, "governed_by", "configured")} AS edge_id, {FW} AS src_id, {POL} AS dst_id,
  rule_name AS rule, provider FROM rules""")
def policy_edges(spark, sf_dir):
    return op.policy_edges(ad.rules(spark, sf_dir)).select("edge_id", "src_id", "dst_id", "rule", "provider")


USAGE = f"""{with_views(DUCK, "net_events", "rules", "rule_history")}, u AS (SELECT e.tenant_id, date_trunc('hour', e.timestamp) AS bucket_start,
  e.event_provider AS provider, e.observer_hostname, e.rule_name, count(*) AS sessions, CAST(sum(coalesce(e.network_bytes, 0)) AS BIGINT) AS bytes
  FROM net_events e WHERE e.rule_name <> '' AND e.timestamp >= TIMESTAMP '2024-01-01' AND e.timestamp < TIMESTAMP '{AS_OF}' GROUP BY ALL),
ud AS (SELECT *, split_part(observer_hostname, '.', 1) AS device_name FROM u)"""


def _usage(spark, sf_dir):
    return op.rule_usage_hourly(ad.events(spark, sf_dir), AS_OF, lookback_hours=30 * 24)


def _policies(spark, sf_dir):
    return op.policy_entities(ad.rules(spark, sf_dir))


@REGISTRY.add("rule_usage_hourly", f"{USAGE} SELECT * FROM u")
def rule_usage_hourly(spark, sf_dir):
    return _usage(spark, sf_dir)


SPAN = {"since": "2024-01-01", "until": "now"}
BUCKETS = "b AS (SELECT ud.device_name, ud.rule_name, bucket_start, ud.provider, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(bytes) AS BIGINT) AS bytes FROM ud JOIN rules r ON r.device_name = ud.device_name AND r.rule_name = ud.rule_name GROUP BY ALL)"


@REGISTRY.add("rule_usage", f"{USAGE}, {BUCKETS} SELECT * FROM b")
def rule_usage(spark, sf_dir):
    return op.rule_usage(ad.rules(spark, sf_dir), _usage(spark, sf_dir), AS_OF, **SPAN)


@REGISTRY.add("rule_usage_totals", f"""{USAGE}, {BUCKETS}, t AS (SELECT device_name, rule_name, CAST(sum(sessions) AS BIGINT) AS s, CAST(sum(bytes) AS BIGINT) AS y FROM b GROUP BY ALL)
SELECT r.device_name, r.rule_name, coalesce(t.s, 0) AS total_sessions, coalesce(t.y, 0) AS total_bytes, r.hit_count AS device_hit_count
FROM rules r LEFT JOIN t USING (device_name, rule_name)""")
def rule_usage_totals(spark, sf_dir):
    rules = ad.rules(spark, sf_dir)
    return op.rule_usage_totals(rules, op.rule_usage(rules, _usage(spark, sf_dir), AS_OF, **SPAN), _policies(spark, sf_dir))


def _versions(spark, sf_dir):
    return ad.view(spark, sf_dir, "rule_history").withColumn("content_hash", rule_content_hash())


@REGISTRY.add("rule_history", f"""{with_views(DUCK, "rule_history")}, h AS (SELECT *, {CONTENT} AS content_hash,
  row_number() OVER (PARTITION BY device_name, rule_name ORDER BY valid_from DESC) AS rn FROM rule_history)
SELECT device_name, rule_name, valid_from, content_hash, action, from_zone, to_zone, enabled, position FROM h WHERE rn <= 2""")
def rule_history(spark, sf_dir):
    return op.rule_history(ad.rules(spark, sf_dir), _versions(spark, sf_dir), 2)


COVER = f"""c AS (SELECT device_name, min(bucket_start) AS min_bucket, max(bucket_start) AS max_bucket, count(*) AS buckets FROM ud GROUP BY device_name),
cv AS (SELECT d.device_name, min_bucket, max_bucket, coalesce(buckets, 0) AS buckets,
  coalesce(min_bucket <= TIMESTAMP '2024-01-01 01:00:00' AND max_bucket >= TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR, false) AS log_coverage
  FROM (SELECT DISTINCT device_name FROM rules) d LEFT JOIN c USING (device_name))"""


@REGISTRY.add("log_coverage", f"{USAGE}, {COVER} SELECT * FROM cv")
def log_coverage(spark, sf_dir):
    return op.log_coverage(ad.rules(spark, sf_dir), _usage(spark, sf_dir), AS_OF, **SPAN)


VERDICT = f"""{USAGE}, {COVER}, us AS (SELECT device_name, rule_name, max(sessions) > 0 AS used FROM ud GROUP BY ALL),
x AS (SELECT r.*, coalesce(us.used, false) AS log_used, cv.log_coverage,
  CASE WHEN NOT cv.log_coverage THEN 'usage rollup does not cover the window'
    WHEN r.hit_count IS NULL OR r.hit_count_collected_at IS NULL THEN 'device hit-counter was not collected for this rule'
    WHEN r.hit_count_collected_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
      THEN 'device hit-counter is stale (collected ' || strftime(r.hit_count_collected_at, '%Y-%m-%dT%H:%M:%SZ') || ')'
    WHEN coalesce(us.used, false) <> (r.hit_count > 0) THEN 'log rollup and device hit-counter disagree'
    ELSE 'log rollup and device hit-counter agree' END AS reason
  FROM rules r LEFT JOIN us USING (device_name, rule_name) JOIN cv USING (device_name)),
v AS (SELECT *, CASE WHEN reason = 'log rollup and device hit-counter agree' THEN CASE WHEN log_used THEN 'used' ELSE 'unused' END ELSE 'unknown' END AS status FROM x)"""


@REGISTRY.add("unused_rules", f"""{VERDICT} SELECT device_name, rule_name, status, reason, log_coverage, log_used, hit_count AS device_hit_count,
  hit_count_collected_at FROM v""")
def unused_rules(spark, sf_dir):
    return op.unused_rules(_policies(spark, sf_dir), _usage(spark, sf_dir), AS_OF, **SPAN)


@REGISTRY.add("explain_rule", f"""{VERDICT}, {BUCKETS}, t AS (SELECT device_name, rule_name, CAST(sum(sessions) AS BIGINT) AS s FROM b GROUP BY ALL)
SELECT v.device_name, v.rule_name, v.status, v.rule_name || ' on ' || v.device_name || ': action=' || v.action || ', enabled=' || CAST(v.enabled AS VARCHAR)
  || ', sessions_in_window=' || CAST(coalesce(t.s, 0) AS VARCHAR) || ', device_hit_count=' || coalesce(CAST(v.hit_count AS VARCHAR), 'none')
  || ', usage_status=' || v.status || '.' AS summary,
  (SELECT count(*) FROM rule_history h WHERE h.device_name = v.device_name AND h.rule_name = v.rule_name) AS versions,
  true AS found, (SELECT count(*) FROM rule_history h WHERE h.device_name = v.device_name AND h.rule_name = v.rule_name) AS version_count
FROM v LEFT JOIN t USING (device_name, rule_name)
UNION ALL SELECT device_name, rule_name || '-gone', NULL, rule_name || '-gone on ' || device_name || ': not_found.', 0, false, 0 FROM v""")
def explain_rule(spark, sf_dir):
    known = ad.rules(spark, sf_dir).select("device_name", "rule_name")
    # Each rule is asked for again under a name that no configuration has.
    asked = known.unionByName(known.withColumn("rule_name", F.concat("rule_name", F.lit("-gone"))))
    df = op.explain_rule(
        asked, _policies(spark, sf_dir), _usage(spark, sf_dir), _versions(spark, sf_dir), AS_OF, recent_versions=None, **SPAN
    )
    versions = F.coalesce(F.size("recent_versions"), F.lit(0))
    return df.select(
        "device_name", "rule_name", "status", "summary", F.greatest(versions, F.lit(0)).alias("versions"), "found", "version_count")
