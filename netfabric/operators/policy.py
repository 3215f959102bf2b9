"""Configured rules: entities, usage rollup, coverage and the unused-rule verdict."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.functions.ids import DEFAULT_TENANT, entity_edge_id, entity_id, text
from netfabric.functions.net import short_host
from netfabric.functions.skew import lookup_join, top_rows
from netfabric.functions.timeargs import parse_time, ts_lit
from netfabric.operators.entities import CONFIGURED, ENTITY_COLUMNS
from netfabric.operators.upsert import latest_by_key

TimeArg = str | datetime

# Windows, ages, limits and the verdict texts.
ROLLUP_LOOKBACK_HOURS = 3
COVERAGE_START_SLACK = timedelta(hours=1)
COVERAGE_END_SLACK = timedelta(hours=2)
COUNTER_MAX_AGE = timedelta(hours=24)
UNUSED_WINDOW = "now-7d"
USAGE_KEYS = ("tenant_id", "bucket_start", "provider", "observer_hostname", "rule_name")
REASON_NO_LOGS = "usage rollup does not cover the window"
REASON_NO_COUNTER = "device hit-counter was not collected for this rule"
REASON_STALE = "device hit-counter is stale"
REASON_DISAGREE = "log rollup and device hit-counter disagree"
REASON_AGREE = "log rollup and device hit-counter agree"

# Columns of a rule that are not match clauses of its own vendor; every other column is, and is carried.
RULE_COLUMNS = (
    "tenant_id", "provider", "device_name", "rule_name", "rule_id", "rule_uuid", "action", "position", "enabled", "collected_at",
    "hit_count", "hit_count_collected_at",
)
LIST_ATTRS = ("from_zone", "to_zone", "source_addresses", "dest_addresses", "application", "service")


def _csv(value: Column) -> Column:
    return F.array_join(F.filter(value, lambda v: v != ""), ",")


def clause_columns(df: DataFrame) -> list[str]:
    """Match clauses beyond zones, addresses, applications and services: negations, identities, schedules and the like."""
    return [c for c in df.columns if c not in (*RULE_COLUMNS, *LIST_ATTRS)]


def _attribute(df: DataFrame, name: str) -> Column:
    """A clause as an attribute: lists joined by commas, anything else as it is; an empty one is absent."""
    column = F.col(name)
    if df.schema[name].dataType.typeName() == "array":
        column = _csv(column.cast("array<string>"))
    return F.nullif(column, F.lit("")) if df.schema[name].dataType.typeName() in ("array", "string") else column


def firewall_entities(rules: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """One firewall per device with its rule count."""
    grouped = rules.groupBy("device_name").agg(
        F.count(F.lit(1)).alias("rule_count"), F.min_by("provider", F.struct("position", "provider")).alias("provider"),
        F.min("collected_at").alias("first_seen"), F.max("collected_at").alias("last_seen"),
    )
    return grouped.select(
        entity_id(F.lit(tenant), F.lit("firewall"), F.concat(F.lit("device:"), "device_name")).alias("entity_id"),
        F.lit(tenant).alias("tenant_id"), F.lit("firewall").alias("kind"), F.col("device_name").alias("name"),
        "provider", "rule_count", F.lit(CONFIGURED).alias("source"), F.lit("device_name").alias("identity_basis"),
        F.lit(1.0).alias("confidence"), "first_seen", "last_seen",
    )


def policy_key() -> Column:
    return F.concat_ws(":", "provider", "device_name", "rule_name")


def policy_entities(rules: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """One configured policy per (provider, device, rule); the last position wins.

    List attributes are comma-joined with empties dropped.  Every clause that restricts
    the match is carried under its own name, so that no rule reads wider than it is.
    """
    rows = latest_by_key(rules, ["provider", "device_name", "rule_name"], ["collected_at", "position"])
    extra = [c for c in ("hit_count", "hit_count_collected_at") if c in rules.columns]
    clauses = [_attribute(rules, c).alias(c) for c in clause_columns(rules)]
    return rows.select(
        entity_id(F.lit(tenant), F.lit("policy"), policy_key()).alias("entity_id"), F.lit(tenant).alias("tenant_id"),
        F.lit("policy").alias("kind"), F.col("rule_name").alias("name"), "provider", "device_name", "rule_name", "action",
        *[_csv(F.col(c)).alias(c) for c in LIST_ATTRS], "position", "enabled", *clauses, *extra,
        F.lit(CONFIGURED).alias("source"), F.lit("").alias("identity_basis"), F.lit(1.0).alias("confidence"),
        "collected_at", F.col("collected_at").alias("first_seen"), F.col("collected_at").alias("last_seen"),
    )


def policy_edges(rules: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """governed_by edges from each firewall to its configured policies."""
    t = F.lit(tenant)
    rows = rules.groupBy("provider", "device_name", "rule_name").agg(
        F.min("collected_at").alias("first_seen"), F.max("collected_at").alias("last_seen")
    ).withColumn("src_id", entity_id(t, F.lit("firewall"), F.concat(F.lit("device:"), "device_name"))).withColumn(
        "dst_id", entity_id(t, F.lit("policy"), policy_key())
    )
    return rows.select(
        entity_edge_id(t, F.col("src_id"), F.col("dst_id"), F.lit("governed_by"), F.lit(CONFIGURED)).alias("edge_id"),
        t.alias("tenant_id"), "src_id", "dst_id", F.lit("governed_by").alias("edge_type"), F.lit(CONFIGURED).alias("source"),
        F.lit(1.0).alias("confidence"), F.col("rule_name").alias("rule"), "provider", "first_seen", "last_seen",
    )


def firewalls_as_entities(firewalls: DataFrame) -> DataFrame:
    return firewalls.withColumn("identifiers", F.create_map(F.lit("device_name"), F.col("name"))).withColumn(
        "attrs", F.create_map(F.lit("provider"), F.col("provider"), F.lit("rule_count"), F.col("rule_count").cast("string"))
    ).select(*ENTITY_COLUMNS)


def policies_as_entities(policies: DataFrame) -> DataFrame:
    """Policies with string maps; counters that were not collected stay absent."""
    identifiers = F.create_map(
        F.lit("rule"), F.col("rule_name"), F.lit("provider"), F.col("provider"), F.lit("device_name"), F.col("device_name")
    )
    names = ["provider", "device_name", "action", *LIST_ATTRS, "position", "enabled"]
    fixed = ("entity_id", "kind", "name", "source", "identity_basis", "confidence", "first_seen", "last_seen", "identifiers", "attrs")
    names += [c for c in clause_columns(policies) if c not in fixed] + [c for c in ("hit_count",) if c in policies.columns]
    pairs = [x for c in names for x in (F.lit(c), F.col(c).cast("string"))]
    if "hit_count_collected_at" in policies.columns:
        pairs += [F.lit("hit_count_collected_at"), F.date_format("hit_count_collected_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")]
    attrs = F.map_filter(F.create_map(*pairs), lambda _k, v: v.isNotNull())
    return policies.withColumn("identifiers", identifiers).withColumn("attrs", attrs).select(*ENTITY_COLUMNS)


# ---------------------------------------------------------------- usage

def rollup_window(as_of: TimeArg, lookback_hours: int = ROLLUP_LOOKBACK_HOURS) -> tuple[datetime, datetime]:
    """Whole trailing hours ending at the top of the current hour."""
    until = parse_time(as_of).replace(minute=0, second=0, microsecond=0)
    return until - timedelta(hours=lookback_hours), until


def rule_usage_hourly(events: DataFrame, as_of: TimeArg, lookback_hours: int = ROLLUP_LOOKBACK_HOURS) -> DataFrame:
    """Sessions and bytes per rule and hour.  A re-run gives the same keys, so upserts overwrite."""
    since, until = rollup_window(as_of, lookback_hours)
    df = events.filter(text("rule_name") != "").filter(
        (F.col("timestamp") >= ts_lit(since)) & (F.col("timestamp") < ts_lit(until))
    )
    return df.groupBy(
        "tenant_id", F.date_trunc("hour", "timestamp").alias("bucket_start"), F.col("event_provider").alias("provider"),
        "observer_hostname", "rule_name",
    ).agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.coalesce("network_bytes", F.lit(0))).alias("bytes"))


def usage_for_join(usage: DataFrame) -> DataFrame:
    """Usage keyed like configured rules: short device name, ``(global)`` suffix stripped."""
    rule = F.trim(F.regexp_replace("rule_name", r"\s*\(global\)\s*\z", ""))
    return usage.withColumn("device_name", short_host("observer_hostname")).withColumn("rule_name", rule)


def _in_window(usage: DataFrame, since: TimeArg, until: TimeArg, as_of: TimeArg) -> DataFrame:
    df = usage.filter((F.col("bucket_start") >= ts_lit(parse_time(since, as_of))) & (F.col("bucket_start") < ts_lit(parse_time(until, as_of))))
    if "inserted_at" in usage.columns:
        df = latest_by_key(df, USAGE_KEYS, "inserted_at")
    return df


def rule_usage(
    rules: DataFrame, usage: DataFrame, as_of: TimeArg, *, since: TimeArg = "now-24h", until: TimeArg = "now",
) -> DataFrame:
    """Hourly buckets of each requested ``(device_name, rule_name)`` over [since, until)."""
    wanted = rules.select("device_name", "rule_name").distinct()
    rows = lookup_join(usage_for_join(_in_window(usage, since, until, as_of)), wanted, ["device_name", "rule_name"])
    return rows.groupBy("device_name", "rule_name", "bucket_start", "provider").agg(
        F.sum("sessions").alias("sessions"), F.sum("bytes").alias("bytes")
    )


def rule_usage_totals(rules: DataFrame, buckets: DataFrame, policies: DataFrame) -> DataFrame:
    """Totals per requested rule next to the device's own counter (NULL when not collected)."""
    keys = ["device_name", "rule_name"]
    totals = buckets.groupBy(*keys).agg(F.sum("sessions").alias("total_sessions"), F.sum("bytes").alias("total_bytes"))
    counters = policies.groupBy(*keys).agg(F.max("hit_count").alias("device_hit_count"))
    return rules.select(*keys).distinct().join(totals, keys, "left").join(counters, keys, "left").select(
        *keys, F.coalesce("total_sessions", F.lit(0)).alias("total_sessions"),
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"), "device_hit_count",
    )


def rule_history(rules: DataFrame, versions: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest versions of each requested rule; all of them with ``limit=None``."""
    keys = ["device_name", "rule_name"]
    rows = lookup_join(versions, rules.select(*keys).distinct(), keys)
    cut = rows if limit is None else top_rows(rows, keys, [F.col("valid_from").desc(), F.col("content_hash")], int(limit))
    return cut.select(*keys, "valid_from", "content_hash", "action", "from_zone", "to_zone", "enabled", "position")


def log_coverage(devices: DataFrame, usage: DataFrame, as_of: TimeArg, *, since: TimeArg = UNUSED_WINDOW, until: TimeArg = "now") -> DataFrame:
    """Whether the rollup has a bucket near both ends of the window, per device."""
    lo, hi = parse_time(since, as_of), parse_time(until, as_of)
    bounds = usage_for_join(_in_window(usage, since, until, as_of)).groupBy("device_name").agg(
        F.min("bucket_start").alias("min_bucket"), F.max("bucket_start").alias("max_bucket"), F.count(F.lit(1)).alias("buckets")
    )
    covered = (F.col("min_bucket") <= ts_lit(lo + COVERAGE_START_SLACK)) & (F.col("max_bucket") >= ts_lit(hi - COVERAGE_END_SLACK))
    return devices.select("device_name").distinct().join(bounds, "device_name", "left").select(
        "device_name", "min_bucket", "max_bucket", F.coalesce("buckets", F.lit(0)).alias("buckets"),
        F.coalesce(covered, F.lit(False)).alias("log_coverage"),
    )


def unused_rules(
    policies: DataFrame, usage: DataFrame, as_of: TimeArg, *, since: TimeArg = UNUSED_WINDOW, until: TimeArg = "now",
) -> DataFrame:
    """used, unused or unknown per configured rule, with the evidence.

    Two independent signals must agree: the log rollup and the device's hit
    counter.  Whenever either is missing, old or contradicts the other, the
    verdict is unknown.  A missing counter is never read as zero.
    """
    keys = ["device_name", "rule_name"]
    window = usage_for_join(_in_window(usage, since, until, as_of))
    used = window.groupBy(*keys).agg(F.max(F.col("sessions") > 0).alias("_used"))
    coverage = log_coverage(policies, usage, as_of, since=since, until=until).select("device_name", "log_coverage")
    rows = policies.select(*keys, "hit_count", "hit_count_collected_at").join(used, keys, "left").join(coverage, "device_name", "left")
    log_used = F.coalesce("_used", F.lit(False))
    known = F.col("hit_count").isNotNull() & F.col("hit_count_collected_at").isNotNull()
    stale = F.col("hit_count_collected_at") < ts_lit(parse_time(until, as_of) - COUNTER_MAX_AGE)
    counter_used = F.col("hit_count") > 0
    collected = F.date_format("hit_count_collected_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    reason = (
        F.when(~F.col("log_coverage"), REASON_NO_LOGS).when(~known, REASON_NO_COUNTER)
        .when(stale, F.concat(F.lit(f"{REASON_STALE} (collected "), collected, F.lit(")")))
        .when(log_used != counter_used, REASON_DISAGREE).otherwise(REASON_AGREE)
    )
    status = F.when(reason == REASON_AGREE, F.when(log_used, "used").otherwise("unused")).otherwise("unknown")
    return rows.select(
        *keys, status.alias("status"), reason.alias("reason"), "log_coverage", log_used.alias("log_used"),
        F.col("hit_count").alias("device_hit_count"), "hit_count_collected_at",
    )


def explain_rule(
    rules: DataFrame, policies: DataFrame, usage: DataFrame, versions: DataFrame, as_of: TimeArg, *,
    since: TimeArg = UNUSED_WINDOW, until: TimeArg = "now", recent_versions: int | None = 5,
) -> DataFrame:
    """Configuration, usage, last versions, verdict and a summary line per requested rule.

    A rule that no configuration has gets a row with ``found`` false.  ``version_count``
    counts all versions, of which ``recent_versions`` (``None``: all) are listed.
    """
    keys = ["device_name", "rule_name"]
    wanted = rules.select(*keys).distinct()
    config = policies.join(wanted, keys, "left_semi").select(*keys, "action", "from_zone", "to_zone", "enabled", F.col("position").cast("string").alias("position"), "hit_count", "hit_count_collected_at")
    totals = rule_usage_totals(wanted, rule_usage(wanted, usage, as_of, since=since, until=until), policies)
    verdicts = unused_rules(config, usage, as_of, since=since, until=until).select(*keys, "status", "reason")
    history = rule_history(wanted, versions, recent_versions)
    recent = history.groupBy(*keys).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("valid_from", "content_hash", "action", "enabled", "position")))).alias("recent_versions")
    )
    counted = lookup_join(versions.select(*keys), wanted, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("version_count"))
    joined = (
        wanted.join(config.drop("hit_count", "hit_count_collected_at").withColumn("found", F.lit(True)), keys, "left")
        .join(totals, keys, "left").join(verdicts, keys, "left").join(recent, keys, "left").join(counted, keys, "left")
        .withColumns({"found": F.coalesce("found", F.lit(False)), "version_count": F.coalesce("version_count", F.lit(0))})
    )
    summary = F.format_string(
        "%s on %s: action=%s, enabled=%s, sessions_in_window=%s, device_hit_count=%s, usage_status=%s.",
        F.col("rule_name"), F.col("device_name"), F.col("action"), F.col("enabled").cast("string"),
        F.col("total_sessions").cast("string"), F.coalesce(F.col("device_hit_count").cast("string"), F.lit("none")), F.col("status"),
    )
    missing = F.format_string("%s on %s: not_found.", F.col("rule_name"), F.col("device_name"))
    return joined.withColumn("summary", F.when(F.col("found"), summary).otherwise(missing))
