"""Public traffic metrics and de-identification."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.functions.ids import DEFAULT_TENANT, hmac_sha256
from netfabric.functions.skew import lookup_join, with_rank
from netfabric.functions.siphash import siphash128_batched
from netfabric.functions.timeargs import parse_time, ts_lit, window_filter
from netfabric.operators.upsert import latest_by_key

TimeArg = str | datetime


@dataclass(frozen=True)
class Measure:
    """One published measure: whether it is on, and whether it has a per-entity series."""

    metric: str
    enabled: bool
    per_entity: bool
    kind: str


# The measure catalogue, action names, prefixes and defaults.
CATALOG = (
    Measure("bytes", True, True, "aggregate"),
    Measure("flows", True, False, "aggregate"),
    Measure("connections", True, False, "aggregate"),
    Measure("deny_rate_index", True, False, "index"),
    Measure("ips_volume_index", True, False, "index"),
    Measure("mem_util_pct", False, False, "aggregate"),
    Measure("cpu_util_pct", False, False, "aggregate"),
    Measure("iface_error_rate", False, False, "aggregate"),
    Measure("port_flap_count", False, False, "aggregate"),
    Measure("proto_flap_count", False, False, "aggregate"),
)
DENY_ACTIONS = ("deny", "drop", "block", "reject")
DENY_PROVIDERS = ("paloalto", "juniper")
SURROGATE_PREFIX = {"host": "h_", "firewall": "fw_", "segment": "seg_", "port": "p_", "vmid": "vm_"}
SURROGATE_BASE_LENGTH = 10
DIGEST_LENGTH = 64
SKETCH_PRECISION = 14
BUCKET_SECONDS = 300
LOOKBACK_HOURS = 1
BASELINE_DAYS = 30
TOP_ENTITIES = 20
CONNECTION_TUPLE = ("source_ip", "source_port", "destination_ip", "destination_port", "network_transport")


def enabled_measures() -> list[Measure]:
    return [m for m in CATALOG if m.enabled]


def _measure(metric: str) -> Column:
    if metric == "bytes":
        value = F.sum(F.coalesce(F.col("network_bytes"), F.lit(0)))
    elif metric == "flows":
        value = F.count(F.lit(1))
    elif metric == "connections":
        # A struct is never NULL, so tuples with NULL parts are counted too.
        value = F.count_distinct(F.struct(*CONNECTION_TUPLE))
    else:
        raise ValueError(f"no aggregate for metric {metric!r}")
    return value.cast("double").alias("value")


def _flow_events(events: DataFrame, tenant: str | None, since: TimeArg, as_of: TimeArg) -> DataFrame:
    df = events if tenant is None else events.filter(F.col("tenant_id") == tenant)
    return df.filter(F.col("event_action").startswith("flow_")).filter(
        window_filter("timestamp", since, None, as_of)
    )


def _bucket(seconds: int) -> Column:
    return F.window("timestamp", f"{seconds} seconds")["start"].alias("bucket_start")


def metric_series(
    events: DataFrame, metric: str, as_of: TimeArg, *, since: TimeArg = f"now-{LOOKBACK_HOURS}h",
    bucket_seconds: int = BUCKET_SECONDS, tenant: str | None = DEFAULT_TENANT,
) -> DataFrame:
    """Aggregate value per time bucket over flow events."""
    grouped = _flow_events(events, tenant, since, as_of).groupBy(_bucket(bucket_seconds))
    return grouped.agg(_measure(metric)).select(
        "bucket_start", F.lit(metric).alias("metric"), F.lit("").alias("dim"), "value"
    )


def entity_series(
    events: DataFrame, metric: str, as_of: TimeArg, *, since: TimeArg = f"now-{LOOKBACK_HOURS}h",
    bucket_seconds: int = BUCKET_SECONDS, tenant: str | None = DEFAULT_TENANT,
) -> DataFrame:
    """The same per source address and bucket."""
    df = _flow_events(events, tenant, since, as_of).filter(F.col("source_ip").isNotNull())
    return df.groupBy(_bucket(bucket_seconds), F.col("source_ip").alias("ip")).agg(_measure(metric)).select(
        "bucket_start", "ip", F.lit(metric).alias("metric"), "value"
    )


def connection_sketches(
    events: DataFrame, as_of: TimeArg, *, since: TimeArg = f"now-{LOOKBACK_HOURS}h", bucket_seconds: int = BUCKET_SECONDS,
    tenant: str | None = DEFAULT_TENANT, precision: int = SKETCH_PRECISION,
) -> DataFrame:
    """``(bucket_start, sketch)``: the connections of each bucket as a sketch of a few kilobytes that merges.

    Beside the exact :func:`metric_series`; coarser buckets come from the sketches by
    :func:`roll_up_sketches`, without another scan of events.
    """
    tuple_hash = F.xxhash64(*[F.col(c) for c in CONNECTION_TUPLE])
    df = _flow_events(events, tenant, since, as_of)
    return df.groupBy(_bucket(bucket_seconds)).agg(F.hll_sketch_agg(tuple_hash, precision).alias("sketch"))


def roll_up_sketches(sketches: DataFrame, bucket_seconds: int) -> DataFrame:
    """Sketches of wider buckets; a connection seen in several counts once, as it would in a scan."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("bucket_start") / bucket_seconds) * bucket_seconds)
    return sketches.groupBy(start.alias("bucket_start")).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketch_series(sketches: DataFrame) -> DataFrame:
    """The estimated number of connections per bucket; the standard error is about 1.04 / 2^(precision / 2)."""
    return sketches.select("bucket_start", F.lit("connections").alias("metric"), F.hll_sketch_estimate("sketch").alias("value"))


def top_entities(series: DataFrame, n: int = TOP_ENTITIES, entity: str = "ip") -> DataFrame:
    """The buckets of the ``n`` entities with the largest total."""
    leaders = (
        series.groupBy(entity).agg(F.sum("value").alias("_total"))
        .orderBy(F.col("_total").desc(), entity).limit(n).select(entity)
    )
    return lookup_join(series, leaders, entity, "left_semi")


def surrogate(kind: str, real_value: Column | str, key: bytes, length: int = SURROGATE_BASE_LENGTH) -> Column:
    """Keyed surrogate of a value: the kind's prefix and ``length`` hex digits."""
    if kind not in SURROGATE_PREFIX:
        raise ValueError(f"unknown pseudonym kind: {kind}")
    value = F.col(real_value) if isinstance(real_value, str) else real_value
    digest = hmac_sha256(F.concat(F.lit(f"{kind}:"), value), key)
    return F.concat(F.lit(SURROGATE_PREFIX[kind]), F.substring(digest, 1, length))


def mint_surrogates(
    values: DataFrame, pseudonyms: DataFrame, kind: str, key: bytes, key_version: int, seen_at: TimeArg,
    base_length: int = SURROGATE_BASE_LENGTH,
) -> DataFrame:
    """Pseudonym rows for ``values(real_value)``; known values keep their surrogate.

    A value whose digest prefix is shared with another value of the batch or of
    the map takes the shortest longer slice that nobody else has.  Only those
    few crowded prefixes are expanded into candidate lengths.
    """
    prefix = SURROGATE_PREFIX[kind]
    known = pseudonyms.filter((F.col("kind") == kind) & (F.col("key_version") == key_version))
    known = latest_by_key(known, ["kind", "real_value", "key_version"], "last_seen")
    wanted = values.select("real_value").filter(F.col("real_value").isNotNull()).distinct()
    moment = ts_lit(parse_time(seen_at))

    kept = wanted.join(known.select("real_value", "surrogate", "first_seen"), "real_value")
    fresh = wanted.join(known.select("real_value"), "real_value", "left_anti").withColumn(
        "_digest", hmac_sha256(F.concat(F.lit(f"{kind}:"), F.col("real_value")), key)
    ).withColumn("_stem", F.substring("_digest", 1, base_length))

    # Surrogates of every key version stay taken: a reader must not meet one
    # surrogate for two values.
    taken = pseudonyms.filter(F.col("kind") == kind).select("surrogate").distinct()
    taken_stems = taken.select(F.substring("surrogate", len(prefix) + 1, base_length).alias("_stem"))
    crowded = (
        fresh.select("_stem").unionAll(taken_stems).groupBy("_stem").agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1).select("_stem")
    )
    lone = fresh.join(crowded, "_stem", "left_anti").select(
        "real_value", F.concat(F.lit(prefix), F.col("_stem")).alias("surrogate")
    )
    lengths = F.array(*[F.lit(n) for n in range(base_length, DIGEST_LENGTH + 1, 2)])
    candidates = fresh.join(crowded, "_stem", "left_semi").select(
        "real_value", "_digest", F.explode(lengths).alias("_len")
    ).select("real_value", "_len", F.concat(F.lit(prefix), F.expr("substring(_digest, 1, _len)")).alias("surrogate"))
    unique = (
        candidates.groupBy("surrogate").agg(
            F.count(F.lit(1)).alias("_n"), F.min("real_value").alias("real_value"), F.min("_len").alias("_len")
        )
        .filter(F.col("_n") == 1)
        .join(taken, "surrogate", "left_anti")
    )
    longer = unique.groupBy("real_value").agg(F.min_by("surrogate", "_len").alias("surrogate"))
    minted = lone.unionByName(longer).withColumn("first_seen", moment)
    return kept.unionByName(minted).select(
        F.lit(kind).alias("kind"), "real_value", "surrogate", F.lit(key_version).alias("key_version"),
        "first_seen", moment.alias("last_seen"),
    )


def public_nodes(nodes: DataFrame, key: tuple[int, int]) -> DataFrame:
    """Publishable node columns only; ids are keyed hashes that still join.  ``key`` is two unsigned longs."""
    return nodes.select(
        siphash128_batched("node_id", key).alias("node_id"), "tenant_id", "kind", "first_seen", "last_seen"
    )


def public_edges(edges: DataFrame, key: tuple[int, int]) -> DataFrame:
    return edges.select(
        siphash128_batched("edge_id", key).alias("edge_id"), "tenant_id",
        siphash128_batched("src_id", key).alias("src_id"), siphash128_batched("dst_id", key).alias("dst_id"),
        "edge_type", "layer", "first_seen", "last_seen", "confidence",
    )


def ratio_to_baseline(current: Column, baseline: Column) -> Column:
    """current / baseline; a zero baseline gives 0."""
    cur, base = current.cast("double"), baseline.cast("double")
    return F.when(base == 0, F.lit(0.0)).otherwise(cur / base)


def _index_row(df: DataFrame, metric: str, since: datetime, bucket_seconds: int) -> DataFrame:
    # The bucket is floored, so runs inside one bucket write one key.
    floored = datetime.fromtimestamp(int(since.timestamp()) // bucket_seconds * bucket_seconds, since.tzinfo)
    return df.select(
        ts_lit(floored).alias("bucket_start"), F.lit(metric).alias("metric"), F.lit("").alias("dim"), "value"
    )


def deny_rate_index(
    events: DataFrame, as_of: TimeArg, *, since: TimeArg = f"now-{LOOKBACK_HOURS}h",
    baseline: TimeArg = f"now-{BASELINE_DAYS}d", bucket_seconds: int = BUCKET_SECONDS,
    tenant: str | None = DEFAULT_TENANT,
) -> DataFrame:
    """Share of denied flows now over the share in the baseline, in one scan.

    A flow is denied when the last ``_`` part of its action is a deny word.
    """
    cur, base = parse_time(since, as_of), parse_time(baseline, as_of)
    df = _flow_events(events, tenant, min(cur, base), as_of).filter(F.col("event_provider").isin(*DENY_PROVIDERS))
    denied = F.element_at(F.split("event_action", "_"), -1).isin(*DENY_ACTIONS)
    in_cur, in_base = F.col("timestamp") >= ts_lit(cur), F.col("timestamp") >= ts_lit(base)
    counts = df.agg(
        F.count_if(denied & in_cur).alias("cd"), F.count_if(in_cur).alias("ct"),
        F.count_if(denied & in_base).alias("bd"), F.count_if(in_base).alias("bt"),
    )
    value = ratio_to_baseline(
        ratio_to_baseline(F.col("cd"), F.col("ct")), ratio_to_baseline(F.col("bd"), F.col("bt"))
    )
    return _index_row(counts.select(value.alias("value")), "deny_rate_index", cur, bucket_seconds)


def ips_volume_index(
    events: DataFrame, as_of: TimeArg, *, since: TimeArg = f"now-{LOOKBACK_HOURS}h",
    baseline: TimeArg = f"now-{BASELINE_DAYS}d", bucket_seconds: int = BUCKET_SECONDS,
    tenant: str | None = DEFAULT_TENANT, per_hour: bool = False, provider: str = "unifi",
) -> DataFrame:
    """Detections now over detections in the baseline; ``per_hour`` compares hourly rates."""
    cur, base = parse_time(since, as_of), parse_time(baseline, as_of)
    now = parse_time(as_of)
    df = events if tenant is None else events.filter(F.col("tenant_id") == tenant)
    df = df.filter(F.col("timestamp") >= ts_lit(min(cur, base))).filter(
        (F.col("event_provider") == provider) & (F.col("event_kind") == "alert")
    )
    counts = df.agg(
        F.count_if(F.col("timestamp") >= ts_lit(cur)).alias("c"),
        F.count_if(F.col("timestamp") >= ts_lit(base)).alias("b"),
    )
    hour = timedelta(hours=1)
    scale = ((now - base) / hour) / ((now - cur) / hour) if per_hour else 1.0
    value = ratio_to_baseline(F.col("c"), F.col("b")) * F.lit(scale)
    return _index_row(counts.select(value.alias("value")), "ips_volume_index", cur, bucket_seconds)


SERIES_KEYS = ("tenant_id", "metric", "dim", "bucket_start")
ENTITY_SERIES_KEYS = ("tenant_id", "metric", "surrogate", "bucket_start")


def _current_series(
    series: DataFrame, keys: tuple[str, ...], metric: str, since: TimeArg, until: TimeArg | None,
    as_of: TimeArg, tenant: str,
) -> DataFrame:
    # Filters are on key columns, so they are safe before the version collapse.
    df = series.filter((F.col("tenant_id") == tenant) & (F.col("metric") == metric))
    df = df.filter(window_filter("bucket_start", since, until, as_of))
    return latest_by_key(df, keys, "inserted_at")


def metric_timeseries(
    series: DataFrame, metric: str, as_of: TimeArg, *, since: TimeArg = "now-24h",
    until: TimeArg | None = None, tenant: str = DEFAULT_TENANT,
) -> DataFrame:
    """Aggregate series of one metric, current versions only, in time order."""
    df = _current_series(series.filter(F.col("dim") == ""), SERIES_KEYS, metric, since, until, as_of, tenant)
    return df.select("bucket_start", "value").orderBy("bucket_start")


def metric_total(series: DataFrame, metric: str, as_of: TimeArg, *, since: TimeArg = "now-24h", tenant: str = DEFAULT_TENANT) -> DataFrame:
    return metric_timeseries(series, metric, as_of, since=since, tenant=tenant).agg(
        F.sum("value").cast("long").alias("total")
    )


def top_series(
    series: DataFrame, metric: str, as_of: TimeArg, *, since: TimeArg = "now-24h", limit: int = 10,
    tenant: str = DEFAULT_TENANT,
) -> DataFrame:
    """Surrogates with the largest total."""
    df = _current_series(series, ENTITY_SERIES_KEYS, metric, since, None, as_of, tenant)
    totals = df.groupBy("surrogate").agg(F.sum("value").alias("value"))
    return totals.orderBy(F.col("value").desc(), "surrogate").limit(limit)


def busiest_surrogate_total(series: DataFrame, metric: str, as_of: TimeArg, *, since: TimeArg = "now-24h", tenant: str = DEFAULT_TENANT) -> DataFrame:
    df = _current_series(series, ENTITY_SERIES_KEYS, metric, since, None, as_of, tenant)
    totals = df.groupBy("surrogate").agg(F.sum("value").alias("value"))
    return totals.agg(F.max("value").cast("long").alias("total"))


def entity_metric_timeseries(
    series: DataFrame, surrogates: DataFrame, metric: str, as_of: TimeArg, *, since: TimeArg = "now-24h",
    until: TimeArg | None = None, tenant: str = DEFAULT_TENANT,
) -> DataFrame:
    """Per-bucket series of every requested surrogate."""
    wanted = surrogates.select("surrogate").distinct()
    asked = lookup_join(series, wanted, "surrogate", "left_semi")
    df = _current_series(asked, ENTITY_SERIES_KEYS, metric, since, until, as_of, tenant)
    return df.select("surrogate", "bucket_start", "value").orderBy("surrogate", "bucket_start")


def reidentify(surrogates: DataFrame, pseudonyms: DataFrame) -> DataFrame:
    """Real value behind each surrogate, NULL when the map does not know it."""
    current = latest_by_key(pseudonyms, ["kind", "real_value", "key_version"], "last_seen")
    known = latest_by_key(current.select("surrogate", "kind", "real_value", "last_seen"), ["surrogate"], "last_seen")
    return lookup_join(
        surrogates.select("surrogate").distinct(), known.select("surrogate", "kind", "real_value"),
        "surrogate", "left",
    )


def public_topology_snapshot(
    nodes: DataFrame, edges: DataFrame, allowlist: DataFrame, as_of: TimeArg, salt: str, *,
    reachable_within_hours: float = 1.0, activity_within_hours: float = 24.0,
    max_nodes: int | None = None, max_edges: int | None = None,
) -> dict[str, DataFrame]:
    """Publishable topology: ``nodes``, ``edges`` and a one-row ``summary``.

    ``allowlist(name, site, ollama)`` names the devices cleared for display.
    Ids follow a salted digest, so their order says nothing about the names.
    Pass a fresh random salt per snapshot.  Without limits all nodes and edges are
    shown; ``truncated`` says whether a limit left any out.
    """
    now = parse_time(as_of)
    devices = nodes.filter(F.col("kind") == "device").join(allowlist, "name")
    current = latest_by_key(devices, ["name"], "last_seen")
    digest = F.sha2(F.concat(F.lit(salt), F.col("name")), 256)
    ranked = with_rank(current.withColumn("_digest", digest), [], ["_digest"], "_n")
    if max_nodes is not None:
        ranked = ranked.filter(F.col("_n") <= max_nodes)
    opaque = ranked.select(
        "node_id", F.concat(F.lit("n"), F.col("_n").cast("string")).alias("id"), "site", "ollama", "last_seen"
    )
    out_nodes = opaque.select(
        "id",
        F.coalesce(F.col("last_seen") >= ts_lit(now - timedelta(hours=reachable_within_hours)), F.lit(False)).alias("reachable"),
        "ollama", "site",
    )
    ends = opaque.select("node_id", "id", "site")
    src = ends.select(F.col("node_id").alias("src_id"), F.col("id").alias("source"), F.col("site").alias("_ss"))
    dst = ends.select(F.col("node_id").alias("dst_id"), F.col("id").alias("target"), F.col("site").alias("_ds"))
    linked = (
        edges.select("edge_id", "src_id", "dst_id", "last_seen").join(src, "src_id").join(dst, "dst_id")
        .filter(F.col("source") != F.col("target"))
        .withColumn("_lo", F.least("source", "target")).withColumn("_hi", F.greatest("source", "target"))
    )
    pairs = latest_by_key(linked, ["_lo", "_hi"], "last_seen", ["edge_id"])
    newest = pairs if max_edges is None else pairs.orderBy(F.col("last_seen").desc(), "_lo", "_hi").limit(max_edges)
    out_edges = newest.select(
        "source", "target", ((F.col("_ss") == "remote") | (F.col("_ds") == "remote")).alias("remote"),
        F.coalesce(F.col("last_seen") >= ts_lit(now - timedelta(hours=activity_within_hours)), F.lit(False)).alias("recent_activity"),
    )
    counts = (
        current.agg(F.count(F.lit(1)).alias("_all_nodes")).withColumn("_all_edges", F.lit(0))
        .unionByName(pairs.agg(F.count(F.lit(1)).alias("_all_edges")).withColumn("_all_nodes", F.lit(0)))
        .agg(F.max("_all_nodes").alias("_all_nodes"), F.max("_all_edges").alias("_all_edges"))
    )
    # least() skips a limit that is not given.
    kept = lambda n, most: F.least(F.col(n), F.lit(most).cast("long"))
    summary = counts.select(
        kept("_all_nodes", max_nodes).alias("node_count"), kept("_all_edges", max_edges).alias("edge_count"),
        ((F.col("_all_nodes") > kept("_all_nodes", max_nodes)) | (F.col("_all_edges") > kept("_all_edges", max_edges))).alias("truncated"),
    )
    return {"nodes": out_nodes, "edges": out_edges, "summary": summary}
