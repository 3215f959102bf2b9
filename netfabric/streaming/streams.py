"""Streaming normalisation, rollups, deduplication, liveness and micro-batch resolvers.

Every function that starts a query takes its own checkpoint location.  Sinks
are idempotent: a batch that is run again overwrites or re-merges its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netfabric.functions.ids import text
from netfabric.operators.metrics import BUCKET_SECONDS, CONNECTION_TUPLE, SERIES_KEYS
from netfabric.operators.policy import USAGE_KEYS
from netfabric.operators.upsert import upsert_table
from netfabric.plans.normalise import normalise_events
from netfabric.sources.writers import with_event_date, write_events

# How late an event may be.
USAGE_LATENESS = "3 hours"
METRIC_LATENESS = "1 hour"


def _start(stream: DataFrame, checkpoint: str, handler: Callable[[DataFrame, int], None], mode: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handler)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_normalised(raw: DataFrame, hash_key: bytes, devices: tuple[str, ...] | None = None) -> DataFrame:
    """A stream of events from a stream of raw lines; stateless, so any sink in append mode works."""
    return normalise_events(raw, hash_key, devices)


def start_normaliser(
    raw: DataFrame, path: str, checkpoint: str, hash_key: bytes, devices: tuple[str, ...] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Raw lines to the event table, in the layout of :func:`write_events`.

    A batch is read once although several normalisers look at it.  Only the first
    batch of a run can repeat one whose files were written before a failure, so it is
    merged by event id into the days it touches; the others are appended.
    """
    first = [True]

    def handle(batch: DataFrame, _batch_id: int) -> None:
        batch = batch.persist()
        try:
            events = normalise_events(batch, hash_key, devices)
            if first[0]:
                upsert_table(with_event_date(events), path, ["event_id"], ["timestamp"], ["event_date"])
            else:
                write_events(events, path)
            first[0] = False
        finally:
            batch.unpersist()

    return _start(raw, checkpoint, handle, "append", trigger)


def rule_usage_stream(events: DataFrame, lateness: str = USAGE_LATENESS) -> DataFrame:
    """Hourly rule usage; late events count until the watermark passes their hour."""
    named = events.filter(text("rule_name") != "").withWatermark("timestamp", lateness)
    grouped = named.groupBy(
        F.window("timestamp", "1 hour").alias("w"), "tenant_id", F.col("event_provider").alias("provider"), "observer_hostname", "rule_name"
    ).agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.coalesce("network_bytes", F.lit(0))).alias("bytes"))
    return grouped.select("tenant_id", F.col("w.start").alias("bucket_start"), "provider", "observer_hostname", "rule_name", "sessions", "bytes")


def start_rule_usage(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, lateness: str = USAGE_LATENESS) -> StreamingQuery:
    """Merges every updated bucket into the rollup table, by day of the bucket."""
    def handle(batch: DataFrame, _batch_id: int) -> None:
        rows = batch.withColumn("inserted_at", F.current_timestamp()).withColumn("bucket_date", F.to_date("bucket_start"))
        upsert_table(rows, path, USAGE_KEYS, ["inserted_at", "sessions"], ["bucket_date"])

    return _start(rule_usage_stream(events, lateness), checkpoint, handle, "update", trigger)


def metric_stream(events: DataFrame, metric: str, bucket_seconds: int = BUCKET_SECONDS, lateness: str = METRIC_LATENESS) -> DataFrame:
    """Values per tenant and bucket over flow events, for append mode.

    Connections are distinct tuples: duplicates are dropped within their bucket
    first (state is released with the watermark) and the rest is counted.
    """
    flows = events.filter(F.col("event_action").startswith("flow_")).withWatermark("timestamp", lateness)
    bucket = F.window("timestamp", f"{bucket_seconds} seconds")
    if metric == "connections":
        tagged = flows.select("tenant_id", bucket.alias("w"), *[F.col(c) for c in CONNECTION_TUPLE])
        counted = tagged.dropDuplicates(["tenant_id", "w", *CONNECTION_TUPLE]).groupBy("tenant_id", "w").agg(F.count(F.lit(1)).cast("double").alias("value"))
    elif metric in ("bytes", "flows"):
        value = F.sum(F.coalesce("network_bytes", F.lit(0))) if metric == "bytes" else F.count(F.lit(1))
        counted = flows.groupBy("tenant_id", bucket.alias("w")).agg(value.cast("double").alias("value"))
    else:
        raise ValueError(f"no stream for metric {metric!r}")
    return counted.select("tenant_id", F.col("w.start").alias("bucket_start"), F.lit(metric).alias("metric"), F.lit("").alias("dim"), "value")


def start_metrics(
    events: DataFrame, metric: str, path: str, checkpoint: str, trigger: dict | None = None, bucket_seconds: int = BUCKET_SECONDS,
    lateness: str = METRIC_LATENESS,
) -> StreamingQuery:
    """Finished buckets into the series table, merged by tenant, metric and bucket, by day of the bucket."""
    def handle(batch: DataFrame, _batch_id: int) -> None:
        rows = batch.withColumn("inserted_at", F.current_timestamp()).withColumn("bucket_date", F.to_date("bucket_start"))
        upsert_table(rows, path, SERIES_KEYS, ["inserted_at", "value"], ["bucket_date"])

    return _start(metric_stream(events, metric, bucket_seconds, lateness), checkpoint, handle, "append", trigger)


def dedup_stream(blocks: DataFrame, ts: str = "received_at", lateness: str = "1 hour", token: str = "token") -> DataFrame:
    """First block per token within the watermark; the bound is time, so state stays bounded."""
    return blocks.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([token])


def last_event_stream(events: DataFrame) -> DataFrame:
    """Newest event per (tenant, logging device, provider); one state row each, for update mode."""
    seen = events.filter(text("observer_hostname") != "")
    return seen.groupBy("tenant_id", "observer_hostname", F.col("event_provider").alias("provider")).agg(F.max("timestamp").alias("last_event"))


def start_resolver(
    stream: DataFrame, resolve: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Runs a batch resolver on every micro-batch, the streaming form of a timer."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            resolve(batch, batch_id)
        finally:
            batch.unpersist()

    return _start(stream, checkpoint, handle, "append", trigger)
