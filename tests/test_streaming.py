import os
import tempfile
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from netfabric.functions.ids import dedup_token
from netfabric.operators.metrics import metric_series
from netfabric.operators.policy import rule_usage_hourly
from netfabric.operators.upsert import backfill_table, expire, partition_columns, touched_partitions, upsert_table
from netfabric.plans import adapter as ad
from netfabric.plans import lines
from netfabric.plans.normalise import normalise_events
from netfabric.sources.readers import read_raw_logs
from netfabric.sources.writers import with_event_date, write_events
from netfabric.streaming import streams as st

SF = "/root/testdata/sf0.001"
KEY = b"k"


@pytest.fixture(scope="module")
def files(spark):
    """Events written in four time-ordered files, as a stream source."""
    root = tempfile.mkdtemp(prefix="nf-stream-")
    ev = ad.events(spark, SF).drop("ext")
    for i, (lo, hi) in enumerate([(1, 8), (8, 16), (16, 24), (24, 32)]):
        day = F.dayofmonth("timestamp")
        ev.filter((day >= lo) & (day < hi)).coalesce(1).write.mode("append").parquet(f"{root}/events")
    return root, ev


def stream(spark, root, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events")


def drain(df, mode, name):
    ckpt = tempfile.mkdtemp(prefix="nf-ckpt-")
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def as_set(df, *cols):
    return sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())


def test_rule_usage_stream_equals_batch(spark, files):
    root, ev = files
    path = os.path.join(tempfile.mkdtemp(prefix="nf-out-"), "usage")
    q = st.start_rule_usage(stream(spark, root, ev.schema), path, tempfile.mkdtemp(prefix="nf-ckpt-"), lateness="40 days")
    q.awaitTermination()
    cols = ["bucket_start", "provider", "observer_hostname", "rule_name", "sessions", "bytes"]
    assert as_set(spark.read.parquet(path), *cols) == as_set(rule_usage_hourly(ev, ad.AS_OF, 24 * 30), *cols)


@pytest.mark.parametrize("metric", ["bytes", "flows", "connections"])
def test_metric_stream_equals_batch_up_to_the_watermark(spark, files, metric):
    root, ev = files
    got = drain(st.metric_stream(stream(spark, root, ev.schema), metric, lateness="40 days"), "append", f"m_{metric}")
    # Nothing has passed a 40-day watermark, so a second run with a short one is compared.
    assert got.count() == 0
    got = drain(st.metric_stream(spark.readStream.schema(ev.schema).parquet(f"{root}/events"), metric, lateness="1 hour"), "append", f"s_{metric}")
    batch = metric_series(ev, metric, ad.AS_OF, since=ad.SINCE)
    newest = got.agg(F.max("bucket_start")).first()[0]
    assert as_set(got, "bucket_start", "value") == as_set(batch.filter(F.col("bucket_start") <= F.lit(newest)), "bucket_start", "value")


def test_dedup_stream_drops_retries(spark, at):
    root = tempfile.mkdtemp(prefix="nf-dedup-")
    rows = [("srv", "run", i % 5, at("2026-06-05 12:00:00")) for i in range(10)]
    df = spark.createDataFrame(rows, "server_id string, run_id string, segment_seq long, received_at timestamp")
    df.withColumn("token", dedup_token("server_id", "run_id", "segment_seq")).write.mode("append").parquet(root)
    src = spark.readStream.schema(spark.read.parquet(root).schema).parquet(root)
    assert drain(st.dedup_stream(src), "append", "dedup_out").count() == 5


def test_last_event_stream_equals_batch(spark, files):
    root, ev = files
    got = drain(st.last_event_stream(stream(spark, root, ev.schema)), "complete", "last_seen")
    batch = ev.filter("observer_hostname <> ''").groupBy("observer_hostname", "event_provider").agg(F.max("timestamp").alias("last_event"))
    assert as_set(got, "observer_hostname", "last_event") == as_set(batch, "observer_hostname", "last_event")


def test_normaliser_stream_equals_batch_and_replays_cleanly(spark):
    root = tempfile.mkdtemp(prefix="nf-raw-")
    raw = lines.all_lines(spark, SF).select("received_at", "feed", "message")
    raw.repartition(3).write.mode("append").parquet(f"{root}/raw")
    src = read_raw_logs(spark, f"{root}/raw", streaming=True, fmt="parquet")
    out, ckpt = f"{root}/events", f"{root}/ckpt"
    st.start_normaliser(src, out, ckpt, KEY).awaitTermination()
    # A second run over the same checkpoint finds nothing new.
    st.start_normaliser(src, out, ckpt, KEY).awaitTermination()
    got = spark.read.parquet(out)
    want = normalise_events(raw, KEY)
    cols = ["event_id", "timestamp", "event_action", "user_name", "source_ip", "raw"]
    assert as_set(got, *cols) == as_set(want, *cols)


def test_streamed_events_can_be_backfilled_and_expired(spark):
    """Stream, replay, batch append, backfill and expiry share one layout."""
    root = tempfile.mkdtemp(prefix="nf-layout-")
    raw = lines.all_lines(spark, SF).select("received_at", "feed", "message")
    raw.repartition(2).write.mode("append").parquet(f"{root}/raw")
    src = read_raw_logs(spark, f"{root}/raw", streaming=True, fmt="parquet")
    out = f"{root}/events"
    st.start_normaliser(src, out, f"{root}/ckpt", KEY).awaitTermination()
    # A lost checkpoint repeats every batch; the first is merged by event id.
    st.start_normaliser(src, out, f"{root}/again", KEY).awaitTermination()
    before = spark.read.parquet(out)
    want = normalise_events(raw, KEY)
    assert before.count() == want.count() and partition_columns(spark, out) == ["event_date"]
    count, ids = before.count(), before.select("event_id").distinct().count()
    backfill_table(spark, out, "timestamp", F.col("event_provider") == "paloalto", timedelta(hours=30))
    after = spark.read.parquet(out)
    assert (after.count(), after.select("event_id").distinct().count()) == (count, ids)
    assert after.filter("event_date <> to_date(timestamp)").count() == 0
    write_events(want.limit(1).withColumn("event_id", F.lit("new")), out)
    assert spark.read.parquet(out).count() == count + 1
    newest = after.agg(F.max("timestamp")).first()[0]
    kept = expire(spark.read.parquet(out), "timestamp", 5, newest, "event_date")
    assert 0 < kept.count() < count


def test_backfill_refuses_another_layout(spark):
    root = tempfile.mkdtemp(prefix="nf-odd-")
    events = with_event_date(spark.sql("SELECT 'a' AS event_id, TIMESTAMP '2026-06-05 12:00:00' AS timestamp"))
    events.withColumn("batch_id", F.lit(1)).write.partitionBy("batch_id", "event_date").parquet(f"{root}/t")
    with pytest.raises(ValueError, match="partitioned by"):
        backfill_table(spark, f"{root}/t", "timestamp", F.lit(True), timedelta(hours=1))
    assert spark.read.parquet(f"{root}/t").count() == 1


def test_upserts_read_only_touched_partitions(spark):
    root = tempfile.mkdtemp(prefix="nf-prune-")
    days = spark.range(30).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    upsert_table(days, f"{root}/t", ["k"], "v", ["d"])
    new = days.filter("k IN (3, 4)").withColumn("v", F.lit(2))
    plan = spark.read.schema(new.schema).parquet(f"{root}/t").filter(touched_partitions(new, ["d"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2026-01-04" in plan.split("PartitionFilters: [")[1].split("]")[0]
    upsert_table(new, f"{root}/t", ["k"], "v", ["d"])
    assert spark.read.parquet(f"{root}/t").groupBy("v").count().orderBy("v").collect() == [(1, 28), (2, 2)]


def test_metric_sink_keeps_tenants_apart(spark, files):
    root, ev = files
    two = tempfile.mkdtemp(prefix="nf-tenants-")
    both = ev.unionByName(ev.filter("source_port % 2 = 0").withColumn("tenant_id", F.lit("other")))
    both.coalesce(1).write.mode("append").parquet(f"{two}/events")
    for metric in ("bytes", "connections"):
        path = f"{two}/{metric}"
        source = spark.readStream.schema(both.schema).parquet(f"{two}/events")
        st.start_metrics(source, metric, path, f"{two}/ckpt-{metric}", lateness="1 hour").awaitTermination()
        got = spark.read.parquet(path)
        newest = F.lit(got.agg(F.max("bucket_start")).first()[0])
        for tenant in [r[0] for r in both.select("tenant_id").distinct().collect()]:
            batch = metric_series(both, metric, ad.AS_OF, since=ad.SINCE, tenant=tenant)
            assert as_set(got.filter(F.col("tenant_id") == tenant), "bucket_start", "value") == as_set(
                batch.filter(F.col("bucket_start") <= newest), "bucket_start", "value")


def test_resolver_sees_every_batch(spark, files):
    root, ev = files
    seen = []
    q = st.start_resolver(stream(spark, root, ev.schema), lambda b, i: seen.append(b.count()), tempfile.mkdtemp(prefix="nf-ckpt-"))
    q.awaitTermination()
    assert len(seen) >= 4 and sum(seen) == ev.count()
