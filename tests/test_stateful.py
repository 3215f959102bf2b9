import os
import random
import tempfile
from datetime import timedelta, timezone

import pytest
from pyspark.sql import functions as F

from netfabric.operators.audit import calls_in_trailing_window
from netfabric.operators.liveness import ingest_status
from netfabric.streaming import stateful as sf


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_silence_equals_ingest_status_at_three_times(rocksdb, at):
    spark, root = rocksdb, tempfile.mkdtemp(prefix="nf-silence-")
    start = at("2026-06-05 00:00:00")
    hosts = ["fw1.example", "fw2", "sw1.example.net", "10.0.0.9"]
    last_of = {"fw2": 5 * 60, "sw1.example.net": 13 * 60}
    rng = random.Random(3)
    rows = [("t", h, rng.choice(["a", "b"]), start + timedelta(minutes=m))
            for h in hosts for m in sorted(rng.sample(range(0, last_of.get(h, 20 * 60)), 12 if h == "10.0.0.9" else 60))]
    events = spark.createDataFrame(rows, "tenant_id string, observer_hostname string, event_provider string, timestamp timestamp")
    expected = spark.createDataFrame([("fw1", "a"), ("never", "b"), ("fw2", None)], "name string, provider string")
    path, ckpt = os.path.join(root, "out"), tempfile.mkdtemp(prefix="nf-ckpt-")
    lo = start - timedelta(minutes=1)
    for hours in (6, 14, 20):
        hi = start + timedelta(hours=hours)
        events.filter((F.col("timestamp") > F.lit(lo)) & (F.col("timestamp") <= F.lit(hi))).coalesce(1).write.mode("append").parquet(f"{root}/events")
        lo = hi
        source = spark.readStream.schema(events.schema).parquet(f"{root}/events")
        sf.start_silence(source, expected, path, ckpt, tenant=None, lateness="0 seconds").awaitTermination()
        so_far = events.filter(F.col("timestamp") <= F.lit(hi))
        now = so_far.agg(F.max("timestamp")).first()[0]
        want = ingest_status_rows(so_far, expected, now.replace(tzinfo=timezone.utc))
        got = {r["name"]: (r["last_event"], r["stale"]) for r in spark.read.parquet(path).collect()}
        assert got == want
    assert got["never"] == (None, True) and got["fw2"][1] and not got["fw1"][1]


def ingest_status_rows(events, expected, as_of):
    nodes = expected.withColumns({
        "kind": F.lit("device"), "attrs": F.create_map(F.lit("role"), F.lit("firewall")), "identifiers": F.create_map(F.lit("provider"), "provider"),
        "tenant_id": F.lit("t"), "key": F.col("name"), "node_id": F.col("name"), "superseded_by": F.lit(""), "last_seen": F.lit(as_of),
    })
    return {r["name"]: (r["last_event"], r["stale"]) for r in ingest_status(nodes, events, as_of, tenant=None).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_trailing_calls_equal_the_batch_form_after_any_split(spark, at, seed):
    rng = random.Random(seed)
    start = at("2026-06-05 12:00:00")
    rows = [(rng.choice(["a", "a", "a", "b", None]), start + timedelta(milliseconds=rng.choice([rng.randrange(400_000), 60_000 * rng.randrange(6), 59_999]))) for _ in range(600)]
    rows.append(("late", start + timedelta(seconds=30)))
    rows.append(("a", None))
    audit = spark.createDataFrame(rows, "principal string, ts timestamp")
    want = {(r.principal, r.ts): (r.calls, r.calls_in_window, r.breach) for r in calls_in_trailing_window(audit.filter("ts IS NOT NULL"), 60, 40).collect()}
    root = tempfile.mkdtemp(prefix="nf-calls-")
    rng.shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i::4], audit.schema).coalesce(1).write.mode("append").parquet(f"{root}/calls")
    source = spark.readStream.schema(audit.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/calls")
    path = os.path.join(root, "out")
    sf.start_trailing_calls(source, path, tempfile.mkdtemp(prefix="nf-ckpt-"), window_seconds=60, max_calls=40, lateness="1 hour").awaitTermination()
    got = {(r.principal, r.ts): (r.calls, r.calls_in_window, r.breach) for r in spark.read.parquet(path).collect()}
    assert got == want and any(v[2] for v in got.values())
