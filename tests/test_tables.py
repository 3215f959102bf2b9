import glob
import json
import os
import tempfile
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from netfabric.operators import upsert as up
from netfabric.plans import adapter as ad
from netfabric.plans.queries import load_all
from netfabric.plans.resolve import public_metrics_run
from netfabric.sources import readers, writers

SF = "/root/testdata/sf0.001"


def folder():
    return os.path.join(tempfile.mkdtemp(prefix="nf-table-"), "t")


def test_upsert_table_rewrites_only_touched_partitions(spark, at):
    path = folder()
    cols = "k string, day string, v long, ver long"
    up.upsert_table(spark.createDataFrame([("a", "d1", 1, 1), ("b", "d2", 1, 1)], cols), path, ["k"], "ver", ["day"])
    untouched = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/day=d2/*.parquet")}
    new = spark.createDataFrame([("a", "d1", 9, 2), ("c", "d1", 5, 1)], cols)
    for _ in range(2):  # a repeated run changes nothing
        up.upsert_table(new, path, ["k"], "ver", ["day"])
        got = sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
        assert got == [("a", 9), ("b", 1), ("c", 5)]
    assert {f: os.path.getmtime(f) for f in glob.glob(f"{path}/day=d2/*.parquet")} == untouched
    up.upsert_table(spark.createDataFrame([("a", "d1", 0, 1)], cols), path, ["k"], "ver", ["day"])
    assert spark.read.parquet(path).filter("k = 'a'").first().v == 9
    assert not glob.glob(f"{path}__staging*/*")


def test_backfill_moves_rows_between_days_and_keeps_counts(spark, at):
    path = folder()
    rows = [("1", at("2026-06-05 02:00:00"), "paloalto"), ("2", at("2026-06-05 03:00:00"), "juniper"), ("3", at("2026-06-07 01:00:00"), "paloalto")]
    df = spark.createDataFrame(rows, "event_id string, timestamp timestamp, event_provider string").withColumn("tenant_id", F.lit("t_main"))
    writers.write_events(df, path)
    up.backfill_table(spark, path, "timestamp", F.col("event_provider") == "paloalto", timedelta(hours=-5))
    got = sorted((r.event_id, str(r.timestamp), str(r.event_date)) for r in spark.read.parquet(path).collect())
    assert got == [("1", "2026-06-04 21:00:00", "2026-06-04"), ("2", "2026-06-05 03:00:00", "2026-06-05"), ("3", "2026-06-06 20:00:00", "2026-06-06")]


def test_events_prune_by_day(spark):
    path = folder()
    writers.write_events(ad.events(spark, SF).drop("ext", "event_no"), path)
    table = spark.read.parquet(path)
    kept = up.expire(table, "timestamp", 3, ad.AS_OF, date_column="event_date")
    assert "PartitionFilters: [isnotnull(event_date" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == table.filter("timestamp >= '2024-01-28'").count() > 0


def test_text_feeds_and_evidence_readers(spark):
    root = tempfile.mkdtemp(prefix="nf-raw-")
    os.makedirs(f"{root}/raw/feed=srx")
    with open(f"{root}/raw/feed=srx/a.log", "w") as f:
        f.write("line one\nline two\n")
    raw = readers.read_raw_logs(spark, f"{root}/raw")
    assert sorted((r.feed, r.message) for r in raw.collect()) == [("srx", "line one"), ("srx", "line two")]
    with open(f"{root}/e.ndjson", "w") as f:
        f.write(json.dumps({"ts": "2026-08-09 14:32:10.500", "tier": "evidence", "args": json.dumps({"run_id": "r", "server_id": "s", "segment_seq": 0})}) + "\nnot json\n")
    got = readers.read_evidence(spark, f"{root}/e.ndjson").collect()
    good = next(r for r in got if r.server_id)
    assert (good.run_id, good.segment_seq, str(good.ts)) == ("r", 0, "2026-08-09 14:32:10.500000")
    assert [r._corrupt_record for r in got if not r.server_id] == ["not json"]


def test_metric_run_publishes_no_addresses(spark):
    none = spark.createDataFrame([], "kind string, real_value string, surrogate string, key_version int, first_seen timestamp, last_seen timestamp")
    out = public_metrics_run(ad.events(spark, SF), none, b"k", 1, ad.AS_OF, since=ad.SINCE)
    assert {r.metric for r in out["metrics"].select("metric").distinct().collect()} == {"bytes", "flows", "connections", "deny_rate_index", "ips_volume_index"}
    assert out["entities"].filter(F.col("surrogate").startswith("10.")).count() == 0
    hosts = ad.events(spark, SF).filter("event_action like 'flow_%'").select("source_ip").distinct().count()
    assert out["pseudonyms"].count() == out["entities"].select("surrogate").distinct().count() == min(20, hosts)


def test_filters_and_columns_reach_the_scan(spark):
    plan = load_all().queries["top_talkers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in schema
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


NAMES = ("query_flows", "communication_edges", "unused_rules", "verify_chain", "normalise_srx", "find_path", "object_books_from_text", "score")


@pytest.mark.parametrize("name", list(load_all().oracles) if os.environ.get("NETFABRIC_ALL_QUERIES") else NAMES)
def test_registered_query_equals_its_check(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_oracle import TABLES, _rows
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    registry = load_all()
    got, want = registry.queries[name](spark, SF).toPandas(), con.execute(registry.oracles[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_no_registered_plan_has_a_cross_join(spark):
    q = load_all().queries
    for name in ("explain_rule", "ingest_status", "public_snapshot_edges", "alerts_for_ips", "tools_used", "select_pair", "append_changed_versions"):
        plan = q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 160 and not set(o) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_rows_of_one_small_file_are_spread_before_their_ids_are_hashed(spark, tmp_path):
    from netfabric.plans import adapter as ad
    spark.range(500).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    one = ad.table(spark, str(tmp_path), "t")
    assert one.rdd.getNumPartitions() == 1
    wide = ad.spread(one)
    assert wide.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in wide.collect()) == list(range(500))
