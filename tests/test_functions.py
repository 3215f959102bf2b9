import hashlib
import hmac
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from netfabric.functions import canonical, ids, net
from netfabric.functions.skew import lookup_join, top_rows, with_rank
from netfabric.functions.timeargs import TimeArgError, parse_time

NASTY = ["plain", "", "a\x1f\\u001Fé\"😀\x0b/", "tab\tnl\n", "\\\\u001A\x1a\x7f"]


def test_hashes_equal_the_plain_ones(spark):
    df = spark.createDataFrame([(s,) for s in NASTY], "s string")
    got = df.select(
        "s", ids.hmac_sha256("s", b"k" * 70).alias("h"), ids.node_id(F.lit("t_main"), F.lit("host"), F.col("s")).alias("n"),
        canonical.json_string(F.col("s")).alias("j"), canonical.ascii_json_string(F.col("s")).alias("a"),
    ).collect()
    for r in got:
        assert r.h == hmac.new(b"k" * 70, r.s.encode(), hashlib.sha256).hexdigest()
        assert r.n == hashlib.sha1(f"t_main|host|{r.s}".encode()).hexdigest()[:16]
        assert r.j == json.dumps(r.s, ensure_ascii=False)
        assert r.a == json.dumps(r.s)


def test_dedup_token_counts_bytes_and_is_injective(spark):
    df = spark.createDataFrame([("é", "r", 1), ("a:b", "c", 1), ("a", "b:c", 1)], "s string, r string, q long")
    got = [x[0] for x in df.select(ids.dedup_token("s", "r", "q")).collect()]
    assert got == ["2:é:1:r:1", "3:a:b:1:c:1", "1:a:3:b:c:1"]


def test_hosts_and_segments(spark):
    df = spark.createDataFrame([("FW1.lab.x",), ("10.1.2.3",), ("fe80::1",), ("",), (None,)], "h string")
    got = df.select(net.short_host("h").alias("s"), net.segment("h").alias("g")).collect()
    assert [x.s for x in got] == ["FW1", "10.1.2.3", "fe80::1", "", None]
    assert [x.g for x in got] == ["fw1", "10", "fe80::1", "unknown", "unknown"]


@pytest.mark.parametrize("value,ok", [("10.0.0.1", True), ("255.255.255.255", True), ("256.1.1.1", False), ("1.2.3", False), ("1.2.3.4\n", False), ("fe80::1", False)])
def test_ipv4_is_octet_bounded(spark, value, ok):
    assert (spark.createDataFrame([(value,)], "v string").select(net.ipv4_or_null("v")).first()[0] is not None) == ok


def test_time_arguments():
    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    assert parse_time("now", now) == now
    assert (now - parse_time("now-90m", now)).total_seconds() == 5400
    assert parse_time("2024-01-01T02:00:00+02:00") == datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert parse_time("2024-01-01") == datetime(2024, 1, 1, tzinfo=timezone.utc)
    with pytest.raises(TimeArgError):
        parse_time("yesterday")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_shuffled_lookup_join_equals_broadcast_join_on_a_hot_key(spark, how):
    big = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)).alias("k"), F.col("id").alias("v"))
    small = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 7).alias("w"))
    plain = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = lookup_join(big, small, "k", how)
        assert sorted(map(tuple, shuffled.collect()), key=str) == plain and shuffled.columns == big.join(small, ["k"], how).columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rank_over_ranges_equals_a_window(spark):
    df = spark.range(500).select((F.col("id") % 3 == 0).cast("string").alias("k"), ((F.col("id") * 37) % 500).alias("v"))
    got = {(r.k, r.v): r["rank"] for r in with_rank(df, ["k"], ["v"]).collect()}
    want = {}
    for k in ("true", "false"):
        for i, v in enumerate(sorted(v for kk, v in got if kk == k), start=1):
            want[(k, v)] = i
    assert got == want


def test_top_rows_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    top = top_rows(df, ["k"], [F.col("v").desc()], 2)
    assert sorted(map(tuple, top.collect())) == [(0, 96), (0, 98), (1, 97), (1, 99)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_a_hot_lookup_key_is_split_and_not_copied(spark):
    """Half of all rows have one key and the lookup side is not broadcast."""
    small_parts = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {k: spark.conf.get(k, None) for k in small_parts}
    try:
        for k, v in small_parts.items():
            spark.conf.set(k, v)
        ids = spark.range(0, 200_000, 1, 8)
        big = ids.select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 1000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        joined = lookup_join(big, spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")), "k")
        assert joined.agg(F.count("w"), F.sum("w")).first()[0] == 200_000
        rows = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("w").alias("n"), F.max("v").alias("v"))
        assert max(r.n for r in rows.collect()) < 100_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
