"""Shards of near equal bytes from sampled splitters.

Records are ordered by a key: the digest of the text, then the id, so equal
texts lie next to each other.  A size-weighted sample of keys gives the ranges
in which the records are partitioned; ranges that turn out overfull are divided
again by a second sample of their own.  Each range then sums its records in key
order, and the shard of a record follows from the bytes before it in all ranges.
The sample decides how the work is spread, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netfabric.session import cut_lineage

TEXT_KEY = 16
SAMPLES_PER_RANGE = 16
OVERFULL = 4
WHOLE_GROUP = 50


def range_of(key: Column, splitters: list[str]) -> Column:
    """Number of splitters that are not above the key, by binary search in a literal array."""
    if not splitters:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    table = F.lit(splitters)
    step = lambda at, by: F.when(F.get(table, at + by - 1) <= key, at + by).otherwise(at)
    return F.aggregate(F.lit(steps), F.lit(0), step)


def draw_splitters(rows: DataFrame, key: Column, ranges: int, seed: int) -> list[str]:
    """At most ``ranges`` quantiles of a sample in which a row's chance is its share of the bytes."""
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.filter(draw < F.col("size") * F.lit(ranges * SAMPLES_PER_RANGE / total)).select(key.alias("k"))
    order = sample.withColumn("n", F.row_number().over(Window.orderBy("k")))
    picked = order.filter(F.col("n") % SAMPLES_PER_RANGE == 0).select("k").distinct()
    return sorted(r.k for r in picked.collect())


def range_sizes(rows: DataFrame, splitters: list[str]) -> list:
    """Bytes, rows and least and largest key of each range that holds rows."""
    return rows.groupBy(range_of(F.col("key"), splitters).alias("range")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
    ).collect()


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 500_000,
    rounds: int = 4,
) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    ``size`` is the UTF-8 length plus 8 (null: 8).  Law ``bytes``: the shards are
    consecutive in key order and of near equal size.  A group of equal texts below
    1/50 of a shard stays whole; a larger one is divided where a boundary falls.
    ``slot`` counts a shard's rows from 0 in key order.  A null text has the key of
    an empty one and a null checksum; a null id comes first within its text.
    Repeated rows take slots of their own.  An empty table gives no rows.  Extra
    columns are ignored.  The driver sees one row per range and one per shard.
    """
    text = F.col(text_col)
    digest = F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, TEXT_KEY)
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(digest, F.coalesce(F.lpad(F.hex(F.col(id_col).cast("long")), 16, "0"), F.lit(""))).alias("key")))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(8 * shards, n // rows_per_range)
    splitters = draw_splitters(rows, F.substring("key", 1, TEXT_KEY), ranges, 0)
    found = range_sizes(rows, splitters)
    for turn in range(1, rounds):
        overfull = [r for r in found if r["size"] > OVERFULL * total / ranges and r["low"] != r["high"]]
        if not overfull:
            break
        at = range_of(F.col("key"), splitters)
        inside = rows.filter(at.isin([r["range"] for r in overfull]))
        share = max(2, round(ranges * sum(r["size"] for r in overfull) / total))
        splitters = sorted({*splitters, *draw_splitters(inside, F.col("key"), share, turn)})
        found = range_sizes(rows, splitters)
    before_size, before_rows, s, k = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1), 0, 0
    at_range = {r["range"]: r for r in found}
    for i in range(len(splitters) + 1):
        before_size[i], before_rows[i] = s, k
        if i in at_range:
            s, k = s + at_range[i]["size"], k + at_range[i]["n"]
    ordered = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("range", "text_key")
    placed = (
        rows.withColumn("range", range_of(F.col("key"), splitters)).withColumn("text_key", F.substring("key", 1, TEXT_KEY))
        .withColumn("upto", F.sum("size").over(ordered)).withColumn("row", F.count(F.lit(1)).over(ordered))
        .withColumn("group_size", F.sum("size").over(alike)).withColumn("group_end", F.max("upto").over(alike))
    )
    whole = F.col("group_size") * (WHOLE_GROUP * shards) <= F.lit(total)
    twice_middle = 2 * F.get(F.lit(before_size), F.col("range")) + F.when(
        whole, 2 * F.col("group_end") - F.col("group_size")).otherwise(2 * F.col("upto") - F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(twice_middle * F.lit(shards) / F.lit(max(1, 2 * total)))).cast("int")
    placed = cut_lineage(placed.select(
        "doc_id", "size", "text_crc32", shard.alias("shard"), (F.get(F.lit(before_rows), F.col("range")) + F.col("row")).alias("row")))
    firsts = {r.shard: r["first"] for r in placed.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    start = F.get(F.lit([firsts.get(i, 0) for i in range(shards)]), F.col("shard"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
