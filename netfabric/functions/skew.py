"""Joins and ranks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Join ``big`` to a lookup side whose keys may be very unevenly used by ``big``.

    The optimizer broadcasts the lookup side if its size, which a written table has,
    allows it.  Otherwise both sides are shuffled once, and adaptive execution splits
    the partitions of ``big`` that turn out hot; it may do so for these join types, in
    which every row of ``big`` is decided by the lookup side alone.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join does not support {how!r}")
    return big.join(small, keys, how)


# Rows of one key that meet in one block of a block join, on its left and on its right.
# The right ones are held in memory while the left ones stream by.
LEFT_BLOCK, RIGHT_BLOCK = 10_000, 20_000


def block_sizes(left: DataFrame, right: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Numbers of blocks on either side, ``_lefts`` and ``_rights``, for the keys of ``right``.

    Keys that ``left`` lacks have one block there, so it may be a table that only
    approximates the rows of a key.
    """
    keys = [on] if isinstance(on, str) else list(on)
    blocks = lambda df, size, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    met = blocks(right, RIGHT_BLOCK, "_rights").join(blocks(left, LEFT_BLOCK, "_lefts"), keys, "left")
    return met.withColumn("_lefts", F.coalesce("_lefts", F.lit(1)))


def block_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, sizes: DataFrame | None = None) -> DataFrame:
    """Inner join for keys that may have many rows on both sides.

    The rows of a key are dealt into blocks on either side, and each pair of blocks
    meets in its own shuffle key.  What is shuffled is the output divided by the size of
    a block; the output itself streams out of the join.  ``sizes`` are the blocks per key
    where they are known; a written table of few keys spares both sides a shuffle.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if sizes is None:
        sizes = block_sizes(left, right, keys)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, others: str, block: str, copy: str) -> DataFrame:
        rest = [F.col(f.name) for f in df.schema.fields if f.name not in keys and _hashable(f)]
        placed = lookup_join(df, sizes, keys).withColumn(block, F.pmod(F.xxhash64(F.lit(0), *rest), F.col(own)).cast("int"))
        copied = placed.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_lefts", "_rights")
        return copied.repartition(parts, *keys, "_left", "_right")

    met = dealt(left, "_lefts", "_rights", "_left", "_right").join(
        dealt(right, "_rights", "_lefts", "_right", "_left"), [*keys, "_left", "_right"])
    return met.drop("_left", "_right")


def _hashable(field: T.StructField) -> bool:
    return "map<" not in field.dataType.simpleString() and "variant" not in field.dataType.simpleString()


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key.

    Spark's window-group limit keeps at most ``n`` rows per key on each map
    task before the shuffle, so a hot key sends ``n`` rows per task, not all.
    """
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based position of each row within its key, computed by range partitions.

    A hot key is spread over many sorted ranges; each range ranks its own rows
    and adds the row counts of the ranges before it.  The counts table has one
    row per key and range, so it stays small next to the data.
    """
    from netfabric.session import cut_lineage

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in (*keys, *order)])
    # The range bounds come from a sample, so they are fixed before two uses.
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "_part").orderBy(*[F.col(c) for c in order])
    ranked = ranged.withColumn("_local", F.row_number().over(local))
    joined = ranked.join(offsets, [*keys, "_part"])
    return joined.withColumn(name, (F.col("_local") + F.col("_offset")).cast("long")).drop("_part", "_local", "_offset")
