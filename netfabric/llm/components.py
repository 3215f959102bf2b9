"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfabric.session import cut_lineage


def _print(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set: three numbers, whatever its size."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 32))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to the smallest vertex around it."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every vertex links itself and its smaller neighbours to the smallest of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges (a, b)``; the component is its smallest id.

    Minima are combined on the map side, and a hub's edges join to a single row
    of it, which adaptive execution may split.  Each round is written to the
    shared folder; the driver only compares fingerprints of rounds.
    """
    clean = lambda e: e.filter("a <> b").distinct()
    edges = cut_lineage(clean(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))))
    seen = None
    while (now := _print(edges)) != seen:
        seen = now
        edges = cut_lineage(clean(small_star(clean(large_star(edges)))))
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
