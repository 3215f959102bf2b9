"""Mix sources to target weights by hash-threshold histograms.

Every source gets ``full`` whole copies of its documents, and one more copy of
those whose hash lies below a threshold.  The threshold is found without
sorting: sizes are summed by source and hash bucket, the bucket in which the
remaining budget runs out is cut into finer buckets, and so on.  Budgets nest:
a smaller one takes a subset of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netfabric.functions.skew import with_rank
from netfabric.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    """Number of words; null for a null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(col: Column) -> Column:
    """60 bits of the MD5 of an id, so that any engine can repeat the draw."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Target per source: its weight's share of all sizes, at most ``cap`` times its own size.

    ``sizes`` is ``(source, source_size)``, one row per source.  Weights repeat
    over the sources in code point order, null last.  What the cap cuts off is
    shared again by weight: the level rises until the capped set stays the same.
    """
    ranked = with_rank(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_rank")
    turn = (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")
    table = cut_lineage(ranked.select(
        "source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("double").alias("_w"),
        (F.lit(cap) * F.col("source_size")).cast("double").alias("_most"),
    ))
    total, weight = table.agg(F.sum("source_size"), F.sum("_w")).first()
    level, capped = (float(total) / weight if weight else 0.0), -1
    while True:
        over = F.col("_w") * F.lit(level) >= F.col("_most")
        n, held, free = table.agg(
            F.coalesce(F.sum(over.cast("int")), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("_most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0)),
        ).first()
        if n == capped or not free:
            break
        level, capped = (float(total) - held) / free, n
    return table.select("source", "source_size", F.least("_most", F.col("_w") * F.lit(level)).alias("target"))


def draw_thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, source_size, target, full, threshold)``: whole copies and the hash bound of one more.

    ``rows`` is ``(source, size, hash)``.  Each level reads only the rows of the
    buckets in which a budget ran out; it stops when those hold one row each.
    The rows of the last bucket are taken if that comes nearer to the target.
    """
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = cut_lineage(
        targets.withColumn("full", share.cast("long"))
        .withColumn("left", F.col("target") - F.col("full") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
    )
    fixed = ["source", "source_size", "target", "full"]
    for depth in range(1, HASH_BITS // LEVEL_BITS + 1):
        above, shift = HASH_BITS - LEVEL_BITS * (depth - 1), HASH_BITS - LEVEL_BITS * depth
        s = state.alias("s")
        here = rows.alias("r").join(
            s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.shiftright("r.hash", above) == F.col("s.prefix")))
        cells = here.groupBy(*[F.col(f"s.{c}") for c in (*fixed, "left")], F.shiftright("r.hash", shift).alias("prefix")).agg(
            F.sum("r.size").alias("_size"), F.count(F.lit(1)).alias("_n"))
        order = Window.partitionBy("source").orderBy("prefix")
        cells = cells.withColumn("_upto", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        cut = cells.filter((F.col("_upto") > F.col("left")) & (F.col("_upto") - F.col("_size") <= F.col("left")))
        state = cut_lineage(cut.select(
            *fixed, (F.col("left") - F.col("_upto") + F.col("_size")).alias("left"), "prefix", "_size", "_n",
            F.lit(shift).alias("_shift")))
        if (state.agg(F.max("_n")).first()[0] or 0) <= 1:
            break
    edge = F.col("prefix") + (2 * F.col("left") >= F.col("_size")).cast("long")
    found = state.select("source", F.expr("1").alias("_one"), (edge * F.pow(F.lit(2.0), F.col("_shift")).cast("long")).alias("threshold"))
    t = targets.withColumn("full", share.cast("long")).alias("t")
    return cut_lineage(
        t.join(found.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left")
        .select(*[F.col(f"t.{c}") for c in fixed], F.coalesce("f.threshold", F.lit(0)).cast("long").alias("threshold"))
    )


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        id_hash(F.col(id_col)).alias("hash")))


def mixing_plan(rows: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """The plan of ``draw_thresholds`` for ``rows (doc_id, source, size, hash)``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return draw_thresholds(rows, source_targets(sizes, weights, cap))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)`` for every row of ``docs``.

    Null and empty texts have size 0 and take nothing; a null source is a source
    of its own, the last; a null id hashes as an empty one.  Rows with equal ids
    are taken or left together.  An empty table gives no rows.  Extra columns
    are ignored.
    """
    rows = sized(docs, id_col, text_col, source_col)
    plan = mixing_plan(rows, weights, cap)
    copies = F.col("p.full") + (F.col("r.hash") < F.col("p.threshold")).cast("long")
    return (
        rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
        .select("r.doc_id", "r.size", "p.source_size", "p.target", copies.alias("copies"), (copies * F.col("r.size")).alias("taken"))
    )


def mixed_rows(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, as ``mix_sources`` decides.

    The plan has a row per source, so texts are not moved.
    """
    plan = mixing_plan(sized(docs, id_col, text_col, source_col), weights, cap).select(
        F.col("source").alias("_of"), "full", "threshold")
    copies = F.col("p.full") + (id_hash(F.col(f"d.{id_col}")) < F.col("p.threshold")).cast("long")
    joined = docs.alias("d").join(plan.alias("p"), F.col(f"d.{source_col}").eqNullSafe(F.col("p._of")))
    return joined.select("d.*", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*[F.col(f"d.{c}") for c in docs.columns])


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 3.0 * source_size AS most,
    SUM(CAST(3 * source_size AS DOUBLE)) OVER a AS held, SUM(w) OVER a AS gone
  FROM s WINDOW a AS (ORDER BY 3.0 * source_size / w, source IS NULL, source)
), t AS (SELECT CAST(SUM(source_size) AS DOUBLE) AS total, SUM(w) AS ws FROM s
), levels AS (
  SELECT (total - COALESCE(held, 0)) / (ws - COALESCE(gone, 0)) AS level
  FROM (SELECT 0 AS held, 0 AS gone UNION ALL SELECT held, gone FROM o), t
  WHERE ws - gone > 0
), best AS (
  SELECT level FROM levels, t WHERE level >= 0
  ORDER BY abs((SELECT SUM(least(3.0 * source_size, level * w)) FROM s) - total), level LIMIT 1
), p AS (
  SELECT source, source_size, least(CAST(3.0 * source_size AS DOUBLE), w * level) AS target FROM s, best
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_copies FROM p
), c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, full_copies, target - full_copies * q.source_size AS budget,
    CAST(SUM(d.size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
  size * (full_copies + CASE WHEN upto <= budget OR 2 * (budget - upto + size) >= size AND upto - size <= budget THEN 1 ELSE 0 END) AS taken
FROM c
"""
