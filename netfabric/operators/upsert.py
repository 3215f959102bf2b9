"""Latest-by-key reads, upserts, version histories, deduplication and retention."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netfabric.functions.canonical import ascii_json_string, spaced_json_object
from netfabric.functions.ids import dedup_token, text
from netfabric.functions.skew import _hashable, lookup_join, with_rank
from netfabric.functions.timeargs import parse_time, ts_lit
from netfabric.session import cut_lineage


def latest_by_key(
    df: DataFrame, keys: Sequence[str], version: str | Sequence[str],
    tiebreak: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key: the one with the highest version.

    An aggregate, so each map task sends one candidate per key and a hot key
    costs no more than any other.  Ties go to ``tiebreak`` (highest wins) or,
    without one, to a hash of the row, so the result never depends on order.
    """
    versions = [version] if isinstance(version, str) else list(version)
    if tiebreak is None:
        plain = [f"`{f.name}`" for f in df.schema.fields if _hashable(f)]
        ties: list[Column] = [F.xxhash64(*[F.col(c) for c in plain])]
    else:
        ties = [F.col(c) for c in tiebreak]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(v) for v in versions], *ties)).alias("_row")
    )
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def collapse_superseded(df: DataFrame, name: str = "name", version: str = "last_seen") -> DataFrame:
    """Newest row per non-empty name; rows without a name pass through untouched."""
    named = F.coalesce(F.col(name), F.lit("")) != ""
    return latest_by_key(df.filter(named), [name], version).unionByName(df.filter(~named))


def upsert(
    target: DataFrame, new: DataFrame, keys: Sequence[str], version: str | Sequence[str],
    tiebreak: Sequence[str] | None = None,
) -> DataFrame:
    """The target with ``new`` merged in; for each key the highest version stays."""
    return latest_by_key(target.unionByName(new), keys, version, tiebreak)


def _fs_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs_path(spark, path)
    return bool(fs.exists(jpath))


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a Parquet table; readers collapse versions with :func:`latest_by_key`."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Partition columns of a Parquet table, from the folders of its first partition."""
    fs, at = _fs_path(spark, path)
    found = []
    while True:
        folders = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName()]
        if not folders:
            return found
        names = {f.getName().split("=", 1)[0] for f in folders}
        if len(names) > 1:
            raise ValueError(f"{path} mixes partition columns: {sorted(names)}")
        found.append(names.pop())
        at = folders[0]


def touched_partitions(rows: DataFrame, partition_by: Sequence[str]) -> Column:
    """A filter of literals on the partition columns, which prunes folders before the scan.

    The driver sees the partitions that a batch touches: its days or hours, not its rows.
    """
    values = rows.select(*partition_by).distinct().collect()
    wanted = F.lit(False)
    for c in partition_by:
        own = {r[c] for r in values}
        hit = F.col(c).isin([v for v in own if v is not None])
        hit = hit | F.col(c).isNull() if None in own else hit
        wanted = hit if c == partition_by[0] else wanted & hit
    return wanted


def upsert_table(
    new: DataFrame, path: str, keys: Sequence[str], version: str | Sequence[str],
    partition_by: Sequence[str], tiebreak: Sequence[str] | None = None,
) -> None:
    """Merge ``new`` into a partitioned Parquet table, rewriting only touched partitions.

    The partition columns must be determined by the key (an hour bucket and its
    date, say).  The merge is written to a staging folder first and then swapped
    in with a dynamic partition overwrite, so a failed job leaves the table as
    it was and a re-run gives the same table.
    """
    spark = new.sparkSession
    if not path_exists(spark, path):
        latest_by_key(new, keys, version, tiebreak).write.partitionBy(*partition_by).parquet(path)
        return
    current = spark.read.schema(new.schema).parquet(path).filter(touched_partitions(new, partition_by))
    merged = latest_by_key(current.unionByName(new), keys, version, tiebreak)
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    merged.write.partitionBy(*partition_by).parquet(staging)
    (
        spark.read.schema(new.schema).parquet(staging)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by).parquet(path)
    )
    fs, jpath = _fs_path(spark, staging)
    fs.delete(jpath, True)


# The attributes a rule version is hashed over.
VERSION_ATTRS = ("action", "from_zone", "to_zone", "enabled", "position")


def rule_content_hash(attrs: dict[str, Column] | None = None) -> Column:
    """SHA-1 of the sorted-key JSON of the version attributes.

    ``enabled`` may be a boolean; it is rendered as ``true``/``false``.
    """
    cols = attrs or {name: F.col(name) for name in VERSION_ATTRS}
    pairs = [(name, ascii_json_string(text(cols[name]))) for name in VERSION_ATTRS]
    return F.sha1(spaced_json_object(pairs))


def append_changed_versions(
    new: DataFrame, history: DataFrame, keys: Sequence[str], content_hash: str = "content_hash",
    valid_from: str = "valid_from",
) -> DataFrame:
    """Rows of ``new`` whose content hash differs from the newest one in ``history``.

    A key never seen before gives its first version.
    """
    last = history.groupBy(*keys).agg(
        F.max_by(F.col(content_hash), F.struct(F.col(valid_from), F.col(content_hash))).alias("_last_hash")
    )
    joined = lookup_join(new, last, keys, "left")
    return joined.filter(~F.col(content_hash).eqNullSafe(F.col("_last_hash"))).drop("_last_hash")


POLICY_VERSION_KEYS = ("tenant_id", "provider", "device_name", "rule_name")
OBJECT_BOOK_KEYS = ("tenant_id", "provider", "device_name")


def policy_versions(policies: DataFrame, history: DataFrame) -> DataFrame:
    """New version rows for configured rules (one row per rule whose content changed)."""
    rows = policies.select(
        "tenant_id", "provider", "device_name", "rule_name",
        F.col("collected_at").alias("valid_from"),
        rule_content_hash({
            "action": F.col("action"), "from_zone": F.col("from_zone"), "to_zone": F.col("to_zone"),
            "enabled": F.col("enabled"), "position": F.col("position"),
        }).alias("content_hash"),
        "action", "from_zone", "to_zone", "enabled", F.col("position").cast("string").alias("position"),
    )
    return append_changed_versions(rows, history, POLICY_VERSION_KEYS)


def object_book_versions(books: DataFrame, history: DataFrame) -> DataFrame:
    """New object-book rows; ``object_book`` is already canonical JSON text."""
    rows = books.select(
        "tenant_id", "provider", "device_name", F.col("collected_at").alias("valid_from"),
        F.sha1(F.col("object_book")).alias("content_hash"), "object_book",
    )
    return append_changed_versions(rows, history, OBJECT_BOOK_KEYS)


def ingest_evidence(segments: DataFrame, landed: DataFrame) -> DataFrame:
    """Segments above the high-water mark of their (server, run).

    A run with nothing landed takes every segment; that differs from a run
    whose segment 0 has landed, which is why the mark is NULL when absent.
    """
    marks = landed.groupBy("server_id", "run_id").agg(F.max("segment_seq").alias("_mark"))
    joined = lookup_join(segments, marks, ["server_id", "run_id"], "left")
    return joined.filter(F.col("_mark").isNull() | (F.col("segment_seq") > F.col("_mark"))).drop("_mark")


def with_dedup_token(df: DataFrame) -> DataFrame:
    return df.withColumn("token", dedup_token("server_id", "run_id", "segment_seq"))


def dedup_by_token(df: DataFrame, token: str = "token", first_by: Sequence[str] = ("received_at",)) -> DataFrame:
    """One row per token, the earliest; a retried block disappears."""
    rest = [c for c in df.columns if c != token]
    order = F.struct(*[F.col(c) for c in first_by])
    picked = df.groupBy(token).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*[F.col(c) if c == token else F.col("_row")[c].alias(c) for c in df.columns])


def dedup_in_window(blocks: DataFrame, token: str = "token", order: Sequence[str] = ("received_at",), window: int = 10_000) -> DataFrame:
    """Blocks (rows) without those whose token is among the last ``window`` blocks that were kept before them.

    A repeat beyond the window is kept and starts a new one.  ``order`` is the order of
    arrival; blocks it leaves equal go by token.  Whether a block is kept depends on how
    many were kept since its token was last seen, which depends on other tokens in turn,
    so rounds go on until no decision changes: a block is decided once all before it
    are.  In a round, each repeat points to the first one beyond its window, and those
    on the way from a token's first block are found by doubling the pointers.
    """
    ranked = cut_lineage(with_rank(blocks, [], (*order, token), "_at"))
    often = ranked.groupBy(token).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(token)
    rows = cut_lineage(lookup_join(ranked.select(token, "_at"), often, token, "left_semi").withColumn("_kept", F.lit(True)))
    while True:
        placed = cut_lineage(_kept_before(rows))
        beyond = Window.partitionBy(token).orderBy("_place").rangeBetween(window + 1, Window.unboundedFollowing)
        first = F.min("_at").over(Window.partitionBy(token)) == F.col("_at")
        jumps = cut_lineage(placed.select(token, "_at", F.min("_at").over(beyond).alias("_to"), first.alias("_on")))
        tables = [jumps.filter("_to IS NOT NULL").select("_at", "_to")]
        while not (ahead := cut_lineage(tables[-1].join(
                tables[-1].select(F.col("_at").alias("_to"), F.col("_to").alias("_far")), "_to").select("_at", F.col("_far").alias("_to")))).isEmpty():
            tables.append(ahead)
        on_way = jumps.filter("_on").select("_at")
        for table in reversed(tables):
            on_way = cut_lineage(on_way.unionByName(on_way.join(table, "_at").select(F.col("_to").alias("_at"))).distinct())
        now = cut_lineage(rows.join(on_way.withColumn("_new", F.lit(True)), "_at", "left").select(
            token, "_at", F.coalesce("_new", F.lit(False)).alias("_kept"), (F.col("_kept") != F.coalesce("_new", F.lit(False))).alias("_moved")))
        rows = now.select(token, "_at", "_kept")
        if now.filter("_moved").isEmpty():
            return ranked.join(rows.filter("NOT _kept").select("_at"), "_at", "left_anti").select(*blocks.columns)


def _kept_before(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_place``: the kept blocks among all that arrived before each; all but those in ``rows`` are kept.

    The drops before a block are those before its range of arrivals and those within it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = max(1, -(-int(rows.agg(F.max("_at")).first()[0] or 1) // parts))
    ranged = rows.withColumn("_range", F.floor(F.col("_at") / span))
    drops = ranged.groupBy("_range").agg(F.count_if(~F.col("_kept")).alias("_n"))
    # One row per range, of which there are as many as shuffle partitions.
    before = drops.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    local = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumn("_here", F.coalesce(F.count_if(~F.col("_kept")).over(local), F.lit(0)))
    return counted.join(before, "_range").withColumn("_place", F.col("_at") - 1 - F.col("_earlier") - F.col("_here")).drop("_range", "_earlier", "_here")


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``ids``."""
    return lookup_join(df, ids.select(key).distinct(), key, "left_anti")


def backfill_shift(df: DataFrame, ts: str, predicate: Column, delta: timedelta) -> DataFrame:
    """Move the timestamps of the rows that match; all other rows are unchanged."""
    moved = F.col(ts) + F.expr(f"INTERVAL '{int(delta.total_seconds())}' SECOND")
    return df.withColumn(ts, F.when(F.coalesce(predicate, F.lit(False)), moved).otherwise(F.col(ts)))


def backfill_check(before: DataFrame, after: DataFrame, event_id: str = "event_id") -> DataFrame:
    """One row: counts and distinct ids on both sides and whether they agree."""

    def side(df: DataFrame, name: str) -> DataFrame:
        per_id = df.groupBy(event_id).agg(F.count(F.lit(1)).alias("n"))
        return per_id.agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("ids")).select(
            F.lit(name).alias("side"), F.coalesce("row_count", F.lit(0)).alias("row_count"), "ids"
        )

    both = side(before, "before").unionByName(side(after, "after"))
    return both.agg(
        F.max(F.when(F.col("side") == "before", F.col("row_count"))).alias("rows_before"),
        F.max(F.when(F.col("side") == "after", F.col("row_count"))).alias("rows_after"),
        F.max(F.when(F.col("side") == "before", F.col("ids"))).alias("ids_before"),
        F.max(F.when(F.col("side") == "after", F.col("ids"))).alias("ids_after"),
    ).withColumn(
        "ok",
        (F.col("rows_before") == F.col("rows_after")) & (F.col("ids_before") == F.col("ids_after")),
    )


def backfill_table(
    spark: SparkSession, path: str, ts: str, predicate: Column, delta: timedelta,
    date_column: str = "event_date", event_id: str = "event_id",
) -> None:
    """Shift a slice of a day-partitioned table: stage, verify, then swap.

    Only the days the slice leaves or enters are rewritten.  Raises, leaving the
    table as it was, when the staged row count or distinct ids differ, and before
    anything is written when the table has other partition columns.
    """
    if (layout := partition_columns(spark, path)) != [date_column]:
        raise ValueError(f"{path} is partitioned by {layout}, not by {date_column} alone")
    table = spark.read.parquet(path)
    hit = table.filter(predicate)
    moved_ts = F.col(ts) + F.expr(f"INTERVAL '{int(delta.total_seconds())}' SECOND")
    days = hit.select(F.col(date_column)).union(hit.select(F.to_date(moved_ts))).distinct()
    before = table.join(days, date_column, "left_semi")
    shifted = backfill_shift(before, ts, predicate, delta).withColumn(date_column, F.to_date(F.col(ts)))
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    shifted.write.partitionBy(date_column).parquet(staging)
    staged = spark.read.schema(table.schema).parquet(staging)
    fs, jpath = _fs_path(spark, staging)
    if not backfill_check(before, staged, event_id).first()["ok"]:
        fs.delete(jpath, True)
        raise RuntimeError("backfill verification failed; table left unchanged")
    # A day that lost all its rows has no staged partition, so the overwrite
    # would leave its old files; the list is at most one entry per day.
    emptied = days.join(staged.select(date_column).distinct(), date_column, "left_anti").collect()
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_column).parquet(path)
    for row in emptied:
        table_fs, day_path = _fs_path(spark, f"{path.rstrip('/')}/{date_column}={row[0]}")
        table_fs.delete(day_path, True)
    fs.delete(jpath, True)


# Days each table is kept; None keeps everything.
RETENTION_DAYS = {
    "events": 30, "topo_observations": 30, "graph_nodes": 30, "graph_edges": 30, "entities": 30,
    "entity_edges": 30, "health_metrics": 30, "metric_timeseries": 30, "entity_series": 30,
    "rule_usage_hourly": 30, "audit": 90, "policy_versions": None, "object_book_hash": None,
}


def expire(
    df: DataFrame, ts: str, days: int | None, as_of: str | datetime, date_column: str | None = None
) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; with a date column it prunes partitions."""
    if days is None:
        return df
    floor = parse_time(as_of) - timedelta(days=days)
    kept = df.filter(F.col(ts) >= ts_lit(floor))
    return kept.filter(F.col(date_column) >= F.lit(floor.date())) if date_column else kept
