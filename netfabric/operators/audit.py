"""Hash-chained audit log: hashing, verification, appending and usage reports."""

from __future__ import annotations

import hashlib
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netfabric.functions.canonical import (
    ascii_json_string, iso_millis, json_string, json_string_array,
)
from netfabric.functions.ids import text
from netfabric.functions.skew import lookup_join, with_rank
from netfabric.operators.graph import reaches_root
from netfabric.operators.upsert import path_exists
from netfabric.session import cut_lineage, shared_path

# Chain key, hashed fields in order, actor types.
CHAIN_KEYS = ("tier", "server_id")
ATTRIBUTION_FIELDS = ("client_name", "model_id", "actor_type")
ACTOR_TYPES = ("human", "agent", "unknown")
EVIDENCE_TIER = "evidence"
ISSUE_TYPES = (
    "duplicate_row", "content_edit", "missing_predecessor", "unreachable", "unidentified_writer", "fork",
)
LINK_BLOCK_ROWS = 50_000
FACTS = "tier string, server_id string, row_hash string, prev_hash string, edited boolean, day string, digest string"
RATE_WINDOW_SECONDS = 60


def canonical(df: DataFrame) -> Column:
    """Compact JSON array of the nine business fields.

    The three attribution fields follow only when one of them is set, so rows
    from before those columns existed keep their hash.
    """
    base = F.concat_ws(
        ",", json_string(iso_millis(F.col("ts"))),
        *[json_string(F.col(c)) for c in ("principal", "tier", "tool", "args")],
        json_string_array(F.col("data_classes")), json_string(F.col("decision")),
        F.coalesce(F.col("row_count"), F.lit(0)).cast("long").cast("string"), json_string(F.col("error")),
    )
    present = [c for c in ATTRIBUTION_FIELDS if c in df.columns]
    if present:
        values = {c: text(c) if c in present else F.lit("") for c in ATTRIBUTION_FIELDS}
        extra = F.concat_ws(",", *[json_string(values[c]) for c in ATTRIBUTION_FIELDS])
        any_set = F.concat(*values.values()) != ""
        base = F.when(any_set, F.concat_ws(",", base, extra)).otherwise(base)
    return F.concat(F.lit("["), base, F.lit("]"))


def row_hash(df: DataFrame, prev: str = "prev_hash") -> Column:
    """SHA-256 of the previous hash, a newline and the canonical row."""
    return F.sha2(F.concat(text(prev), F.lit("\n"), canonical(df)), 256)


def with_chain_key(df: DataFrame) -> DataFrame:
    """Adds ``server_id`` from the JSON arguments; '' when absent, malformed or not a string."""
    kind = F.get_json_object(text("args"), "$.server_id")
    # Only a JSON string counts: the document is parsed with a string-typed
    # field and compared with the raw member to reject numbers and objects.
    raw = F.try_variant_get(F.try_parse_json(text("args")), "$.server_id", "variant")
    is_string = F.coalesce(F.schema_of_variant(raw) == "STRING", F.lit(False))
    return df.withColumn("server_id", F.when(is_string, F.coalesce(kind, F.lit(""))).otherwise(F.lit("")))


def duplicate_rows(chained: DataFrame) -> DataFrame:
    counts = chained.groupBy(*CHAIN_KEYS, "row_hash").agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > 1).select(*CHAIN_KEYS, "row_hash")


def content_edits(chained: DataFrame) -> DataFrame:
    return chained.filter(row_hash(chained) != F.col("row_hash")).select(*CHAIN_KEYS, "row_hash")


def missing_predecessors(chained: DataFrame) -> DataFrame:
    known = chained.select(*CHAIN_KEYS, F.col("row_hash").alias("prev_hash")).distinct()
    open_rows = chained.filter(F.col("prev_hash") != "").select(*CHAIN_KEYS, "prev_hash", "row_hash")
    return lookup_join(open_rows, known, [*CHAIN_KEYS, "prev_hash"], "left_anti").select(*CHAIN_KEYS, "row_hash")


def unreachable_rows(chained: DataFrame) -> DataFrame:
    """Rows that no path of links connects to a root (a driver loop of about log2(n) rounds)."""
    chain = F.concat_ws("\u0000", *CHAIN_KEYS)
    links = chained.select(chain.alias("chain"), F.col("row_hash").alias("id"), F.col("prev_hash").alias("parent"))
    reached = reaches_root(links).select("chain", F.col("id").alias("row_hash"))
    rows = chained.select(*CHAIN_KEYS, "row_hash", chain.alias("chain"))
    return rows.join(reached, ["chain", "row_hash"], "left_anti").select(*CHAIN_KEYS, "row_hash")


def unidentified_writers(keyed: DataFrame) -> DataFrame:
    """Evidence rows that do not name the chain they belong to."""
    return keyed.filter((F.col("tier") == EVIDENCE_TIER) & (F.col("server_id") == "")).select(*CHAIN_KEYS, "row_hash")


def chain_tails(keyed: DataFrame) -> DataFrame:
    """Distinct hashes per chain that no row points at; more than one means a fork."""
    chained = keyed.filter(text("row_hash") != "")
    heads = chained.select(*CHAIN_KEYS, "row_hash").distinct()
    pointed = chained.filter(F.col("prev_hash") != "").select(*CHAIN_KEYS, F.col("prev_hash").alias("row_hash")).distinct()
    return heads.join(pointed, [*CHAIN_KEYS, "row_hash"], "left_anti")


def forks(keyed: DataFrame) -> DataFrame:
    """The tails of chains that have several."""
    tails = chain_tails(keyed)
    split = tails.groupBy(*CHAIN_KEYS).agg(F.min("row_hash").alias("_a"), F.max("row_hash").alias("_b")).filter(F.col("_a") != F.col("_b"))
    return lookup_join(tails, split.select(*CHAIN_KEYS), list(CHAIN_KEYS), "left_semi").select(*CHAIN_KEYS, "row_hash")


def chain_facts(audit: DataFrame, *carried: str) -> DataFrame:
    """``(tier, server_id, row_hash, prev_hash, edited)`` of each row: all that the checks read, and the only part that hashes content."""
    keyed = with_chain_key(audit).withColumn("prev_hash", text("prev_hash"))
    return keyed.select(*CHAIN_KEYS, "row_hash", "prev_hash", (row_hash(keyed) != F.col("row_hash")).alias("edited"), *carried)


def verify_chain(audit: DataFrame) -> DataFrame:
    """Every issue found: ``(tier, server_id, type, row_hash)``.

    Rows without a hash predate hashing and are only checked for their writer.
    """
    # The log is parsed and hashed once; every check reads what came of it.
    return chain_issues(cut_lineage(chain_facts(audit)))


def chain_issues(facts: DataFrame) -> DataFrame:
    """The issues that the facts of all rows show."""
    chained = facts.filter(text("row_hash") != "")
    edits, missing = chained.filter("edited"), cut_lineage(missing_predecessors(chained).select(*CHAIN_KEYS, "row_hash"))
    # Where every hash fits its row and every predecessor is there, links lead to the root:
    # a cycle would need a hash that holds itself.
    doubtful = edits.select(*CHAIN_KEYS).unionByName(missing.select(*CHAIN_KEYS)).distinct()
    found = {
        "duplicate_row": duplicate_rows(chained), "content_edit": edits, "missing_predecessor": missing,
        "unreachable": unreachable_rows(cut_lineage(lookup_join(chained, doubtful, list(CHAIN_KEYS), "left_semi"))),
        "unidentified_writer": unidentified_writers(facts), "fork": forks(facts),
    }
    tagged = [df.select(*CHAIN_KEYS, F.lit(kind).alias("type"), "row_hash") for kind, df in found.items()]
    return reduce(DataFrame.unionByName, tagged)


def block_digests(audit: DataFrame, key: str) -> DataFrame:
    """``(day, digest, row_count)``: one block per UTC day of ``ts``, ``none`` for rows without one.

    A row's digest is a keyed 64-bit hash of all its columns, twice; a block's is made
    of the row count and the sums of both, so it neither depends on the order nor misses
    repeats.  It tells changes from a log that nobody forges for a known ``key``.
    """
    content = F.to_json(F.struct(*sorted(audit.columns)), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    first, second = F.xxhash64(F.lit(key), content), F.xxhash64(content, F.lit(key))
    # Halves are summed, as sums of whole hashes would overflow.
    halves = [f(h) for h in (first, second) for f in (lambda h: F.shiftright(h, 32), lambda h: h.bitwiseAND(F.lit((1 << 32) - 1)))]
    sums = audit.select(_day(audit).alias("day"), *[h.alias(f"h{i}") for i, h in enumerate(halves)]).groupBy("day").agg(
        F.count(F.lit(1)).alias("row_count"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(len(halves))])
    digest = F.sha2(F.concat_ws("-", F.lit(key), "row_count", *[f"h{i}" for i in range(len(halves))]), 256)
    return sums.select("day", F.substring(digest, 1, 32).alias("digest"), "row_count")


def _day(audit: DataFrame) -> Column:
    return F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none"))


def _verified(spark, state: str) -> DataFrame:
    return spark.read.schema(FACTS).parquet(state)


def unverified_blocks(blocks: DataFrame, state: str) -> DataFrame:
    """The blocks of :func:`block_digests` whose facts are not in the table at ``state``: new, changed or half written."""
    if not path_exists(blocks.sparkSession, state):
        return blocks
    done = _verified(blocks.sparkSession, state).groupBy("day", "digest").agg(F.count(F.lit(1)).alias("row_count"))
    return blocks.join(done, ["day", "digest", "row_count"], "left_anti")


def verify_chain_onward(audit: DataFrame, state: str, key: str) -> DataFrame:
    """The issues of :func:`verify_chain`, hashing only blocks that are new or changed since the last run.

    Facts of verified rows lie in the table at ``state`` by day and digest of their
    block, so a block that changed finds none under its new digest and is hashed again;
    facts under an old digest are no longer read.  Links are checked over the facts of
    all rows, as one may lead anywhere.  The folder belongs apart from the log: who may
    write both and knows the key can forge.
    """
    spark = audit.sparkSession
    blocks = cut_lineage(block_digests(audit, key))
    todo = cut_lineage(unverified_blocks(blocks, state))
    if todo.take(1) or not path_exists(spark, state):
        rows = lookup_join(audit.withColumn("day", _day(audit)), todo.select("day", "digest"), ["day"])
        facts = chain_facts(rows, "day", "digest")
        # A few files per day, and several tasks for a long one.
        facts.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "digest").parquet(state)
    current = _verified(spark, state).join(blocks.select("day", "digest"), ["day", "digest"], "left_semi").drop("day", "digest")
    return chain_issues(cut_lineage(current))


def chain_report(audit: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows, unhashed legacy rows and issue count per chain."""
    rows = with_chain_key(audit).groupBy(*CHAIN_KEYS).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(text("row_hash") == "").alias("legacy_unhashed")
    )
    found = issues.groupBy(*CHAIN_KEYS).agg(F.count(F.lit(1)).alias("issues"))
    joined = rows.join(found, list(CHAIN_KEYS), "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    return joined.withColumn("ok", F.col("issues") == 0)


# ---------------------------------------------------------------- writing

def normal_actor_type(value: Column) -> Column:
    lowered = F.lower(F.trim(text(value)))
    return F.when(lowered.isin(*ACTOR_TYPES), lowered).otherwise("unknown")


def build_audit_rows(calls: DataFrame) -> DataFrame:
    """Audit rows from call records; ``arguments`` is a string map rendered with sorted keys."""
    entries = F.array_sort(F.map_entries(F.coalesce("arguments", F.create_map().cast("map<string,string>"))))
    pairs = F.transform(entries, lambda e: F.concat(ascii_json_string(e["key"]), F.lit(": "), ascii_json_string(e["value"])))
    return calls.select(
        "ts", "principal", "tier", "tool",
        F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("args"),
        F.coalesce("data_classes", F.array().cast("array<string>")).alias("data_classes"), "decision",
        F.coalesce(F.col("row_count"), F.lit(0)).cast("long").alias("row_count"), text("error").alias("error"),
        text("client_name").alias("client_name"), text("model_id").alias("model_id"),
        normal_actor_type(F.col("actor_type")).alias("actor_type"),
    )


_LINK_SCHEMA = "tier string, server_id string, rank long, prev_hash string, row_hash string"


def _block_linker():
    """The function that hashes one bounded block of one chain; local, so it travels with the plan."""
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        prev = pdf["seed"].iloc[0] or ""
        prevs, hashes = [], []
        for body in pdf["body"]:
            prevs.append(prev)
            prev = hashlib.sha256(f"{prev}\n{body}".encode()).hexdigest()
            hashes.append(prev)
        return pdf[["tier", "server_id", "rank"]].assign(prev_hash=prevs, row_hash=hashes)

    return link


def append_chained(rows: DataFrame, tails: DataFrame, order: tuple[str, ...] = ("ts",), block_rows: int = LINK_BLOCK_ROWS) -> DataFrame:
    """Link new rows after their chain's tail, in time order.

    A link needs the hash before it, so one chain is sequential by nature.
    Chains run side by side; a long one is cut into blocks of ``block_rows``
    that are linked one after another, each from the checkpointed tail of the
    block before, so no task ever holds more than one block, and reading only its
    own folder.  ``order`` must tell the rows of a chain apart, or the chain would
    differ from run to run: rows that it leaves equal raise a ValueError.
    """
    keyed = with_chain_key(rows).drop("prev_hash", "row_hash")
    if keyed.groupBy(*CHAIN_KEYS, *order).count().filter("count > 1").take(1):
        raise ValueError(f"rows of one chain are equal in {order}; name columns that tell them apart")
    ranked = cut_lineage(with_rank(keyed, CHAIN_KEYS, order))
    bodies = cut_lineage(ranked.select(
        *CHAIN_KEYS, "rank", canonical(ranked).alias("body"), F.floor((F.col("rank") - 1) / block_rows).alias("_block")
    ), ["_block"])
    last_block = bodies.agg(F.max("_block")).first()[0]
    if last_block is None:
        return ranked.drop("rank").withColumn("prev_hash", F.lit("")).withColumn("row_hash", F.lit(""))
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "links")
    seeds = tails.select(*CHAIN_KEYS, F.col("row_hash").alias("seed"))
    for block in range(last_block + 1):
        part = bodies.filter(F.col("_block") == block).join(seeds, list(CHAIN_KEYS), "left").select(
            *CHAIN_KEYS, "rank", "body", F.coalesce("seed", F.lit("")).alias("seed")
        )
        # A folder per block: the next one reads its tails from there, and all are read once at the end.
        part.groupBy(*CHAIN_KEYS).applyInPandas(_block_linker(), _LINK_SCHEMA).write.parquet(f"{path}/block={block}")
        done = spark.read.schema(_LINK_SCHEMA).parquet(f"{path}/block={block}")
        seeds = done.groupBy(*CHAIN_KEYS).agg(F.max_by("row_hash", "rank").alias("seed"))
    linked = spark.read.schema(f"{_LINK_SCHEMA}, block int").parquet(path).drop("block")
    return ranked.join(linked, [*CHAIN_KEYS, "rank"]).drop("rank")


# ---------------------------------------------------------------- reports

def calls_in_trailing_window(audit: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS, max_calls: int = 0) -> DataFrame:
    """Calls per principal in the window (t - w, t] ending at each call time.

    Time is cut into buckets of one window length and each call is copied to
    the next bucket as context, so a window never needs more than one
    (principal, bucket) group, whatever the principal's volume.
    """
    width = int(window_seconds * 1000)
    per_ms = audit.groupBy("principal", F.unix_millis("ts").alias("_ms")).agg(F.count(F.lit(1)).alias("calls"))
    bucket = F.floor(F.col("_ms") / width)
    copies = F.array(F.struct(F.lit(0).alias("shift"), F.lit(True).alias("own")), F.struct(F.lit(1).alias("shift"), F.lit(False).alias("own")))
    spread = per_ms.select("principal", "_ms", "calls", F.explode(copies).alias("_c")).select(
        "principal", "_ms", "calls", (bucket + F.col("_c.shift")).alias("_bucket"), F.col("_c.own").alias("_own")
    )
    w = Window.partitionBy("principal", "_bucket").orderBy("_ms").rangeBetween(-(width - 1), 0)
    counted = spread.withColumn("calls_in_window", F.sum("calls").over(w)).filter("_own")
    return counted.select(
        "principal", F.timestamp_millis("_ms").alias("ts"), "calls", "calls_in_window",
        (F.lit(max_calls > 0) & (F.col("calls_in_window") > max_calls)).alias("breach"),
    )


def dyadic_cover(lo: Column, hi: Column, levels: int = 41) -> Column:
    """The unique smallest cover of whole numbers ``lo`` to ``hi`` by ranges ``[index 2^level, (index + 1) 2^level)``.

    An array of ``(level, index)``, at most two of each level: the range of a level that
    starts at an odd index on the left, and the one that ends at an odd index on the right.
    """
    size = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def pieces(k: Column) -> Column:
        first, end = F.ceil(lo / size(k)).cast("long"), F.floor((hi + 1) / size(k)).cast("long")
        left = F.when((first < end) & (first % 2 != 0), F.struct(k.alias("level"), first.alias("index")))
        right = F.when((first < end) & (end % 2 != 0), F.struct(k.alias("level"), (end - 1).alias("index")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), pieces)), lambda p: p.isNotNull())


def tools_used(audit: DataFrame, intervals: DataFrame, slop_seconds: int = 0) -> DataFrame:
    """Distinct allowed tools per ``(interval_id, principal, started, finished)``.

    A range join on (principal, range): an interval of any length is covered by dyadic
    ranges of about a second and up, ten years by under 60, and each call looks for the
    range around it at every level that some interval uses.  The exact bounds are
    checked on the match.
    """
    slop = F.expr(f"INTERVAL '{int(slop_seconds)}' SECOND")
    spans = intervals.select(
        "interval_id", "principal",
        F.date_trunc("millisecond", F.col("started") - slop).alias("_lo"), F.date_trunc("millisecond", F.col("finished") + slop).alias("_hi"),
    ).filter(F.col("_lo") <= F.col("_hi"))
    unit = lambda c: F.floor(F.unix_millis(c) / 1024)
    covered = cut_lineage(spans.withColumn("_piece", F.explode(dyadic_cover(unit("_lo"), unit("_hi")))).select("*", "_piece.level", "_piece.index").drop("_piece"))
    # At most one value per level.
    levels = sorted(r["level"] for r in covered.select("level").distinct().collect())
    calls = audit.filter(F.col("decision") == "allow").select("principal", "tool", "ts").distinct()
    probes = calls.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn(
        "index", F.call_function("shiftright", unit("ts"), F.col("level")))
    hits = lookup_join(probes, covered, ["principal", "level", "index"]).filter(F.col("ts").between(F.col("_lo"), F.col("_hi")))
    sets = hits.select("interval_id", "tool").distinct().groupBy("interval_id").agg(F.array_sort(F.collect_list("tool")).alias("tools"))
    return intervals.select("interval_id", "principal").join(sets, "interval_id", "left").withColumn(
        "tools", F.coalesce("tools", F.array().cast("array<string>"))
    )
