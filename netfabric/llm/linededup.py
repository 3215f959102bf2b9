"""Line deduplication that can be undone: exact reference counts behind sharded cuckoo filters.

The index has three parts: ``refs``, one row per line key and document that
holds it; ``counts``, the number of documents and the largest id per key; and
``filters``, one cuckoo filter per shard with the keys that enough documents
hold.  Inserting or deleting documents touches the keys they hold: those are
counted again, and keys that cross the limit enter or leave their filter.
Lines are dropped by probing the filters and confirming hits by the counts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfabric.llm import textbuf
from netfabric.session import cut_lineage

MIN_CHARS = 20
MIN_DOCS = 3
SLOTS = 4
LOAD = 0.84
KICKS = 500
#: About so many references of a shard meet a copy of its filter in one group.
GROUP_REFS = 1_000_000
DOCS_PER_SHARD = 100_000
REF = "h1 long, h2 long, doc_id long"
KEY = ["h1", "h2"]


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets, each found from the other."""

    def __init__(self, buckets: int, cells: array | None = None) -> None:
        self.buckets = buckets
        self.cells = cells if cells is not None else array("H", bytes(2 * SLOTS * buckets))

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, (int(keys / (SLOTS * LOAD)) or 1).bit_length()))

    @staticmethod
    def fingerprints(h2: np.ndarray) -> np.ndarray:
        fp = (h2.view(np.uint64) & np.uint64(0xFFFF)).astype(np.int64)
        return np.where(fp == 0, 1, fp)

    def places(self, h1: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = (h1.view(np.uint64) & np.uint64(self.buckets - 1)).astype(np.int64)
        return first, first ^ self.step(fp)

    def step(self, fp: np.ndarray) -> np.ndarray:
        return (textbuf.mix(fp.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        table, fp = np.frombuffer(self.cells, np.uint16).reshape(-1, SLOTS), self.fingerprints(h2)
        return np.logical_or(*((table[at] == fp[:, None].astype(np.uint16)).any(axis=1) for at in self.places(h1, fp)))

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if a key found no place; the filter is then too full and has to be built again."""
        fps = self.fingerprints(h2)
        steps = dict(zip(np.unique(fps).tolist(), self.step(np.unique(fps)).tolist(), strict=True))
        cells = self.cells
        for fp, *at in zip(fps.tolist(), *(x.tolist() for x in self.places(h1, fps)), strict=True):
            if not any(self._put(b, fp) for b in at):
                bucket = at[fp & 1]
                for turn in range(KICKS):
                    slot = bucket * SLOTS + (turn + fp) % SLOTS
                    fp, cells[slot] = cells[slot], fp
                    if fp not in steps:
                        steps[fp] = int(self.step(np.array([fp]))[0])
                    bucket ^= steps[fp]
                    if self._put(bucket, fp):
                        break
                else:
                    return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Remove keys that were inserted before."""
        fps = self.fingerprints(h2)
        for fp, *at in zip(fps.tolist(), *(x.tolist() for x in self.places(h1, fps)), strict=True):
            for b in at:
                own = self.cells[b * SLOTS : (b + 1) * SLOTS]
                if fp in own:
                    self.cells[b * SLOTS + own.index(fp)] = 0
                    break

    def _put(self, bucket: int, fp: int) -> bool:
        for slot in range(bucket * SLOTS, (bucket + 1) * SLOTS):
            if self.cells[slot] == 0:
                self.cells[slot] = fp
                return True
        return False


def filled(h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
    room = max(1, len(h1))
    while not (made := CuckooFilter.sized(room)).insert(h1, h2):
        room *= 2
    return made


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def line_spans(chunk: textbuf.Chunk, min_chars: int) -> tuple[np.ndarray, ...]:
    """Of each line: start and end, the two halves of its key's digest, the key's code points; and the lines before each row.

    Keys of under ``min_chars`` code points have no digest.
    """
    data, offsets = chunk.data, chunk.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    bounds = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    solid = np.append(np.flatnonzero(~textbuf.SPACE[data]), len(data))
    left = np.minimum(solid[np.searchsorted(solid, starts)], ends)
    right = np.maximum(solid[np.searchsorted(solid[:-1], ends) - 1] + 1 if len(solid) > 1 else left, left)
    right = np.where(left == ends, left, right)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    low = textbuf.LOWER[data]
    chars = chars[right] - chars[left]
    keyed = np.flatnonzero(chars >= min_chars)
    keys = np.zeros((len(starts), 2), np.int64)
    keys[keyed] = textbuf.key_digests(low, left[keyed], right[keyed])
    return starts, ends, keys[:, 0], keys[:, 1], chars, bounds


def references(docs: DataFrame, id_col: str, text_col: str, min_chars: int, shards: int) -> DataFrame:
    """``(shard, h1, h2, doc_id)``: each key that a document holds, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for chunk in textbuf.chunks(batch.column("text")):
                _, _, h1, h2, chars, bounds = line_spans(chunk, min_chars)
                row = textbuf.owners(bounds)
                at = np.flatnonzero(chars >= min_chars)
                at = at[np.lexsort((h2[at], h1[at], row[at]))]
                new = np.ones(len(at), bool)
                new[1:] = (h1[at][1:] != h1[at][:-1]) | (h2[at][1:] != h2[at][:-1]) | (row[at][1:] != row[at][:-1])
                at = at[new]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[at], h2[at], ids[chunk.lo + row[at]])], ["h1", "h2", "doc_id"])

    held = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    refs = held.mapInArrow(run, REF)
    return refs.select(F.pmod(F.shiftright("h1", 40), F.lit(shards)).cast("int").alias("shard"), *KEY, "doc_id")


def store(refs: DataFrame) -> DataFrame:
    """References in the shared folder, a shard's rows together; a shard with a hot line is divided."""
    return cut_lineage(refs.hint("rebalance", "shard"))


def count_references(refs: DataFrame) -> DataFrame:
    """``(shard, h1, h2, n_docs, last_doc)``: a document counts once, whatever its rows."""
    once = refs.groupBy("shard", *KEY, "doc_id").agg(F.lit(1).alias("_one"))
    return once.groupBy("shard", *KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """``(shard, buckets, cells)`` of ``keys (shard, h1, h2)``."""

    def run(group: pa.Table) -> pa.Table:
        made = filled(group.column("h1").to_numpy(), group.column("h2").to_numpy())
        return pa.table({"shard": group.column("shard")[:1].cast(pa.int32()), "buckets": [made.buckets], "cells": [made.cells.tobytes()]})

    return keys.groupBy("shard").applyInArrow(run, "shard int, buckets long, cells binary")


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
    shards: int | None = None,
) -> LineIndex:
    """Index all lines of ``docs``.  Shards grow with the documents, so a filter stays small."""
    shards = shards or max(16, 1 << (docs.count() // DOCS_PER_SHARD).bit_length())
    refs = store(references(docs, id_col, text_col, min_chars, shards))
    counts = cut_lineage(count_references(refs).filter(F.col("n_docs") > 1))
    keys = counts.filter(F.col("n_docs") >= min_docs).select("shard", *KEY)
    return LineIndex(refs, counts, cut_lineage(build_filters(keys, shards)), shards, min_docs, min_chars)


def _recount(index: LineIndex, refs: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over ``refs``, of which only keys in ``touched`` have changed."""
    touched = cut_lineage(touched.select(*KEY).distinct())
    fresh = cut_lineage(count_references(refs.join(touched, KEY, "left_semi")).filter(F.col("n_docs") > 1)).select(*index.counts.columns)
    counts = cut_lineage(fresh.unionByName(index.counts.join(touched, KEY, "left_anti")))
    often = lambda c: c.filter(F.col("n_docs") >= index.min_docs).select("shard", *KEY)
    was, now = often(index.counts.join(touched, KEY, "left_semi")), often(fresh)
    changes = now.join(was, KEY, "left_anti").withColumn("gain", F.lit(True)).unionByName(
        was.join(now, KEY, "left_anti").withColumn("gain", F.lit(False)))
    alive = often(counts)

    def apply(old: pa.Table, change: pa.Table) -> pa.Table:
        if not old.num_rows:
            own = change.filter(change.column("gain"))
            made = filled(own.column("h1").to_numpy(), own.column("h2").to_numpy())
        else:
            made = CuckooFilter(old.column("buckets")[0].as_py(), array("H", old.column("cells")[0].as_py()))
            for gain in (False, True):
                own = change.filter(pc.equal(change.column("gain"), gain))
                keys = own.column("h1").to_numpy(), own.column("h2").to_numpy()
                if not gain:
                    made.delete(*keys)
                elif not made.insert(*keys):
                    return pa.table({"shard": old.column("shard"), "buckets": pa.array([0], pa.int64()), "cells": [b""]})
        shard = (old if old.num_rows else change).column("shard")[:1].cast(pa.int32())
        return pa.table({"shard": shard, "buckets": pa.array([made.buckets], pa.int64()), "cells": [made.cells.tobytes()]})

    filters = cut_lineage(
        index.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(apply, "shard int, buckets long, cells binary"))
    # A filter that had no room left is built again from the counts.
    full = filters.filter("buckets = 0").select("shard")
    again = build_filters(alive.join(full, "shard", "left_semi"), index.shards)
    return replace(index, refs=refs, counts=counts, filters=cut_lineage(filters.filter("buckets > 0").unionByName(again)))


def insert_documents(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with the lines of more documents."""
    new = store(references(docs, id_col, text_col, index.min_chars, index.shards))
    return _recount(index, index.refs.unionByName(new), new)


def delete_documents(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of ``ids (doc_id)``, as if they had never been there."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    gone = index.refs.join(ids, "doc_id", "left_semi")
    return _recount(index, store(index.refs.join(ids, "doc_id", "left_anti")), gone)


def dropped_keys(index: LineIndex, group_refs: int = GROUP_REFS) -> DataFrame:
    """``(doc_id, h1)``: the keys that each document loses.

    The references of a shard meet its filter in groups of about ``group_refs``, dealt by
    document, so that the shard of a hot line is divided; a group holds one copy of the
    filter, which is no larger than the keys of its shard.  What passes is confirmed by
    the exact counts.
    """
    parts = index.refs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / group_refs).cast("int").alias("parts"))
    # A written table has a known size, so the references are not shuffled by shard to join it.
    parts = cut_lineage(parts.join(index.filters, "shard", "left_semi"))
    of = ["shard", "part"]
    refs = index.refs.join(parts, "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), *KEY, "doc_id")
    filters = index.filters.join(parts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "buckets", "cells")

    def probe(held: pa.Table, own: pa.Table) -> pa.Table:
        if not held.num_rows:
            return held.select([*KEY, "doc_id"])
        made = CuckooFilter(own.column("buckets")[0].as_py(), array("H", own.column("cells")[0].as_py()))
        hit = made.contains(*(held.column(c).to_numpy() for c in KEY))
        return held.select([*KEY, "doc_id"]).filter(pa.array(hit))

    hits = refs.groupBy(*of).cogroup(filters.groupBy(*of)).applyInArrow(probe, REF)
    often = index.counts.filter(F.col("n_docs") >= index.min_docs).select(*KEY, "last_doc")
    return hits.join(often, KEY).filter("doc_id <> last_doc").select("doc_id", "h1")


def drop_lines(
    docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text", group_refs: int = GROUP_REFS,
) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_text)`` for every row of ``docs``.

    A key that ``min_docs`` documents hold loses its lines in all of them but the one
    with the largest id, where all of them stay.  A null or empty text is one empty
    line.  Rows with one id count as one document; a row with a null id is not counted
    and loses nothing.  Extra columns are ignored; an empty table gives no rows.
    """
    drops = dropped_keys(index, group_refs).groupBy("doc_id").agg(F.collect_set("h1").alias("drops"))
    joined = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(drops, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column("drops")
            for chunk in textbuf.chunks(batch.column("text")):
                starts, ends, h1, _, chars, bounds = line_spans(chunk, index_chars)
                data, texts, gone = chunk.data.tobytes(), [], []
                for i in range(chunk.hi - chunk.lo):
                    own = drops[chunk.lo + i]
                    if not own.is_valid:
                        gone.append(0)
                        texts.append(data[chunk.offsets[i] : chunk.offsets[i + 1]])
                        continue
                    span = slice(bounds[i], bounds[i + 1])
                    out = np.isin(h1[span], np.array(own.as_py(), np.int64)) & (chars[span] >= index_chars)
                    keep = np.flatnonzero(~out) + bounds[i]
                    gone.append(int(out.sum()))
                    texts.append(b"\n".join(data[starts[k] : ends[k]] for k in keep))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo), pa.array(np.diff(bounds)), pa.array(gone, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    index_chars = index.min_chars
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")


LINES_SQL = """
WITH l AS (
  SELECT doc_id, pos, unnest AS line, translate(regexp_replace(unnest, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(COALESCE(text, ''), chr(10))) AS unnest,
          generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS pos FROM documents)
), k AS (
  SELECT key, max(doc_id) AS last_doc FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.last_doc AS gone FROM l LEFT JOIN k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
