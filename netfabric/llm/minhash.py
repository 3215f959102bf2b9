"""Near-duplicate documents by MinHash banding, verified on whole shingle sets.

1. One pass signs every text: many universal hash minima over its shingles, one
   key per band of minima, and a digest of the whole set.
2. Texts with equal sets form classes; only each class's smallest id goes on.
3. Ids that share a band key are candidates.  First, every id is compared on
   whole sets with the bucket hub it shares most bands with; verified links
   give components.
4. In buckets that still hold several components, texts are compared across
   components, in blocks: first their signatures, then, where the estimate can
   belong to a link, their whole sets.  Pairs inside a component cannot change it.
5. Components by alternating large-star and small-star.

No step emits all pairs of a group, and none bounds the partners of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfabric.llm import textbuf
from netfabric.llm.components import connected_components
from netfabric.session import cut_lineage

BANDS = 32
ROWS = 5
SEED = 20240607
#: Five and a half standard deviations of an estimate at similarity 0.8 below it.
SLACK = 5.5
STAR_ROWS = 2000
BLOCK_SHINGLES = 2_000_000
SIGNED = "id long, n_shingles long, set_hi long, set_lo long, bands array<long>, signature binary"


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(lo, hi, hashes, counts)`` per chunk of rows: each row's distinct shingles, sorted, one row after another.

    Words are split at ASCII white space and A-Z lower-cased.  A row of fewer
    words than ``size`` has its whole sequence as one shingle, one without words none.
    """
    for chunk in textbuf.chunks(texts):
        w = textbuf.words(textbuf.LOWER[chunk.data], chunk.offsets)
        rows, have = chunk.hi - chunk.lo, np.diff(w.bounds)
        hashes, owner = [], []
        of = textbuf.owners(w.bounds)
        for k in range(1, size + 1):
            at = np.arange(max(0, len(w.hashes) - k + 1))
            if k < size:
                at = at[(have[of[at]] == k) & (at == w.bounds[of[at]])]
            else:
                at = at[of[at] == of[at + k - 1]]
            h = np.full(len(at), k, np.uint64)
            for j in range(k):
                h = textbuf.mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hashes[at + j])
            hashes.append(h)
            owner.append(of[at])
        h, row = np.concatenate(hashes), np.concatenate(owner)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield chunk.lo, chunk.hi, h[fresh], np.bincount(row[fresh], minlength=rows)


def minima(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each of ``n`` universal hash functions over each non-empty span: ``(spans, n)`` of 32 bits."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
    out = np.empty((len(starts), n), np.uint32)
    for j in range(n):
        out[:, j] = np.minimum.reduceat((hashes * a[j] + b[j]) >> np.uint64(32), starts)
    return out


def sign(docs: DataFrame, shingle: int) -> DataFrame:
    """One row of ``SIGNED`` per row of ``docs (id, text)``; the arrays of an empty set are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for lo, hi, h, counts in shingle_sets(batch.column("text"), shingle):
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                digest = np.zeros((2, hi - lo), np.uint64)
                keys, sig = np.zeros((0, BANDS), np.uint64), np.zeros((0, BANDS * ROWS), np.uint16)
                if len(full):
                    for k, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
                        digest[k, full] = np.add.reduceat(textbuf.mix(h ^ np.uint64(salt)), starts)
                    m = minima(h, starts, BANDS * ROWS)
                    sig = m.astype(np.uint16)
                    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(full), 0)
                    for j in range(ROWS):
                        keys = textbuf.mix(keys * np.uint64(0x9E3779B97F4A7C15) + m[:, j::ROWS])
                at = np.concatenate([[0], np.cumsum(counts > 0)])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), pa.array(counts.astype(np.int64)), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array((at * BANDS).astype(np.int32)), pa.array(keys.ravel().view(np.int64))),
                    pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at * BANDS * ROWS * 2).astype(np.int32)), pa.py_buffer(sig.tobytes())]),
                ], ["id", "n_shingles", "set_hi", "set_lo", "bands", "signature"])

    return docs.mapInArrow(run, SIGNED)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct sets have a Jaccard similarity of ``percent`` or more."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verify_stars(texts: DataFrame, stars: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``(hub, id)`` of ``stars`` that are links.  Each member's text is moved to its hub once.

    A hub with many members is copied to several groups of ``STAR_ROWS``.
    """
    parts = stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("parts"))
    hubs = parts.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = stars.join(parts, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    roles = members.unionByName(hubs)
    groups = texts.join(roles, "id").repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("id") != F.col("hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            ids, hub_ids = batch.column("id").to_numpy(), batch.column("hub").to_numpy()
            found = []
            for lo, _, h, counts in shingle_sets(batch.column("text"), shingle):
                ends = np.cumsum(counts)
                for i, (end, n) in enumerate(zip(ends, counts, strict=True), lo):
                    own = h[end - n : end]
                    if ids[i] == hub_ids[i]:
                        hub, centre = ids[i], own.copy()
                    elif hub == hub_ids[i] and n and len(centre) and similar(own, centre, percent):
                        found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(hub_ids[found], pa.int64()), pa.array(ids[found], pa.int64())], ["a", "b"])

    return groups.select("id", "hub", "text").mapInArrow(run, "a long, b long")


def across_components(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between different components of one bucket, at least one for each pair of them that has any.

    ``rows`` is ``(key, id, component, n_shingles, bands, signature, text)``.  A bucket
    of more than ``BLOCK_SHINGLES`` is cut into blocks, and each pair of blocks is
    compared by a group of its own.  Pairs whose signatures are too far apart for a
    link are left out; the others are compared on whole sets, in the first bucket that
    they share only.  A row gives one link for each other component.
    """
    blocks = rows.groupBy("key").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "component", "id", "bands",
        "signature", "text")
    cells = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "component")
    n = BANDS * ROWS
    share = percent / 100
    least = max(1, int(np.floor(n * share - SLACK * np.sqrt(n * share * (1 - share)))))

    def compare(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """All rows of one cell, in order of component."""
        cell = pa.Table.from_batches(parts).combine_chunks()
        m = cell.num_rows
        key, lo, hi = (cell.column(c)[0].as_py() for c in ("key", "lo", "hi"))
        component, ids, block = (cell.column(c).to_numpy() for c in ("component", "id", "block"))
        bands = np.array(cell.column("bands").combine_chunks().flatten()).reshape(m, BANDS)
        sig = np.frombuffer(b"".join(cell.column("signature").to_pylist()), np.uint16).reshape(m, n)
        sets = []
        for _, _, h, counts in shingle_sets(cell.column("text").combine_chunks(), shingle):
            sets += np.split(h, np.cumsum(counts)[:-1])
        size = np.array([len(x) for x in sets])
        a, b = [], []
        for i, j in enumerate(np.searchsorted(component, component, "right")):
            if j == m:
                break
            same = (sig[j:] == sig[i]).sum(axis=1)
            fits = 100 * np.minimum(size[j:], size[i]) >= percent * np.maximum(size[j:], size[i])
            near = np.flatnonzero((same >= least) & fits & ((block[j:] != block[i]) | (lo == hi))) + j
            near = near[bands[i][(bands[near] == bands[i]).argmax(axis=1)] == key]
            if not len(near):
                continue
            flat = np.concatenate([sets[k] for k in near])
            held = sets[i][np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)] == flat
            both = np.add.reduceat(held.astype(np.int64), np.cumsum(size[near]) - size[near])
            linked = near[100 * both >= percent * (size[near] + size[i] - both)]
            _, first = np.unique(component[linked], return_index=True)
            a += [ids[i]] * len(first)
            b += ids[linked[first]].tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if start == end:
                    continue
                if (now := tuple(keys[:, start])) != cell:
                    if held:
                        yield compare(held)
                    cell, held = now, []
                held.append(batch.slice(start, end - start))
        if held:
            yield compare(held)

    return cells.mapInArrow(run, "a long, b long")


def label(df: DataFrame, components: DataFrame, id_col: str, name: str) -> DataFrame:
    """``df`` with the component of an id column; an id without links is its own."""
    found = components.select(F.col("id").alias(id_col), F.col("component").alias("_c"))
    return df.join(found, id_col, "left").withColumn(name, F.coalesce("_c", id_col)).drop("_c")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Two documents are linked if 100 x intersection >= ``percent`` x union of their
    distinct word shingles; ``component_id`` is the smallest id that can be reached.
    Null, empty and wordless texts have no shingles and link with nothing; a row with
    a null id has a null component and is not kept.  Ids are unique, save that whole
    rows may repeat; the repeats share a component.  An empty table gives no rows;
    extra columns are ignored.  With 32 bands of 5 minima a link of similarity 0.8 is
    missed with a chance of 3e-6, one of 0.9 with less than 1e-12.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut_lineage(sign(source, shingle))
    usable = signed.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = cut_lineage(usable.groupBy("set_hi", "set_lo").agg(F.min("id").alias("rep")))
    reps = usable.select("id", "bands").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    keyed = reps.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    members = cut_lineage(keyed.join(shared.filter("lo < hi").select("key", "n"), "key"))
    texts = cut_lineage(source.join(members.select("id").distinct(), "id", "left_semi"))

    # The hub of a bucket is its member with most company over all buckets: the middle of a group of copies.
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "id").groupBy("key").agg(F.max_by("id", F.struct("company", -F.col("id"))).alias("hub"))
    votes = members.join(hubs, "key").filter("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n"))
    stars = cut_lineage(votes.groupBy("id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")))
    links = cut_lineage(verify_stars(texts, stars, shingle, percent).distinct())
    components = connected_components(links)

    labelled = cut_lineage(label(members.select("key", "id"), components, "id", "component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    signs = usable.select("id", "n_shingles", "bands", "signature").dropDuplicates(["id"])
    open_rows = labelled.join(mixed, "key", "left_semi").join(signs, "id").join(texts.dropDuplicates(["id"]), "id")
    more = cut_lineage(across_components(open_rows, shingle, percent))
    if more.take(1):
        components = connected_components(links.unionByName(more))

    found = label(classes, components, "rep", "component")
    # Null sets match no class, so rows without shingles keep their own id.
    joined = signed.select(
        "id", "n_shingles", *[F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("set_hi", "set_lo")]
    ).join(found, ["set_hi", "set_lo"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
