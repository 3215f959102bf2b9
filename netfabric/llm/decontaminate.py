"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items become passages; their terms are weighted by document
   frequencies over the whole corpus.
2. A randomised SVD of the TF-IDF passages, made by Spark in blocks of passages,
   gives a latent space of a rank far below their number.
3. Every window of every document is projected into it.  A passage is a candidate
   where the window's projection on it, over the passage's own square, reaches a
   limit: the share of the passage's weight that the window holds.  A verbatim copy
   has 1 however large the corpus and however common the leak, which a cosine has
   not.  The few passages of which the space keeps next to nothing are candidates
   where the window holds enough of their words, counted exactly.
4. A candidate counts if the longest common subsequence of words covers most of
   the passage, or a good part of it together with its answer; so a passage that
   was reworded in places is found as well.  The latter also needs the cosine or
   a part of the passage's own weight, as common words alone meet it by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfabric.llm import textbuf
from netfabric.session import cut_lineage

WINDOW = 64
STEP = 32
#: Passages of one latent space, and its rank.
BLOCK = 256
RANK = 96
OVERSAMPLE = 8
#: Share of a passage's weight that a window has to hold, as the latent space sees it.  What it sees of unrelated passages is 0.1 or less.
SHARE = 0.4
#: Of a passage's square, the space has to keep so much for its shares to be trusted.
KEPT = 0.1
COSINE = 0.2
LCS_ALONE = 0.7
LCS_WITH_ANSWER = 0.5
ANSWER = 0.8
#: Share of a passage's weight (squared, over its distinct terms) that a stretch has to hold if the cosine is lower than ``COSINE``
#: and the subsequence than ``LCS_ALONE``; a verbatim copy has 1, chance matches of common words had 0.2 at most.
WEIGHT = 0.25
ANSWER_WORDS = 8
#: Steps of a window: any passage lies in one whole, wherever it begins.
SPAN = (WINDOW + STEP) // STEP + 1
#: Steps of a window's stretch before and after its first one.
BEFORE, AFTER = 1, SPAN
#: Terms of at least so many passages of a block are counted by a matrix product, the others by their lists of passages.
MANY = 8
#: Windows whose words are counted at once.
SLICE = 4096
#: A passage has fewer words; words and words of the answer are counted in one number, the latter times this.
CODE = 128
#: Latent spaces are sent to the executors in groups, which end when they have so many bytes.
GROUP_BYTES = 128 << 20
TO_WORD = np.array([textbuf.LOWER[b] if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256)], np.uint8)
PASSAGE = "item_id long, part int, block int, terms array<long>"
VECTOR = "term long, vector array<double>"
MATCH = "doc_id long, item_id long, part int, cosine double, lcs_share double, answer_share double, first_word long"


class Counts(NamedTuple):
    """How often each passage has each term, in all and, times ``CODE``, in its answer.

    Term ``t`` is row ``column[t]`` of ``dense``, or, if that is -1, has the passages ``passage[starts[t]:starts[t + 1]]``.
    ``alone``, ``with_answer`` and ``answer`` are the fewest words with which a passage can reach the limits.
    """

    column: np.ndarray
    dense: np.ndarray
    starts: np.ndarray
    passage: np.ndarray
    code: np.ndarray
    alone: np.ndarray
    with_answer: np.ndarray
    answer: np.ndarray


class Space(NamedTuple):
    """A latent space: its terms in order, their weights and axes (times the weights), and its passages.

    A projected window times a column of ``latent`` is the share of that passage; 0 for those in ``poor``, of
    which the space keeps too little.  ``counts`` says how often the poor passages have each term, ``own`` has
    the places of each passage's distinct terms, ``square`` its weight.
    """

    terms: np.ndarray
    idf: np.ndarray
    axes: np.ndarray
    latent: np.ndarray
    words: list[np.ndarray]
    items: np.ndarray
    parts: np.ndarray
    rare: float
    square: np.ndarray
    poor: np.ndarray
    counts: Counts | None
    own: list[np.ndarray]


def words_of(chunk: textbuf.Chunk) -> textbuf.Words:
    return textbuf.words(TO_WORD[chunk.data], chunk.offsets)


def passages_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``PASSAGE`` rows: an item of up to one and a half windows is one passage, a longer one several that overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids = batch.column("id").to_pylist()
            for chunk in textbuf.chunks(batch.column("text")):
                w = words_of(chunk)
                for i in range(chunk.hi - chunk.lo):
                    own = w.hashes[w.bounds[i] : w.bounds[i + 1]].view(np.int64)
                    cuts = [0] if len(own) <= WINDOW + STEP else range(0, len(own) - STEP, STEP)
                    spans = [own] if len(own) <= WINDOW + STEP else [own[c : c + WINDOW] for c in cuts]
                    out += [{"item_id": ids[chunk.lo + i], "part": k, "block": 0, "terms": s} for k, s in enumerate(spans) if len(s)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("item_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("terms", pa.list_(pa.int64()))])
    rows = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, PASSAGE)


def lookup(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Position of each hash in the sorted vocabulary, -1 where it has none."""
    if not len(vocabulary):
        return np.full(len(hashes), -1)
    bits = np.zeros(1 << 20, bool)
    bits[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    out = np.full(len(hashes), -1)
    out[maybe] = np.where(vocabulary[at] == hashes[maybe], at, -1)
    return out


def document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, df)`` of the benchmark's terms over all documents (``id``, ``text``).

    The terms are sent out in parts of ``BLOCK`` passages' size, so a part has a bound.
    """
    spark, most = docs.sparkSession, BLOCK * (WINDOW + STEP)
    n = terms.count()
    counted = None
    for part in range(max(1, -(-n // most))):
        mine = terms.filter(F.pmod(F.xxhash64("term"), F.lit(max(1, -(-n // most)))) == part).toArrow().column("term").to_numpy()
        shared = spark.sparkContext.broadcast(np.sort(mine.view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary = shared.value
            seen = np.zeros(len(vocabulary), np.int64)
            for batch in batches:
                for chunk in textbuf.chunks(batch.column("text")):
                    w = words_of(chunk)
                    at = lookup(vocabulary, w.hashes)
                    hit = at >= 0
                    pairs = np.unique(textbuf.owners(w.bounds)[hit] * len(vocabulary) + at[hit])
                    seen += np.bincount(pairs % max(1, len(vocabulary)), minlength=len(vocabulary))
            found = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(vocabulary[found].view(np.int64)), pa.array(seen[found])], ["term", "df"])

        rows = docs.select("text").mapInArrow(run, "term long, df long")
        counted = rows if counted is None else counted.unionByName(rows)
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def omega(terms: np.ndarray, k: int) -> np.ndarray:
    """The Gaussian test matrix's rows of some terms, from their hashes, so that every task has the same."""
    keys = textbuf.mix(terms[:, None] + np.arange(2 * k, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))
    u = ((keys >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return np.sqrt(-2 * np.log(u[:, :k])) * np.cos(2 * np.pi * u[:, k:])


def gram(vectors: DataFrame, k: int) -> np.ndarray:
    """Sum of the outer products of all ``vector``s: k x k numbers, added up on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            v = np.array(batch.column("vector").flatten()).reshape(-1, k)
            total += v.T @ v
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

    cells = vectors.select("vector").mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((k, k))
    out[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("x").to_numpy()
    return out


def whitening(g: np.ndarray) -> np.ndarray:
    """``w`` such that ``w.T @ g @ w`` is the identity on the part of ``g`` that is not null; other columns are 0."""
    values, vectors = np.linalg.eigh(g)
    keep = values > max(values.max(), 0) * 1e-10
    return np.where(keep, vectors / np.sqrt(np.where(keep, values, 1)), 0)


def randomized_svd(rows: DataFrame, k: int) -> DataFrame:
    """``VECTOR`` rows: each term's coordinates on ``k`` right singular axes of ``rows (terms, weights)``.

    Y = A Omega per row; Q = Y W with W from the small matrix Y'Y; B = Q'A summed by
    term over the shuffle; the axes follow from the small matrix BB'.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(omega(np.array(t, np.int64).view(np.uint64), k) * np.array(w)[:, None]).sum(axis=0)
                   for t, w in zip(batch.column("terms").to_pylist(), batch.column("weights").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("terms"), batch.column("weights"), pa.array(out, pa.list_(pa.float64()))], ["terms", "weights", "vector"])

    sketched = cut_lineage(rows.select("terms", "weights").mapInArrow(sketch, "terms array<long>, weights array<double>, vector array<double>"))
    base = whitening(gram(sketched, k))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.array(batch.column("vector").flatten()).reshape(-1, k) @ base
            terms = [np.array(t, np.int64) for t in batch.column("terms").to_pylist()]
            weights = np.array(batch.column("weights").flatten())
            owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            own, at = np.unique(np.concatenate([*terms, np.zeros(0, np.int64)]), return_inverse=True)
            total = np.zeros((len(own), k))
            np.add.at(total, at, q[owner] * weights[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(total), pa.list_(pa.float64()))], ["term", "vector"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, total = None, np.zeros(k)
        for batch in batches:
            for t, v in zip(batch.column("term").to_pylist(), np.array(batch.column("vector").flatten()).reshape(-1, k), strict=True):
                if t != term:
                    if term is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([term]), pa.array([total], pa.list_(pa.float64()))], ["term", "vector"])
                    term, total = t, np.zeros(k)
                total = total + v
        if term is not None:
            yield pa.RecordBatch.from_arrays([pa.array([term]), pa.array([total], pa.list_(pa.float64()))], ["term", "vector"])

    parts = sketched.mapInArrow(back, VECTOR)
    small = cut_lineage(parts.repartition("term").sortWithinPartitions("term").mapInArrow(add, VECTOR))
    turn = whitening(gram(small, k))

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column("vector").flatten()).reshape(-1, k) @ turn
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(list(v), pa.list_(pa.float64()))], ["term", "vector"])

    return small.mapInArrow(rotate, VECTOR)


def fit_spaces(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Space]:
    """Latent spaces of the benchmark's passages, ``BLOCK`` passages each; texts of ``docs (id, text)`` are in lower case.

    Each is fitted when it is asked for, so the driver need not hold all of them.
    """
    passages = cut_lineage(passages_of(benchmark, id_col, text_col))
    total, n = passages.count(), docs.count()
    if not total or not n:
        return
    blocks = -(-total // BLOCK)
    # A little above the mean, so that the hash rarely gives a block more passages than it has axes.
    blocks = blocks if blocks == 1 else -(-total * 5 // (BLOCK * 4))
    placed = passages.withColumn("block", F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)).cast("int"))
    terms = passages.select(F.explode("terms").alias("term")).distinct()
    idf = cut_lineage(terms.join(document_frequencies(docs, terms), "term", "left").select(
        "term", F.log(F.lit(1.0 + n) / (1.0 + F.coalesce("df", F.lit(0)))).alias("idf")))
    weighted = placed.select("item_id", "part", "block", F.explode("terms").alias("term")).distinct().join(idf, "term").withColumn("w", F.col("idf"))
    # Terms and passages without weight stay: they add nothing to a cosine, and are still counted.
    rows = cut_lineage(weighted.groupBy("item_id", "part", "block").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("tw")).select(
        "item_id", "part", "block", F.col("tw.term").alias("terms"), F.col("tw.w").alias("weights"))
        .join(placed.select("item_id", "part", F.col("terms").alias("words")), ["item_id", "part"]))
    for block in range(blocks):
        own = rows.filter(F.col("block") == block)
        held = own.orderBy("item_id", "part").toArrow()
        if not held.num_rows:
            continue
        k = min(held.num_rows, RANK) + OVERSAMPLE
        axes = randomized_svd(own, k).join(idf, "term").toArrow().sort_by("term")
        term = axes.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term)
        vectors = np.array(axes.column("vector").combine_chunks().flatten()).reshape(-1, k)[order].astype(np.float32)
        term = term[order]
        weight = axes.column("idf").to_numpy()[order]
        latent, square = [], []
        for t, w in zip(held.column("terms").to_pylist(), held.column("weights").to_pylist(), strict=True):
            w, at = np.array(w), np.searchsorted(term, np.array(t, np.int64).view(np.uint64))
            square.append(float((w * w).sum()))
            latent.append(w @ vectors[at])
        latent, square = np.array(latent), np.array(square)
        kept = (latent * latent).sum(axis=1)
        good = (kept > 0) & (kept >= KEPT * square)
        latent = np.where(good[:, None], latent / np.where(good, kept, 1)[:, None], 0)
        poor = np.flatnonzero(~good)
        words = [np.array(x, np.int64).view(np.uint64) for x in held.column("words").to_pylist()]
        yield Space(term, weight, (vectors * weight[:, None]).astype(np.float32), np.ascontiguousarray(latent.T, np.float32), words,
                    held.column("item_id").to_numpy(), held.column("part").to_numpy(), float(np.log(1.0 + n)), square, poor,
                    counts_of(term, [words[p] for p in poor]) if len(poor) else None, [np.searchsorted(term, np.unique(x)) for x in words])
        del axes, vectors


def grouped(spaces: Iterator[Space], group_bytes: int) -> Iterator[list[Space]]:
    """Spaces in groups that end with the one that brings their axes to ``group_bytes``; a group is given away before the next is fitted."""
    group, size = [], 0
    for space in spaces:
        group.append(space)
        size += space.axes.nbytes
        del space
        if size >= group_bytes:
            yield group
            group, size = [], 0
    if group:
        yield group


def fewest(size: int, limit: float) -> int:
    """The fewest of ``size`` words whose share reaches ``limit``."""
    return next(c for c in range(size + 1) if c / size >= limit)


def counts_of(terms: np.ndarray, words: list[np.ndarray]) -> Counts:
    at = np.searchsorted(terms, np.concatenate(words))
    passage = np.repeat(np.arange(len(words)), [len(x) for x in words])
    code = np.concatenate([np.where(np.arange(len(x)) >= len(x) - ANSWER_WORDS, 1 + CODE, 1) for x in words])
    pairs, own = np.unique(at * len(words) + passage, return_inverse=True)
    code = np.bincount(own, code).astype(np.float32)
    at, passage = pairs // len(words), pairs % len(words)
    starts = np.searchsorted(at, np.arange(len(terms) + 1))
    many = np.flatnonzero(np.diff(starts) >= MANY)
    column = np.full(len(terms), -1)
    column[many] = np.arange(len(many))
    dense = np.zeros((len(many), len(words)), np.float32)
    often = column[at] >= 0
    dense[column[at[often]], passage[often]] = code[often]
    sizes = [len(x) for x in words]
    return Counts(column, dense, starts, passage, code, np.array([fewest(x, LCS_ALONE) for x in sizes]),
                  np.array([fewest(x, LCS_WITH_ANSWER) for x in sizes]), np.array([fewest(min(x, ANSWER_WORDS), ANSWER) for x in sizes]))


def holders(counts: Counts, half: np.ndarray, term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(window, passage)`` of the stretches that have enough of a passage's words, in any order, to reach the limits.

    ``half`` and ``term`` are the distinct terms of each half, ``row`` the row of each half.
    """
    n, passages = len(row), len(counts.alone)
    column = counts.column[term]
    few = column < 0
    windows, found = [], []
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        a, b = np.searchsorted(half, [lo - BEFORE, hi + AFTER])
        near, which, rare = half[a:b], term[a:b], few[a:b]
        often = np.zeros((hi - lo, len(counts.dense)), np.float32)
        reach = []
        for shift in range(-BEFORE, AFTER + 1):
            window = near - shift
            ok = (window >= lo) & (window < hi)
            ok[ok] = row[window[ok]] == row[near[ok]]
            often[window[ok & ~rare] - lo, column[a:b][ok & ~rare]] = 1
            reach.append((window[ok & rare] - lo) * len(counts.column) + which[ok & rare])
        total = often @ counts.dense
        pairs = np.unique(np.concatenate(reach))
        window, which = pairs // len(counts.column), pairs % len(counts.column)
        sizes = counts.starts[which + 1] - counts.starts[which]
        at = np.repeat(counts.starts[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cells = np.repeat(window, sizes) * passages + counts.passage[at]
        total = total.ravel() + np.bincount(cells, counts.code[at], minlength=total.size)
        total = total.astype(np.int16).reshape(hi - lo, passages)
        k, p = np.nonzero(total % CODE >= counts.with_answer)
        held, answer = total[k, p] % CODE, total[k, p] // CODE
        enough = (held >= counts.alone[p]) | (answer >= counts.answer[p])
        windows.append(k[enough] + lo)
        found.append(p[enough])
    return np.concatenate(windows), np.concatenate(found)


class Windows(NamedTuple):
    """Steps of ``STEP`` words: the row and first word of each, and its distinct known terms as ``step`` and ``term``, in order."""

    row: np.ndarray
    first: np.ndarray
    step: np.ndarray
    term: np.ndarray


def steps_of(space: Space, w: textbuf.Words) -> Windows:
    steps = -(-np.diff(w.bounds) // STEP)
    before = np.concatenate([[0], np.cumsum(steps)])
    row, owner = textbuf.owners(before), textbuf.owners(w.bounds)
    at = lookup(space.terms, w.hashes)
    hit = np.flatnonzero(at >= 0)
    step = before[owner[hit]] + (hit - w.bounds[owner[hit]]) // STEP
    pairs = np.unique(step * max(1, len(space.terms)) + at[hit])
    return Windows(row, (np.arange(len(row)) - before[row]) * STEP, pairs // max(1, len(space.terms)), pairs % max(1, len(space.terms)))


def shares(space: Space, at: Windows) -> np.ndarray:
    """The share of each passage that the window from each step on holds, as the latent space sees it."""
    n = len(at.row)
    each = np.zeros((n, space.axes.shape[1]), np.float32)
    if len(at.step):
        starts = np.flatnonzero(np.append(True, at.step[1:] != at.step[:-1]))
        each[at.step[starts]] = np.add.reduceat(space.axes[at.term], starts, axis=0)
    total = each.copy()
    for ahead in range(1, SPAN):
        same = np.flatnonzero(at.row[ahead:] == at.row[:-ahead]) if n > ahead else np.zeros(0, int)
        total[same] += each[same + ahead]
    return total @ space.latent


def candidates(space: Space, w: textbuf.Words) -> Iterator[tuple[int, int, int, float]]:
    """``(row, first word, passage, share)`` of the windows in which a passage may lie; the best of steps side by side."""
    at = steps_of(space, w)
    if not len(at.row) or not len(space.terms):
        return
    share = shares(space, at)
    if space.counts is not None:
        own = (space.counts.column >= 0) | (np.diff(space.counts.starts) > 0)
        near = np.flatnonzero(own[at.term])
        step, passage = holders(space.counts, at.step[near], at.term[near], at.row)
        share[step, space.poor[passage]] = SHARE
    # A passage shows in some neighbouring windows; one that holds all of it has the most, and equal ones are all looked at.
    padded = np.full((len(share) + 2, share.shape[1]), -1, np.float32)
    padded[1:-1] = share
    apart = np.flatnonzero(at.row[1:] != at.row[:-1]) + 1
    better = padded[1:-1] >= SHARE
    for neighbour, edge in ((padded[:-2], apart), (padded[2:], apart - 1)):
        above = neighbour > padded[1:-1] * 1.02 + 0.02
        above[edge] = False
        better &= ~above
    for step, passage in zip(*np.nonzero(better), strict=True):
        yield int(at.row[step]), int(at.first[step]), int(passage), float(share[step, passage])


def cosine_of(space: Space, passage: int, share: float, words: np.ndarray) -> float:
    """The cosine of a window and a passage of which it holds ``share``; words that no passage has weigh most."""
    at = lookup(space.terms, np.unique(words))
    known = space.idf[at[at >= 0]]
    mass = (known * known).sum() + np.count_nonzero(lookup(space.terms, words) < 0) * space.rare**2
    return float(np.clip(share * np.sqrt(space.square[passage] / mass), 0, 1)) if mass else 0.0


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    best = np.zeros(len(b) + 1, np.int32)
    for x in a:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (b == x)))
    return int(best[-1])


def weight_held(space: Space, k: int, words: np.ndarray) -> float:
    """The share of a passage's weight that a stretch of words holds; 0 if the passage has none."""
    weight = space.idf[space.own[k]] ** 2
    return float(weight[np.isin(space.terms[space.own[k]], words)].sum() / (weight.sum() or 1.0))


def verify(passage: np.ndarray, words: np.ndarray, least: float = LCS_WITH_ANSWER) -> tuple[float, float]:
    """Shares of a passage, and of its answer (its last words), that a stretch of words has in order; 0 below ``least``."""
    # No subsequence is longer than what the passage shares with the stretch in any order.
    if np.isin(passage, words).mean() < least:
        return 0.0, 0.0
    answer = passage[-ANSWER_WORDS:]
    return lcs(passage, words) / len(passage), lcs(answer, words) / len(answer)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``(doc_id, item_id, cosine, lcs_share, answer_share, first_word)``: each document and the items that it holds.

    One row per document and item, for its best stretch; clean documents have none.
    Case and punctuation do not matter.  Null, empty and wordless texts hold nothing, and
    items of that kind are held by nothing.  Rows that repeat give one row; a null id
    stays null.  Without documents or items there are no rows; extra columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("text"))
    found = docs.sparkSession.createDataFrame([], MATCH)
    types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    for group in grouped(fit_spaces(source, benchmark, item_col, item_text_col), group_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(group)
        del group[:]

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, out = batch.column("id").to_pylist(), []
                for chunk in textbuf.chunks(batch.column("text")):
                    w = words_of(chunk)
                    for space in shared.value:
                        for row, first, k, seen in candidates(space, w):
                            own = w.hashes[w.bounds[row] : w.bounds[row + 1]]
                            stretch = own[max(0, first - BEFORE * STEP) : first + (AFTER + 1) * STEP]
                            if np.isin(space.words[k], stretch).mean() < LCS_WITH_ANSWER:
                                continue
                            cosine = cosine_of(space, k, seen, own[first : first + SPAN * STEP])
                            akin = cosine >= COSINE or weight_held(space, k, stretch) >= WEIGHT
                            share, answer = verify(space.words[k], stretch, LCS_WITH_ANSWER if akin else LCS_ALONE)
                            if share >= LCS_ALONE or (akin and share >= LCS_WITH_ANSWER and answer >= ANSWER):
                                out.append((ids[chunk.lo + row], int(space.items[k]), int(space.parts[k]), cosine, share, answer, first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)],
                    ["doc_id", "item_id", "part", "cosine", "lcs_share", "answer_share", "first_word"])

        # Written before the next group is fitted, so that this one can be released.
        found = found.unionByName(cut_lineage(source.mapInArrow(run, MATCH)))
        shared.destroy()
    best = F.max(F.struct("lcs_share", "cosine", "answer_share", -F.col("first_word"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.cosine").alias("cosine"), F.col("best.lcs_share").alias("lcs_share"),
        F.col("best.answer_share").alias("answer_share"), (-F.col("best.col4")).alias("first_word"))
