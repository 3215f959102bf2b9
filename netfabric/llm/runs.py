"""Periodic runs of words, found as maximal pairs in the LCP-interval tree of each text.

A run of period q and length L is the pair of equal stretches of L - q words that
start q words apart, and neither end of which can be extended: a maximal pair.
So no run is extended word by word.  Suffixes are sorted by prefix doubling, all
texts of a block at once, and dropped as soon as nothing in their own text shares
their first words.  Those that share enough for a run form LCP intervals, which are
merged from the leaves up, the smaller into the larger.  Each interval keeps its
starts sorted, with the class of each, its left word: only members of different
classes are left-maximal, only members of different children right-maximal.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.llm import textbuf
from netfabric.llm.bpe import spread

MIN_LENGTH = 24
MIN_EXPONENT = 3
RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    body = data[spread(starts, sizes)].tobytes()
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def sort_suffixes(codes: np.ndarray, row: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Ranks of all suffixes, and for each width 1, 2, 4 ... the starts that share their first words, with the group of each.

    ``last`` is the end of each start's row.  Suffixes of different rows never share a
    group; a suffix alone in its group is in its place and is not sorted again.
    """
    n = len(codes)
    rank = np.empty(n, np.int64)
    live, width, levels = np.arange(n), 0, []
    key, base = row * (int(codes.max(initial=0)) + 1) + codes, np.zeros(n, np.int64)
    while len(live):
        order = np.lexsort((key, base)) if width else np.argsort(key, kind="stable")
        live, key, base = live[order], key[order], base[order]
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (base[1:] != base[:-1])
        # A group's rank is that of its first member: its base, and how many of the base come before it.
        outer = np.ones(len(live), bool)
        outer[1:] = base[1:] != base[:-1]
        at = np.arange(len(live))
        head = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(outer, at, 0))
        rank[live] = base + head
        more = np.append(new[1:], True)
        shared = ~(new & more)
        live = live[shared]
        width = width * 2 or 1
        if len(live):
            levels.append((width, live, rank[live]))
        ahead = live + width
        inside = ahead < last[live]
        key = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        base = rank[live]
    return rank, levels


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Words that the suffixes ``a`` and ``b``, pair by pair, have in common."""
    shared = np.zeros(len(a), np.int64)
    group = np.empty(n + 1, np.int64)
    for width, live, own in reversed(levels):
        group[:] = -1
        group[live] = own
        left = group[np.minimum(a + shared, n)]
        equal = (left >= 0) & (left == group[np.minimum(b + shared, n)])
        shared[equal] += width
    return shared


def maximal_pairs(starts: list[int], lcp: list[int], left: list[int], share: int) -> Iterator[tuple[int, int, int]]:
    """``(start, common, distance)`` of maximal pairs at most ``common / share`` apart.

    ``starts`` are sorted suffixes and ``lcp[k]`` what number k and k + 1 have in common.
    Within that distance a start has at most one partner on either side in the other
    child: of two, the nearer would have more in common with it.  So each start of the
    smaller child asks for its two neighbours in the larger only.  That needs ``share >= 2``.
    """
    stack: list[tuple[int, list[int]]] = []

    def join(common: int, a: list[int], b: list[int]) -> Iterator[tuple[int, int, int]]:
        """Merge two children of an interval into the larger list."""
        most = common // share
        small, large = (a, b) if len(a) < len(b) else (b, a)
        for x in small:
            k = bisect_left(large, x)
            if k < len(large) and large[k] - x <= most and left[large[k]] != left[x]:
                yield x, common, large[k] - x
            if k and x - large[k - 1] <= most and left[large[k - 1]] != left[x]:
                yield large[k - 1], common, x - large[k - 1]
        if len(small) == 1:
            large.insert(bisect_left(large, small[0]), small[0])
        else:
            large += small
            large.sort()

    for start, common in zip(starts, [*lcp, 0], strict=True):
        # An open interval is on the stack with what its members share with the next one.
        own = [start]
        while stack and stack[-1][0] >= common:
            depth, before = stack.pop()
            yield from join(depth, before, own)
            own = before if len(before) > len(own) else own
        if common:
            stack.append((common, own))


def find_in(codes: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """``(row, start, length, period)`` of all runs, in that order; a start counts from its row's first word."""
    n = len(codes)
    row, last = textbuf.owners(bounds), np.repeat(bounds[1:], np.diff(bounds))
    rank, levels = sort_suffixes(codes, row, last)
    # What the two stretches of the shortest run have in common.
    least = min_length - min_length // min_exponent
    wide = [live for width, live, _ in levels if width <= least]
    if not wide or levels[-1][0] * 2 <= least:
        return np.zeros((0, 4), np.int64)
    order = wide[-1][np.argsort(rank[wide[-1]], kind="stable")]
    lcp = common_prefixes(order[:-1], order[1:], levels, n)
    lcp[(lcp < least) | (row[order[:-1]] != row[order[1:]])] = 0
    used = np.append(lcp > 0, False) | np.append(False, lcp > 0)
    order, lcp = order[used], np.append(lcp, 0)[used][:-1]
    first = bounds[row[order]]
    left = dict(zip(order.tolist(), np.where(order > first, codes[order - 1], -1).tolist(), strict=True))
    pairs = np.array(list(maximal_pairs(order.tolist(), lcp.tolist(), left, min_exponent - 1)), np.int64).reshape(-1, 3)
    start, length, period = pairs[:, 0], pairs[:, 1] + pairs[:, 2], pairs[:, 2]
    enough = length >= min_length
    found = np.stack([row[start], start - bounds[row[start]], length, period], axis=1)[enough]
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    # A run is also found at multiples of its period, with the same two ends.
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def collapse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words outside repeats, joined by one blank: bytes, and the size of each row."""
    n, row = len(starts), textbuf.owners(bounds)
    depth = np.zeros(n + 1, np.int64)
    at = bounds[found[:, 0]] + found[:, 1]
    np.add.at(depth, at + found[:, 3], 1)
    np.add.at(depth, at + found[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(depth)[:n] == 0)
    sizes = ends[kept] - starts[kept]
    room = sizes + np.append(row[kept][1:] == row[kept][:-1], [False] * min(1, len(kept)))
    out = np.full(int(room.sum()), 0x20, np.uint8)
    out[spread(np.cumsum(room) - room, sizes)] = data[spread(starts[kept], sizes)]
    return out, np.bincount(row[kept], weights=room, minlength=len(bounds) - 1).astype(np.int64)


def runs_of(texts: pa.Array, min_length: int, min_exponent: int) -> pa.StructArray:
    runs, counts, body, sizes = [np.zeros((0, 4), np.int64)], [], [], []
    for chunk in textbuf.chunks(texts, textbuf.CHUNK_BYTES * 4):
        full = ~textbuf.SPACE[chunk.data]
        starts, ends, bounds = textbuf.word_spans(full, chunk.offsets)
        found = find_in(word_codes(chunk.data, starts, ends), bounds, min_length, min_exponent)
        out, size = collapse(chunk.data, starts, ends, bounds, found)
        runs.append(found)
        counts.append(np.bincount(found[:, 0], minlength=chunk.hi - chunk.lo))
        body.append(out.tobytes())
        sizes.append(size)
    empty = [np.zeros(1, np.int64)]
    every = np.concatenate(runs)
    bounds, offsets = (np.cumsum(np.concatenate(empty + x)) for x in (counts, sizes))
    spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, k])) for k in (1, 2, 3)], ["start", "length", "period"])
    text = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(b"".join(body))])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans), text], ["runs", "collapsed"])


def find_runs(docs: DataFrame, text: Column, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with a ``_found`` column of ``(runs, collapsed)``.

    Words are what ASCII white space leaves, numbered from 0 and compared byte by byte.
    A run is a stretch of at least ``min_length`` words and ``min_exponent`` (3 or more)
    smallest periods that cannot be extended; ``runs`` has ``(start, length, period)`` by
    start, then period.  ``collapsed`` is the text with only the first period of each run,
    joined by one blank.  A null, empty or wordless text has no runs and collapses to an
    empty one.  Rows are independent, so repeats, ties and null ids change nothing; an
    empty table gives no rows; columns of ``docs`` stay, whatever their names.  A text is
    handled whole, in memory in proportion to its words.
    """
    if min_exponent < 3 or min_length < min_exponent:
        raise ValueError("a run needs three periods at least, and a word for each")

    @F.arrow_udf(RUNS)
    def find(texts: pa.Array) -> pa.Array:
        return runs_of(texts, min_length, min_exponent)

    return docs.withColumn("_found", find(text))


def repeat_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a tenth of its texts made periodic from some word on, by a hash of the id.

    With h the CRC-32 of the id as text and g = h div 10: if h ends in 0, each word i
    from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    blank = r"[\x20\x09-\x0D]+"
    chosen = docs.withColumn("_h", h).withColumn(
        "_words", F.when(F.col("_h") % 10 == 0, F.filter(F.split(text_col, blank), lambda w: w != "")))
    g, n = F.expr("_h div 10"), F.size("_words")
    placed = chosen.withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, (g % F.col("_n")).cast("int")))
    placed = placed.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + (_h div 10) % 8) as int)"))
    order = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda i: F.get("_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    made = F.when(F.col("_n") > 0, F.concat_ws(" ", order)).otherwise(F.col(text_col))
    return placed.withColumn(text_col, made).drop("_h", "_words", "_n", "_a", "_p")


#: The same over whole tables in SQL: equal words at each distance, and stretches of them.
RUNS_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b:
      list_reduce(list_concat([xor(c, b)], range(8)), lambda d, k: xor(d >> 1, (d & 1) * 3988292384))), 4294967295) AS h
  FROM documents
), shape AS (
  SELECT doc_id, ws, h, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM doc
), word AS (
  SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[1 + a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8))] ELSE ws[1 + i] END AS w
  FROM (SELECT doc_id, ws, h, n, a, unnest(range(n)) AS i FROM shape)
), same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS s, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
  FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i
  JOIN shape d ON d.doc_id = x.doc_id AND 3 * (y.i - x.i) <= d.n
), stretch AS (
  SELECT doc_id, min(s) AS start, count(*) + q AS length, q AS period FROM same GROUP BY doc_id, q, island
), run AS (
  SELECT doc_id, start, length, min(period) AS period FROM stretch WHERE length >= 24 AND length >= 3 * period GROUP BY doc_id, start, length
), best AS (
  SELECT doc_id, start, length, period FROM run
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1
), drops AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT w.doc_id, string_agg(w, ' ' ORDER BY w.i) AS text FROM word w ANTI JOIN drops d ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY doc_id
)
SELECT d.doc_id, COALESCE(l.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(COALESCE(l.runs, '')) AS runs_sha256, sha256(COALESCE(k.text, '')) AS collapsed_sha256
FROM doc d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
