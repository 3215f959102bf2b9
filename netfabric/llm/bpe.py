"""Byte-level BPE with two tiers.

A text is split into pre-tokens by a pattern.  Pre-tokens that are in the
vocabulary as a whole, found by a minimal perfect hash over all distinct ones of
a block at once, are one id.  The others are merged byte by byte: the bytes are a
linked list, and a heap gives the neighbours of lowest rank next, so a pre-token
of n bytes takes n log n steps.  Ids are packed as little-endian unsigned 32-bit
integers, the form in which training data is mapped into memory.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netfabric.llm import textbuf

#: Pre-tokens that are looked up at once; a longer text is read in several blocks.
BLOCK = 1 << 18
#: Merged pre-tokens that a worker remembers; at this number it starts anew.
REMEMBERED = 1 << 18
#: Keys of the perfect hash that share a displacement, on average.
BUCKET = 4
#: A character that is neither a letter, a number nor a space in any version of Unicode.
PRIVATE = "\ue000"


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after another."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)


def byte_spans(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(data, starts, ends)`` of a string or binary column without nulls."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8), offsets[:-1], offsets[1:]


class PerfectHash:
    """Every key of a fixed set to a number of its own below their count, in one probe.

    Keys are dealt into buckets; a displacement per bucket sends its keys to free
    slots.  Buckets of one key come last and name their slot.  ``find`` compares the
    bytes, so no other key is taken for one of the set.
    """

    def __init__(self, keys: list[bytes]) -> None:
        packed = pa.array(keys, pa.binary())
        self.data, self.starts, self.ends = (x.copy() for x in byte_spans(packed)) if keys else (np.zeros(0, np.uint8), *np.zeros((2, 0), np.int64))
        self.size, self.seed = len(keys), 0
        self.shifts = np.zeros(max(1, self.size // BUCKET), np.int64)
        hashes = textbuf.hash_spans(self.data, self.starts, self.ends, self.seed)
        while len(np.unique(hashes)) < self.size:
            self.seed += 1
            hashes = textbuf.hash_spans(self.data, self.starts, self.ends, self.seed)
        slots = self._place(hashes)
        self.key_at = np.empty(self.size, np.int64)
        self.key_at[slots] = np.arange(self.size)

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes % np.uint64(len(self.shifts))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(len(self.shifts) + 1))
        counts = np.diff(bounds)
        taken, slots = np.zeros(self.size, bool), np.empty(self.size, np.int64)
        for b in np.argsort(-counts, kind="stable"):
            own = order[bounds[b] : bounds[b + 1]]
            if len(own) < 2:
                break
            shift = 0
            while True:
                tries = self._slot(hashes[own][None], np.arange(shift, shift + 64)[:, None])
                ranked = np.sort(tries, axis=1)
                fits = ~taken[tries].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(fits.argmax())
                    break
                shift += 64
            self.shifts[b], slots[own], taken[tries[k]] = shift + k, tries[k], True
        single = np.flatnonzero(counts == 1)
        free = np.flatnonzero(~taken)
        self.shifts[single] = -1 - free
        slots[order[bounds[single]]] = free
        return slots

    def _slot(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        moved = textbuf.mix(hashes + shift.astype(np.uint64) * np.uint64(textbuf.BASE)) % np.uint64(max(1, self.size))
        return np.where(shift < 0, -1 - shift, moved.astype(np.int64))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span among the keys, in their order, or -1."""
        found = np.full(len(starts), -1, np.int64)
        if not self.size or not len(starts):
            return found
        hashes = textbuf.hash_spans(data, starts, ends, self.seed)
        key = self.key_at[self._slot(hashes, self.shifts[(hashes % np.uint64(len(self.shifts))).astype(np.int64)])]
        size = ends - starts
        at = np.flatnonzero((size == self.ends[key] - self.starts[key]) & (size > 0))
        same = data[spread(starts[at], size[at])] == self.data[spread(self.starts[key[at]], size[at])]
        equal = np.logical_and.reduceat(same, np.cumsum(size[at]) - size[at]) if len(at) else same
        found[at[equal]] = key[at[equal]]
        return found


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the neighbours of lowest rank merge, the leftmost first, until none has a rank."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        right = after[i]
        # A part that was swallowed has no end; a pair that has grown or shrunk since is not this pair.
        if not right or right >= n or after[right] != end:
            continue
        after[i], after[right] = end, 0
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        if i and (r := ranks.get(piece[before[i] : end])) is not None:
            heappush(heap, (r, before[i], end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def unknown_to(classes: str) -> str:
    """Members of letter and number classes in ``regex`` that the tokenizer library's older Unicode tables do not have, as a ``re`` set.

    The two libraries follow different versions of Unicode; what the pattern calls a
    letter is what the tokenizer library calls one.
    """
    import tiktoken

    own = "".join(regex.findall(classes, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))))
    probe = tiktoken.Encoding("classes", pat_str=classes, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
    known = set(probe.decode(probe.encode_ordinary(own)))
    points = np.array([ord(c) for c in own if c not in known], np.int64)
    runs = np.split(points, np.flatnonzero(np.diff(points) != 1) + 1) if len(points) else []
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


class Vocabulary:
    """Tokens with their ids, and the pattern of the pre-tokens.  Every single byte has to be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"vocabulary lacks single bytes, {missing[0]} first")
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = np.array([ranks[t] for t in self.tokens], np.uint32)
        self.whole = PerfectHash(self.tokens)
        self.by_id = np.zeros(int(self.ids.max()) + 1, np.int64)
        self.by_id[self.ids] = np.arange(len(self.ids))
        self.pattern, self.newer = pattern, unknown_to(r"[\p{L}\p{N}]")
        self._tools = None

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A rank file: one token in base64 and its id per line.  Read on the driver; its size is fixed."""
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    @property
    def tools(self) -> tuple:
        """What a worker makes for itself once: split pattern, newer characters, ranks and merged pre-tokens."""
        if self._tools is None:
            newer = re.compile(f"[{self.newer}]") if self.newer else None
            self._tools = regex.compile(self.pattern), newer, dict(zip(self.tokens, self.ids.tolist(), strict=True)), {}
        return self._tools

    def split(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in lists of at most ``BLOCK``."""
        pattern, newer, *_ = self.tools
        if newer is not None and not text.isascii() and newer.search(text):
            spans = (m.span() for m in pattern.finditer(newer.sub(PRIVATE, text)))
            while block := [text[a:b] for a, b in islice(spans, BLOCK)]:
                yield block
        elif len(text) <= BLOCK:
            yield pattern.findall(text)
        else:
            found = pattern.finditer(text)
            while block := [m.group() for m in islice(found, BLOCK)]:
                yield block

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens, and the number of ids of each."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        data, starts, ends = byte_spans(distinct)
        key = self.whole.find(data, starts, ends)
        ranks, seen = self.tools[2:]
        ids, sizes = self.ids[key], np.ones(len(key), np.int64)
        misses, merged = np.flatnonzero(key < 0), []
        body = data.tobytes()
        for a, b in zip(starts[misses].tolist(), ends[misses].tolist(), strict=True):
            piece = body[a:b]
            if (own := seen.get(piece)) is None:
                own = merge(piece, ranks)
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[piece] = own
            merged.append(own)
        sizes[misses] = [len(own) for own in merged]
        bounds = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.uint32)
        whole = np.flatnonzero(key >= 0)
        flat[bounds[whole]] = ids[whole]
        flat[spread(bounds[misses], sizes[misses])] = [k for own in merged for k in own]
        return flat[spread(bounds[code], sizes[code])], sizes[code]

    def encode(self, texts: pa.Array) -> pa.Array:
        """The packed ids of each text; null is empty."""
        counts, parts = np.zeros(len(texts), np.int64), []
        pieces: list[str] = []
        rows: list[tuple[int, int]] = []

        def flush() -> None:
            ids, sizes = self._encode(pieces)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([n for _, n in rows])])]
            np.add.at(counts, [i for i, _ in rows], np.diff(ends))
            parts.append(ids)
            pieces.clear()
            rows.clear()

        for i, text in enumerate(texts):
            for block in self.split(text.as_py() or ""):
                pieces += block
                rows.append((i, len(block)))
                if len(pieces) >= BLOCK:
                    flush()
        if rows:
            flush()
        body = np.concatenate([*parts, np.zeros(0, np.uint32)]).astype("<u4").tobytes()
        return packed(counts * 4, body)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each row of packed ids; null is empty."""
        data, starts, ends = byte_spans(ids.fill_null(b"") if ids.null_count else ids)
        own = data[starts[0] : ends[-1]].view("<u4") if len(ids) else data
        edges, done, parts = np.concatenate([[0], np.cumsum(ends - starts)]) // 4, 0, []
        at = np.zeros(len(edges), np.int64)
        for lo in range(0, len(own), BLOCK):
            key = self.by_id[own[lo : lo + BLOCK]]
            sizes = self.whole.ends[key] - self.whole.starts[key]
            parts.append(self.whole.data[spread(self.whole.starts[key], sizes)].tobytes())
            here = (edges > lo) & (edges <= lo + BLOCK)
            sums = np.cumsum(sizes)
            at[here] = done + sums[edges[here] - lo - 1]
            done += int(sums[-1])
        return packed(np.diff(np.maximum.accumulate(at)), b"".join(parts))


def packed(sizes: np.ndarray, body: bytes) -> pa.Array:
    """A binary column of values of ``sizes`` that lie one after another in ``body``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch has over 2 GB of values; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])


def coder(spark: SparkSession, vocabulary: Vocabulary):
    """Column functions: text to packed ids, packed ids to bytes, and text to both.  The vocabulary is sent to each executor once."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return shared.value.encode(texts)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return shared.value.decode(ids)

    @F.arrow_udf("ids binary, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        ids = shared.value.encode(texts)
        return pa.StructArray.from_arrays([ids, shared.value.decode(ids)], ["ids", "decoded"])

    return encode, decode, both


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary, text: Column) -> DataFrame:
    """``docs`` with a ``_coded`` column of ``ids`` (packed ids of the whole text) and ``decoded`` (the bytes they stand for).

    A null or empty text has no ids and decodes to nothing.  Special tokens in a text
    are ordinary text.  Characters that the pattern does not match, if it leaves any,
    have no ids.  Rows are independent: repeats, null ids and ties change nothing, an
    empty table gives no rows, and the columns of ``docs`` stay, whatever their names.
    A text takes memory in proportion to its length, its pre-tokens only a block at a time.
    """
    # One function for both: of a chain of two, Spark would run the first one twice.
    return docs.withColumn("_coded", coder(docs.sparkSession, vocabulary)[2](text))
