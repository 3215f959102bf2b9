"""Words and hashes of a whole Arrow column at once, in numpy.

A column's UTF-8 buffer is cut into chunks of whole rows; within a chunk, words
are found by a byte mask and hashed eight bytes at a time, all words at once, so
no Python code runs per row or per word (but for words of over 64 bytes).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Small enough that the arrays of a chunk stay in the cache, and many workers in memory.
CHUNK_BYTES = 1 << 18
#: Odd, and so invertible modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Longer spans are hashed one by one.
LONG_SPAN = 64
#: The bytes that count of a block with so many left.
TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: The bytes between words, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Chunk(NamedTuple):
    """Rows ``lo`` to ``hi``, their bytes, and where each row starts and ends in those."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Start, end and hash of each word, and the words before each row."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES * 2
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[:n], down[:n]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A string column in chunks of about ``limit`` bytes; a longer row is a chunk of its own.  Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def running_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial sums such that ``gram_hash`` gives the hash of any short span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=sums[1:])
    return sums


def gram_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of a few bytes (n-grams); for longer ones, strings that clash can be built: use ``hash_spans``."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of bytes, whatever surrounds them.

    Spans are read eight bytes at a time, all spans at once, each block mixed into
    the state before the next; spans over ``LONG_SPAN`` bytes take a keyed BLAKE2b instead.
    """
    size = ends - starts
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    blocks = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))
    h = mix((size.astype(np.uint64) + np.uint64(seed)) * np.uint64(BASE))
    live, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        left = size[live] - at
        block = blocks[starts[live] + at] & TAIL[np.minimum(left, 8)]
        h[live] = mix(h[live] * np.uint64(BASE) ^ block)
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG_SPAN):
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return h


def key_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of 128 bits, as two columns of integers: keys that can stand for their spans."""
    held = data.tobytes()
    made = b"".join(blake2b(held[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def word_spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of ``solid`` bytes, never across rows, and the runs before each row."""
    n = len(solid)
    full = np.zeros(n + 2, bool)
    full[1:-1] = solid
    first = full[1:-1] & ~full[:-2]
    last = full[1:-1] & ~full[2:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] |= full[1:-1][edges]
    last[edges - 1] |= full[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Words of each row: runs of bytes that are not in ``space``, never across rows."""
    starts, ends, bounds = word_spans(~space[data], offsets)
    return Words(starts, ends, hash_spans(data, starts, ends), bounds)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the items before each row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
