"""Keyed SipHash-2-4 with 128 bits of output, as a column expression over longs and over whole batches of values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash: its initial state, the rotations of its two half rounds, and the mark before the last rounds.
INITIAL = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
ROTATIONS = ((13, 16), (17, 21))
LAST_MARK = 0xFF
LOW = 0xFFFFFFFF


def _rotate(a: np.ndarray, bits: int) -> np.ndarray:
    return (a << np.uint64(bits)) | (a >> np.uint64(64 - bits))


def _rounds(v: list[np.ndarray], n: int) -> list[np.ndarray]:
    a, b, c, d = v
    (b1, d1), (b2, d2) = ROTATIONS
    for _ in range(n):
        a, c = a + b, c + d
        b, d = _rotate(b, b1) ^ a, _rotate(d, d1) ^ c
        a, c = _rotate(a, 32) + d, c + b
        b, d = _rotate(b, b2) ^ c, _rotate(d, d2) ^ a
        c = _rotate(c, 32)
    return [a, b, c, d]


def _digests(values: list[bytes], blocks: int, key: tuple[int, int]) -> list[str]:
    """Digests of values that all fill ``blocks`` little-endian longs; the last one has the length in its top byte."""
    data = np.frombuffer(b"".join(x.ljust(8 * blocks, b"\0") for x in values), dtype=np.uint8).reshape(len(values), 8 * blocks).copy()
    data[:, -1] = np.array([len(x) % 256 for x in values], dtype=np.uint8)
    longs = data.view("<u8")
    v = [np.full(len(values), start ^ key[k % 2], dtype=np.uint64) for k, start in enumerate(INITIAL)]
    for k in range(blocks):
        block = longs[:, k]
        v[3] = v[3] ^ block
        v = _rounds(v, 2)
        v[0] = v[0] ^ block
    v[2] = v[2] ^ np.uint64(LAST_MARK)
    v = _rounds(v, 4)
    digits = np.stack([v[0] ^ v[1], v[2] ^ v[3]], axis=1).astype("<u8").tobytes().hex().upper()
    return [digits[k:k + 32] for k in range(0, len(digits), 32)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _add_columns(a: Column, b: Column) -> Column:
    """a + b modulo 2^64, by halves, as a plain sum would overflow."""
    low = a.bitwiseAND(F.lit(LOW)) + b.bitwiseAND(F.lit(LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def _rotate_column(a: Column, bits: int | Column) -> Column:
    if isinstance(bits, int):
        return F.shiftleft(a, bits).bitwiseOR(F.shiftrightunsigned(a, 64 - bits))
    return F.call_function("shiftleft", a, bits).bitwiseOR(F.call_function("shiftrightunsigned", a, F.lit(64) - bits))


def _blocks(value: Column) -> Column:
    """Little-endian longs of the value's bytes, the last one with the length in its top byte."""
    data = F.hex(F.encode(value, "UTF-8"))
    n = F.octet_length(value)
    whole = (n / 8).cast("int") * 8
    rest = F.rpad(F.substr(data, whole * 2 + 1), F.lit(14), F.lit("0"))
    padded = F.concat(F.substr(data, F.lit(1), whole * 2), rest, F.lpad(F.hex(n % 256), F.lit(2), F.lit("0")))

    def block(k: Column) -> Column:
        pairs = [F.substr(padded, k * 16 + 2 * j + 1, F.lit(2)) for j in reversed(range(8))]
        return F.conv(F.concat(*pairs), 16, -10).cast("long")

    return F.transform(F.sequence(F.lit(0), (n / 8).cast("int")), block)


def siphash128(value: Column | str, key: tuple[int, int]) -> Column:
    """32 upper-case hex digits: the two halves v0 ^ v1 and v2 ^ v3, each with its low byte first.

    The exclusive or of both halves is the SipHash-2-4 of 64 bits.  ``key`` is two
    unsigned longs.  The state goes through one list of half rounds, in which the
    roles of v0 and v2 change places, so every half round is the same expression.
    """
    text = F.col(value) if isinstance(value, str) else value
    zero = F.lit(0).cast("long")

    def half(kind: int, before: Column = zero, mark: Column = zero, after: Column = zero) -> Column:
        r1, r2 = ROTATIONS[kind]
        return F.struct(
            F.lit(r1).alias("r1"), F.lit(r2).alias("r2"), before.alias("before"), mark.alias("mark"), after.alias("after"))

    def rounds(block: Column) -> Column:
        return F.array(half(0, before=block), half(1), half(0), half(1, after=block))

    last = [half(0, mark=F.lit(LAST_MARK).cast("long")), half(1)] + [half(k % 2) for k in range(6)]
    steps = F.concat(F.flatten(F.transform(_blocks(text), rounds)), F.array(*last))
    start = F.struct(*[F.lit(signed(v ^ key[k % 2])).cast("long").alias(name) for k, (v, name) in enumerate(zip(INITIAL, "pqrs", strict=True))])

    def step(state: Column, now: Column) -> Column:
        p, q = state["p"], state["q"]
        r, s = state["r"].bitwiseXOR(now["mark"]), state["s"].bitwiseXOR(now["before"])
        return F.struct(
            _add_columns(r, s).bitwiseXOR(now["after"]).alias("p"), _rotate_column(q, now["r1"]).bitwiseXOR(_add_columns(p, q)).alias("q"),
            _rotate_column(_add_columns(p, q), 32).alias("r"), _rotate_column(s, now["r2"]).bitwiseXOR(_add_columns(r, s)).alias("s"))

    def low_first(a: Column) -> Column:
        digits = F.lpad(F.hex(a), F.lit(16), F.lit("0"))
        return F.concat(*[F.substring(digits, 15 - 2 * j, 2) for j in range(8)])

    return F.reduce(steps, start, step, lambda v: F.concat(
        low_first(v["p"].bitwiseXOR(v["q"])), low_first(v["r"].bitwiseXOR(v["s"]))))


def siphash128_batched(value: Column | str, key: tuple[int, int]) -> Column:
    """``siphash128`` in Arrow batches, faster over many rows; values with the same number of blocks are hashed together."""
    @F.pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        out = np.full(len(values), None, dtype=object)
        rows = [(k, bytes(x)) for k, x in enumerate(values) if x is not None]
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for k, x in rows:
            groups.setdefault(len(x) // 8 + 1, []).append((k, x))
        for blocks, members in groups.items():
            out[[k for k, _ in members]] = _digests([x for _, x in members], blocks, key)
        return pd.Series(out)

    text = F.col(value) if isinstance(value, str) else value
    return hashed(F.encode(text, "UTF-8"))
