"""Pairs of close vectors among short whole-number codes, each pair found once and none missed.

A unit vector is turned by random signs and a Hadamard transform, which spreads
it evenly over its components, and rounded to one signed byte a component.  What
the rounding moved is kept beside it, so distances of codes bound those of vectors.

Two codes at a squared distance of at most ``limit`` have at most an equal share of
it in one of their parts of ``WIDTH`` components.  Within a part, codes are divided
at medians into boxes, and a box meets the codes within that distance of it.  All
sums are of whole numbers that single precision holds exactly, so a pair that
several parts hold is left to the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 16
LEAF = 512
#: Rows that tell the component at which a box is cut.
SOME = 4096
#: Pairs of codes that are compared at once.
TILE = 1 << 18
#: Sets with at most this many pairs are compared whole.
FEW = 1 << 18
#: Components beyond this many times their usual size are cut off, which counts as rounding.
SPREAD = 4.5
#: The largest difference of two codes in one component.
MOST = 254


def code_width(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def code_step(width: int) -> float:
    return min(1.0, SPREAD / np.sqrt(width)) / 127


def usual_error(width: int) -> float:
    """What rounding moves a vector at most, but for a few in a million and those that are cut off."""
    return code_step(width) * np.sqrt(min(width / 4, width / 12 + 4.5 * np.sqrt(width / 180)))


def codes_of(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of unit vectors, as signed bytes, and an upper bound of the distance of each to its vector."""
    n, dim = units.shape
    width = code_width(dim)
    turned = np.zeros((n, width))
    turned[:, :dim] = units * np.random.default_rng(dim).choice([-1.0, 1.0], dim)
    half = 1
    while half < width:
        pairs = turned.reshape(n, -1, 2, half)
        turned = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    turned /= np.sqrt(width) * code_step(width)
    codes = np.clip(np.rint(turned), -127, 127)
    moved = np.sqrt(np.square(turned - codes).sum(axis=1)) * code_step(width)
    return codes.astype(np.int8), (moved + 1e-6).astype(np.float32)


def _sides(x: np.ndarray, y: np.ndarray, exact: type) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products are squared distances of those of ``x`` and ``y``."""
    width = x.shape[1]
    left, right = np.ones((len(x), width + 2), exact), np.ones((len(y), width + 2), exact)
    left[:, :width], right[:, :width] = x, y
    left[:, width] = np.einsum("ij,ij->i", left[:, :width], left[:, :width])
    right[:, width + 1] = np.einsum("ij,ij->i", right[:, :width], right[:, :width])
    left[:, :width] *= -2
    return left, right


def _tiles(x: np.ndarray, y: np.ndarray, limit: float, exact: type = np.float32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``x`` and ``y`` within ``limit``, a tile at a time."""
    left, right = _sides(x, y, exact)
    high = min(len(left), LEAF)
    wide = min(len(right), max(1, TILE // high))
    far, near = np.empty(high * wide, exact), np.empty(high * wide, bool)
    for at in range(0, len(right), wide):
        facing = right[at : at + wide].T
        for up in range(0, len(left), high):
            rows = left[up : up + high]
            size = len(rows) * facing.shape[1]
            np.matmul(rows, facing, out=far[:size].reshape(len(rows), -1))
            np.less_equal(far[:size], limit, out=near[:size])
            hits = np.flatnonzero(near[:size])
            if len(hits):
                h, g = np.divmod(hits, facing.shape[1])
                yield h + up, g + at


def _part_pairs(x: np.ndarray, y: np.ndarray | None, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one part within ``limit``; without ``y``, of two rows of ``x``."""
    alone = y is None
    y = x if alone else y
    columns = np.ascontiguousarray(y.T)
    every = lambda rows: np.arange(len(rows), dtype=np.int32)
    met = every(y[:0] if alone else y)
    open_ = [-float(MOST)] * x.shape[1], [float(MOST)] * x.shape[1]
    # Rows of a box, the rows that it meets, their squared distances from it, and its bounds.
    todo = [(every(x), met, np.zeros(len(met), np.float32), *open_)]
    while todo:
        own, met, far, low, high = todo.pop()
        if not len(own) or not len(met) and not (alone and len(own) > 1):
            continue
        rows = x[own]
        # Any component may be cut; the widest among some rows cuts best.
        d = int(rows[:: 1 + len(own) // SOME].astype(np.float32).var(axis=0).argmax()) if len(own) > LEAF else 0
        values = rows[:, d]
        if len(own) <= LEAF or values.min() == values.max():
            for h, g in _tiles(rows, y[met], limit) if len(met) else ():
                yield own[h], met[g]
            for h, g in _tiles(rows, rows, limit) if alone else ():
                first = h < g
                yield own[h[first]], own[g[first]]
            continue
        cut = int(np.partition(values, len(values) // 2)[len(values) // 2])
        cut -= int(cut == values.max())  # Rows up to the cut go left.
        left = values <= cut
        seen = columns[d][met].astype(np.float32)
        beyond = lambda v, lo, hi: np.square(np.maximum(0, np.maximum(lo - v, v - hi)))
        base = far - beyond(seen, low[d], high[d])
        for side, (lo, hi) in enumerate([(low[d], float(cut)), (cut + 1.0, high[d])]):
            at = base + beyond(seen, lo, hi)
            near = at <= limit
            sent, away = met[near], at[near]
            if alone and side:  # Rows left of the cut meet the right box; those right of it need not meet the left one.
                gap = beyond(values[left].astype(np.float32), lo, hi)
                sent, away = np.concatenate([sent, own[left][gap <= limit]]), np.concatenate([away, gap[gap <= limit]])
            lows, highs = [*low], [*high]
            lows[d], highs[d] = lo, hi
            todo.append((own[~left] if side else own[left], sent, away, lows, highs))


def close_pairs(x: np.ndarray, y: np.ndarray | None, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(rows of x, rows of y, squared distances, candidates)`` of all codes within ``limit``, each pair once.

    Without ``y``, pairs of two rows of ``x``.  ``candidates`` is how many pairs were looked at for these.
    """
    others, width = x if y is None else y, x.shape[1]
    few = len(x) * len(others) <= FEW
    part = width if few else min(WIDTH, width)
    limit = int(limit)
    share = limit // (width // part)
    for first in range(0, width, part):
        cut = slice(first, first + part)
        own = np.ascontiguousarray(x[:, cut])
        if not few:
            found = _part_pairs(own, None if y is None else np.ascontiguousarray(y[:, cut]), share)
        else:
            found = _tiles(own, others[:, cut], share, np.float32 if width * MOST**2 < 1 << 24 else np.float64)
        for h, g in found:
            for at in range(0, len(h), 1 << 16):
                p, q = h[at : at + (1 << 16)], g[at : at + (1 << 16)]
                if few and y is None:
                    p, q = p[p < q], q[p < q]
                gaps = np.square(x[p].astype(np.int32) - others[q]).reshape(len(p), width // part, part).sum(axis=2)
                total = gaps.sum(axis=1)
                kept = (total <= limit) & (gaps[:, : first // part] > share).all(axis=1)
                yield p[kept], q[kept], total[kept], len(p)


def within(
    x: np.ndarray, moved: np.ndarray, y: np.ndarray | None, others: np.ndarray | None, radius: float,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(rows of x, rows of y, sure, candidates)`` of all vectors at a distance of at most ``radius``, each pair once.

    ``moved`` and ``others`` are what rounding has moved the rows of ``x`` and ``y``.  Pairs that are
    not ``sure`` may be a little farther apart.  Few vectors are moved more than usual; each of them is compared with all.
    """
    step, usual = code_step(x.shape[1]), usual_error(x.shape[1]) + 2e-6
    other, slack = (x, moved) if y is None else (y, others)
    odd, odd_other = moved > usual, slack > usual

    def told(h: np.ndarray, g: np.ndarray, total: np.ndarray, looked: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        far, either = np.sqrt(total) * step, moved[h].astype(np.float64) + slack[g]
        near = far - either <= radius
        return h[near], g[near], (far + either <= radius - 1e-6)[near], looked

    for h, g, total, looked in close_pairs(x, y, ((radius + 2 * usual) / step) ** 2):
        plain = ~(odd[h] | odd_other[g])
        yield told(h[plain], g[plain], total[plain], looked)
    exact = np.float32 if x.shape[1] * MOST**2 < 1 << 24 else np.float64
    for mine, against, turned in ((odd, np.ones(len(other), bool), False), *([] if y is None else [(odd_other, ~odd, True)])):
        rows, facing = np.flatnonzero(mine), np.flatnonzero(against)
        if not len(rows) or not len(facing):
            continue
        a, b = (other, x) if turned else (x, other)
        limit = int(((radius + (slack if turned else moved)[rows].max() + (moved if turned else slack)[facing].max()) / step) ** 2)
        for p, q in _tiles(a[rows], b[facing], limit, exact):
            h, g = rows[p], facing[q]
            if y is None:  # Of two odd rows, the first meets the second.
                once = (h < g) | (h != g) & ~odd[g]
                h, g = h[once], g[once]
            total = np.square(a[h].astype(np.int32) - b[g]).sum(axis=1)
            yield told(*((g, h) if turned else (h, g)), total, len(p))
