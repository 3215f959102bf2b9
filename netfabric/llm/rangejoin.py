"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least c is a Euclidean distance of at most
r = sqrt(2 - 2c).  Vectors are short codes with a bound of what rounding moved
(``closepairs``), and only codes travel.  The codes of a label are dealt into large
blocks; a task holds a block and meets others one after another, so that each pair
of blocks meets once and a code is written about half as often as there are blocks.
Pairs that the codes leave open are decided by the vectors themselves.

A label with so many close pairs that whole vectors are cheaper is dense and goes
another way.  Pivots divide the vectors of a dense label into cells of nearest
pivots.  By the triangle inequality a vector x of cell p can have a partner in
cell q only if d(x, q) - d(x, p) <= 2r and d(x, q) <= r + the radius of q; the
first is used in its sharper form for Euclidean space, the distance of x to the
plane between p and q.  x is copied to those cells, and the cells join each on
their own.  A cell that is still large gets pivots of its own; one that pivots
do not divide is joined in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfabric.functions.skew import with_rank
from netfabric.llm.closepairs import codes_of, within
from netfabric.llm.components import connected_components
from netfabric.llm.groups import sorted_groups
from netfabric.session import cut_lineage

CELL_ROWS = 2000
PIVOTS = 48
#: Vectors of a block of a dense label.
VECTOR_BYTES = 16 << 20
CHUNK_ROWS = 10_000
LEVELS = 4
#: Cells are divided again only if that leaves at most this share of the rows' pairs.
WORTH = 0.7
#: Codes of a block, which a task holds, and blocks that a task meets one after another.
BLOCK_BYTES = 48 << 20
MET_BLOCKS = 4
#: Labels of up to this many points are one block, however long their codes are.
ONE_BLOCK = 64
#: A label is dense if more pairs a row than this are left open, or more than both limits are looked at.
OPEN_PAIRS, LOOKED_PAIRS, LOOKED_SHARE = 8, 200, 0.04
#: The bits of a digest by which the filter of names goes.
NAMES = (1 << 24) - 1
POINT = "cell long, home boolean, id long, n long, vector binary"


def unit_vectors(vectors: DataFrame, form: str = "", names: np.ndarray | None = None) -> DataFrame:
    """``(id, cell, hi, lo)``: the label and length of the rows that can link, and a digest of their unit vectors.

    A null, zero or non-finite vector, one with a null component, and one without a label have a null cell.
    With ``form``, only rows that can link, with their unit ``vector`` in double precision or its ``code``;
    with ``names``, a filter of digests, none that it refuses.
    """
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), *[(form, pa.binary())] * bool(form)])

    asked = lambda digest: names[(digest & NAMES) >> 3] >> (digest & 7) & 1 > 0

    def units_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of one length, some at a time, and their unit vectors."""
        ends = column.offsets.to_numpy()
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
        parts = column.values.to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            some = np.flatnonzero(sizes == dim)
            for at in np.array_split(some, -(-len(some) * dim // (1 << 18))):
                a = parts[ends[at][:, None] + np.arange(dim)].astype(np.float64)
                # Scaled first, so that huge or tiny components neither overflow nor vanish.
                top = np.abs(a).max(axis=1)
                good = np.isfinite(top) & (top > 0)
                a = a[good] / top[good][:, None]
                yield at[good], a / np.sqrt((a * a).sum(axis=1))[:, None] + 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, dims = np.zeros((batch.num_rows, 2), np.int64), np.zeros(batch.num_rows, np.int32)
            shapes: list = [None] * batch.num_rows
            for at, units in units_of(batch.column("embedding")):
                dims[at] = units.shape[1]
                wide, raw = units.shape[1] * 8, units.tobytes()
                sums = b"".join(hashlib.blake2b(raw[k : k + wide], digest_size=16).digest() for k in range(0, len(raw), wide))
                digests[at] = np.frombuffer(sums, "<i8").reshape(-1, 2)
                if form == "code" and len(at):
                    codes, moved = codes_of(units)
                    raw = np.concatenate([moved.astype("<f4")[:, None].view(np.int8), codes], axis=1).tobytes()
                    wide = len(raw) // len(at)
                taken = range(len(at) if form else 0) if names is None else np.flatnonzero(asked(digests[at, 0])).tolist()
                for k in taken:
                    shapes[at[k]] = raw[k * wide : (k + 1) * wide]
            none = dims == 0
            columns = [batch.column("id"), batch.column("label"), pa.array(dims), pa.array(digests[:, 0], mask=none), pa.array(digests[:, 1], mask=none)]
            out = pa.RecordBatch.from_arrays([*columns, *[pa.array(shapes, pa.binary())] * bool(form)], schema=schema)
            yield out.filter(out.column(form).is_valid()) if form else out

    made = vectors.mapInArrow(run, "id long, label string, dim int, hi long, lo long" + f", {form} binary" * bool(form))
    cell = F.when(F.col("label").isNotNull() & F.col("hi").isNotNull(), F.xxhash64("label", "dim"))
    rows = made.select("id", cell.alias("cell"), "hi", "lo", *[form] * bool(form))
    return rows.filter("id IS NOT NULL AND cell IS NOT NULL") if form else rows


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def divide(points: DataFrame, sizes: DataFrame, radius: float, level: int) -> DataFrame:
    """Points of the cells in ``sizes (cell, n)`` in cells of their nearest pivots, with copies across boundaries."""
    draw = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    want = F.least(F.lit(PIVOTS), F.ceil(F.col("size") * 2 / CELL_ROWS))
    here = cut_lineage(points.join(sizes.withColumnRenamed("n", "size"), "cell"))
    pivots = here.filter(F.col("home") & (draw < want / F.col("size"))).select("cell", "size", "id", "vector")
    chunks = F.ceil(F.col("size") / CHUNK_ROWS).cast("int")
    rows = here.select("cell", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"), F.lit(1).alias("role"), "home", "id", "n", "vector")
    sent = pivots.select("cell", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(0).alias("role"), F.lit(True).alias("home"), "id",
                         F.lit(0).cast("long").alias("n"), "vector")
    dealt = rows.unionByName(sent).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "role", "id")
    schema = pa.schema([("cell", pa.int64()), ("home", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("vector", pa.binary()),
                        ("pivot", pa.int64()), ("distance", pa.float64())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["cell", "chunk"]):
            role = group.column("role").to_numpy()
            k = int((role == 0).sum())
            own = group.slice(k)
            if not own.num_rows:
                continue
            x, ids = matrix(own.column("vector")), own.column("id").to_numpy()
            if k == 0:  # No pivot was drawn: the cell stays as it is.
                at, pivot, square = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids))
                home = np.ones(len(ids), bool)
            else:
                p, names = matrix(group.column("vector").slice(0, k)), group.column("id").to_numpy()[:k]
                d2 = np.maximum(0, 2 - 2 * x @ p.T)
                best = d2.argmin(axis=1)
                between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[best]
                gap = d2 - d2[np.arange(len(x)), best][:, None]
                near = gap <= 2 * radius * between + 1e-9
                near[np.arange(len(x)), best] = True
                at, to = np.nonzero(near)
                pivot, square, home = names[to], d2[at, to], to == best[at]
            taken = own.take(pa.array(at))
            yield from pa.Table.from_arrays([
                taken.column("cell"), pa.array(home & taken.column("home").to_numpy()), taken.column("id"), taken.column("n"), taken.column("vector"),
                pa.array(pivot), pa.array(np.sqrt(square))], schema=schema).to_batches()

    moved = cut_lineage(dealt.mapInArrow(nearest, "cell long, home boolean, id long, n long, vector binary, pivot long, distance double"))
    radii = moved.filter("home").groupBy("cell", "pivot").agg(F.max("distance").alias("radius"))
    return moved.join(radii, ["cell", "pivot"]).filter(F.col("distance") <= F.col("radius") + radius + 1e-9).select(
        F.xxhash64("cell", "pivot", F.lit(level)).alias("cell"), F.col("cell").alias("parent"), "home", "id", "n", "vector")


def cells_of(points: DataFrame, radius: float) -> DataFrame:
    """``POINT`` rows in cells of about ``CELL_ROWS``; every partner of a home row has a row in its cell."""
    done, open_ = [], points
    for level in range(LEVELS):
        sizes = cut_lineage(open_.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
        large = sizes.filter(F.col("n") > CELL_ROWS)
        if not large.take(1):
            break
        done.append(open_.join(large, "cell", "left_anti"))
        parts = cut_lineage(divide(open_, large, radius, level))
        work = parts.groupBy("parent", "cell").agg((F.sum(F.col("home").cast("long")) * F.count(F.lit(1))).alias("pairs")).groupBy("parent").agg(
            F.sum("pairs").alias("pairs"))
        before = open_.groupBy("cell").agg((F.sum(F.col("home").cast("long")) * F.count(F.lit(1))).alias("was"))
        better = cut_lineage(work.join(before, F.col("parent") == F.col("cell")).filter(F.col("pairs") <= F.lit(WORTH) * F.col("was")).select("parent"))
        done.append(open_.join(large, "cell", "left_semi").join(better.select(F.col("parent").alias("cell")), "cell", "left_anti"))
        open_ = parts.join(better, "parent", "left_semi").drop("parent")
    for part in done:
        open_ = open_.unionByName(part)
    return open_


def join_cells(cells: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """``(id, links)`` and ``(a, b)``: partners of each home row, and links that connect what is connected.

    Home rows and all rows of a cell are cut into blocks of about ``VECTOR_BYTES``.  Each pair of blocks meets
    in one group and is compared tile by tile, each tile as one matrix product that gives one link a row at most.
    """
    block_rows = F.greatest(F.lit(CELL_ROWS), F.least(F.lit(16 * CELL_ROWS), F.floor(F.lit(VECTOR_BYTES) / F.max(F.length("vector")))))
    sizes = cells.groupBy("cell").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / block_rows).cast("int").alias("left"), F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("right"))
    sized = cells.join(sizes.filter("left > 0"), "cell")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sized.filter("home").withColumn("i", block("left")).select("cell", "i", each("right").alias("j"), F.lit(0).alias("side"), "id", "n", "vector")
    right = sized.withColumn("j", block("right")).select("cell", each("left").alias("i"), "j", F.lit(1).alias("side"), "id", "n", "vector")
    dealt = left.unionByName(right).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["cell", "i", "j"]):
            k = int((group.column("side").to_numpy() == 0).sum())
            if k in (0, group.num_rows):
                continue
            ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
            for up in range(0, k, CELL_ROWS):
                own = slice(up, min(k, up + CELL_ROWS))
                x = matrix(group.column("vector")[own])
                for at in range(k, group.num_rows, CELL_ROWS):
                    yield tile(ids[own], x, ids[at : at + CELL_ROWS], n[at : at + CELL_ROWS], matrix(group.column("vector")[at : at + CELL_ROWS]))

    def tile(a: np.ndarray, x: np.ndarray, b: np.ndarray, n: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        linked = (x @ y.T >= cosine) & (a[:, None] != b[None])
        links = linked @ n
        rows = np.flatnonzero(links)
        columns = np.flatnonzero(linked.any(axis=0))
        near = linked[np.ix_(rows, columns)]
        top = np.iinfo(np.int64).max
        la, lb = a[rows].copy(), b[columns].copy()
        while len(rows):
            na = np.minimum(la, np.where(near, lb[None], top).min(axis=1))
            nb = np.minimum(lb, np.where(near, na[:, None], top).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        ends = np.concatenate([a[rows], b[columns]])
        roots = np.concatenate([la, lb])
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([a[rows], ends])), pa.array(np.concatenate([links[rows], np.zeros(len(ends), np.int64)])),
            pa.array(np.concatenate([a[rows], roots]))], ["id", "links", "root"])

    found = cut_lineage(dealt.mapInArrow(compare, "id long, links long, root long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    return counts, found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()


def blocks_met(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """``points (cell, hi, lo, rep, n, code)`` where their blocks meet, ``(cell, i, c, o, ...)``.

    With k blocks in a cell, the task (i, c) holds block i, at o = 0, and meets blocks (i + o) mod k, up to
    half way around, so that each pair of blocks meets once.  ``sizes (cell, points)`` has at least the cells of several blocks.
    """
    row = F.length("code") + F.lit(36)
    k = F.greatest(F.lit(1), F.ceil(F.coalesce("points", F.lit(1)) * row / BLOCK_BYTES)).cast("int")
    placed = points.join(sizes, "cell", "left").withColumn("k", k).withColumn("b", F.pmod(F.xxhash64("hi", "lo"), F.col("k")).cast("int")).drop("points")
    half = F.floor(F.col("k") / 2).cast("int")
    held = F.transform(F.sequence(F.lit(0), F.floor(half / MET_BLOCKS).cast("int")), lambda c: F.struct(F.col("b").alias("i"), c.alias("c"), F.lit(0).alias("o")))
    met = F.transform(F.slice(F.sequence(F.lit(0), half), F.lit(2), half), lambda o: F.struct(
        F.pmod(F.col("b") - o, F.col("k")).alias("i"), F.floor(o / MET_BLOCKS).cast("int").alias("c"), o.alias("o")))
    # Blocks just opposite each other meet in the first of them.
    once = F.filter(met, lambda x: (x["o"] * 2 < F.col("k")) | (x["i"] < half))
    spread = placed.withColumn("at", F.explode(F.concat(held, once)))
    return spread.select("cell", "at.i", "at.c", "at.o", "hi", "lo", "rep", "n", "code")


class Block:
    """Names, sizes and codes of one block."""

    def __init__(self) -> None:
        self._names, self._raw = bytearray(), bytearray()

    def add(self, rows: pa.RecordBatch) -> None:
        code = rows.column("code")
        ends = np.frombuffer(code.buffers()[1], np.int32)[code.offset : code.offset + len(code) + 1]
        self._raw += memoryview(code.buffers()[2])[ends[0] : ends[-1]]
        self._names += np.column_stack([rows.column(c).to_numpy() for c in ("hi", "lo", "rep", "n")]).tobytes()

    def closed(self) -> Block:
        self.names = np.frombuffer(self._names, np.int64).reshape(-1, 4)
        rows = np.frombuffer(self._raw, np.int8).reshape(len(self.names), -1)
        self.moved, self.codes = rows[:, :4].copy().view("<f4").ravel(), rows[:, 4:]
        return self


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Block]]:
    """``((cell, i, c, o), block)`` of a sorted partition.  Only the block that is read and those the caller keeps are held."""
    now, block = None, Block()
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("cell", "i", "c", "o")])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if start == end:
                continue
            if (key := tuple(keys[:, start].tolist())) != now:
                if now is not None:
                    yield now, block.closed()
                now, block = key, Block()
            block.add(batch.slice(start, end - start))
    if now is not None:
        yield now, block.closed()


LINKED, UNSURE, DENSE = 0, 1, 2
LINK = "kind int, cell long, hi long, lo long, rep long, n long, links long, hi2 long, lo2 long, rep2 long, n2 long"
LINK_SCHEMA = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("cell", "hi", "lo", "rep", "n", "links", "hi2", "lo2", "rep2", "n2"))])


def united(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``roots``, the smallest row that each row is connected with, after rows ``a`` are linked to rows ``b``."""
    while True:
        p, q = roots[a], roots[b]
        if (p == q).all():
            return roots
        np.minimum.at(roots, np.maximum(p, q), np.minimum(p, q))
        while ((up := roots[roots]) != roots).any():
            roots = up


def compare_blocks(cell: int, x: Block, y: Block | None, radius: float) -> Iterator[pa.RecordBatch]:
    """``LINK`` rows of two blocks, or of one: sure links of each point with a root, pairs left open, or that the cell is dense."""
    other, shift = (x, 0) if y is None else (y, len(x.names))
    size, looked, pairs = shift + len(other.names), 0, len(x.names) * len(other.names)
    links, roots = np.zeros(size, np.int64), np.arange(size, dtype=np.int32)
    open_, unsure, new, sure = 0, [], 0, []

    def named(rows: np.ndarray) -> np.ndarray:
        mine = rows < len(x.names)
        out = np.empty((len(rows), 4), np.int64)
        out[mine], out[~mine] = x.names[rows[mine]], other.names[rows[~mine] - shift]
        return out

    def rows(kind: int, a: np.ndarray, b: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        left, right = named(a), named(b)
        numbers = [np.full(len(a), cell), *left.T, links, *right.T]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.ascontiguousarray(v, np.int64)) for v in numbers)], schema=LINK_SCHEMA)

    for h, g, certain, candidates in within(x.codes, x.moved, None if y is None else y.codes, None if y is None else y.moved, radius):
        looked += candidates
        if len(h):
            unsure.append(np.stack([h[~certain], g[~certain] + shift]))
            open_ += unsure[-1].shape[1]
        if open_ > OPEN_PAIRS * size or looked > max(LOOKED_PAIRS * size, LOOKED_SHARE * pairs):
            zero = np.zeros(1, np.int64)
            yield rows(DENSE, zero, zero, zero)
            return
        if certain.any():
            h, g = h[certain], g[certain]
            np.add.at(links, h, other.names[g, 3])
            np.add.at(links, g + shift, x.names[h, 3])
            sure.append(np.stack([h, g + shift]))
            new += len(h)
        if new > 1 << 18:
            roots, sure, new = united(roots, *np.concatenate(sure, axis=1)), [], 0
    if sure:
        roots = united(roots, *np.concatenate(sure, axis=1))
    some = np.flatnonzero(links)
    if len(some):
        yield rows(LINKED, some, roots[some], links[some])
    if open_:
        a, b = np.concatenate(unsure, axis=1)
        yield rows(UNSURE, a, b, np.zeros(len(a), np.int64))


def compare_codes(met: DataFrame, radius: float) -> DataFrame:
    """``LINK`` rows of ``blocks_met``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = None, None
        for (cell, i, c, o), block in blocks_in(batches):
            if o == 0:
                held, task = block, (cell, i, c)
                if c == 0 and len(block.names) > 1:
                    yield from compare_blocks(cell, block, None, radius)
            elif task == (cell, i, c):
                yield from compare_blocks(cell, held, block, radius)
            del block  # before the next one is read

    return met.repartition("cell", "i", "c").sortWithinPartitions("cell", "i", "c", "o").mapInArrow(run, LINK)


def name_filter(names: DataFrame) -> np.ndarray:
    """Bits of the names' digests; it lets other digests pass now and then."""
    bits = F.col("hi").bitwiseAND(NAMES)
    found = names.select(F.shiftright(bits, 15).alias("part"), bits.bitwiseAND((1 << 15) - 1).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((NAMES + 1) // 8, np.uint8)
    for r in found:
        out[r.part << 12 : (r.part + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def as_close(pairs: DataFrame, cosine: float) -> DataFrame:
    """``pairs (a, b, n_a, n_b, x, y)`` whose vectors have the cosine, without the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64) >= cosine for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long, n_a long, n_b long")


def link_vectors(
    vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors of one label and length are linked if their cosine is ``cosine`` or more.
    ``n_links`` counts the other points linked directly.  Vectors that are null, empty, zero,
    or have null or non-finite components, and those with a null label, link with nothing.
    A null id has a null component and is not kept.  Rows that repeat an id and its vector
    count once; an id with several vectors stands for several points, each with its links.
    Equal vectors are one point of a class with a size, so copies cost nothing.  An empty
    table gives no rows; extra columns are ignored.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    vector = F.col(vector_col)
    if dict(vectors.dtypes)[vector_col] not in ("array<float>", "array<double>"):
        vector = vector.cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("embedding"))
    digest, name = ["cell", "hi", "lo"], ["cell", "hi", "lo", "rep", "n"]
    classes = cut_lineage(unit_vectors(rows).filter("id IS NOT NULL AND cell IS NOT NULL").groupBy(*digest, "id").agg(F.count(F.lit(1)).alias("rows")).groupBy(*digest).agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")))
    # What has one row needs no entry: it is named by itself.
    several = cut_lineage(classes.filter("rows > 1"))
    sizes = cut_lineage(classes.groupBy("cell").agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") > ONE_BLOCK))

    def named(found: DataFrame, form: str) -> DataFrame:
        """One row of ``found (id, cell, hi, lo, form)`` for each class, by its name."""
        if not several.take(1):
            return found.select(*digest, F.col("id").alias("rep"), F.lit(1).cast("long").alias("n"), form)
        joined = found.join(several, digest, "left")
        one = joined.filter("rep IS NULL OR id = rep AND rows = n").select(*digest, F.col("id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"), form)
        again = several.filter("rows > n")  # An id repeats with its vector.
        return one.unionByName(found.join(again, digest).filter("id = rep").dropDuplicates(digest).select(*name, form)) if again.take(1) else one

    points = named(unit_vectors(rows, "code"), "code")
    links = cut_lineage(compare_codes(blocks_met(points, sizes), radius))
    dense = cut_lineage(links.filter(F.col("kind") == DENSE).select("cell").distinct())
    told = links.join(dense, "cell", "left_anti")
    other = [F.col(f"{c}2").alias(c) for c in name[1:]]
    ends = told.select(*name).unionByName(told.select("cell", *other)).distinct()
    crowd = cut_lineage(named(unit_vectors(rows, "vector").join(dense, "cell"), "vector")) if dense.take(1) else None
    if crowd is not None:
        ends = ends.unionByName(crowd.select(*name))
    # Numbers in the order of the smallest ids, so that the first class of a component holds its smallest id.
    classed = cut_lineage(with_rank(ends, [], ["rep", *digest], "class"))
    number = lambda c: classed.select(*digest, F.col("class").alias(c))
    second = classed.select("cell", F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("class").alias("b"))
    known = cut_lineage(told.join(number("a"), digest).join(second, ["cell", "hi2", "lo2"]).select("kind", "a", "b", "n", "n2", "links"))
    unsure = known.filter(F.col("kind") == UNSURE).select("a", "b", F.col("n").alias("n_a"), F.col("n2").alias("n_b"))
    asked = cut_lineage(unsure.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classed, "class"))
    shown = unit_vectors(rows, "vector", name_filter(asked)).withColumnRenamed("id", "rep").join(asked.select("class", *name[:-1]), name[:-1]).dropDuplicates(["class"])
    shown = cut_lineage(shown.select("class", "vector"))
    paired = unsure.join(shown.select(F.col("class").alias("a"), F.col("vector").alias("x")), "a").join(shown.select(F.col("class").alias("b"), F.col("vector").alias("y")), "b")
    decided = cut_lineage(as_close(paired.select("a", "b", "n_a", "n_b", "x", "y"), cosine))
    linked = known.filter(F.col("kind") == LINKED)
    counts = linked.select(F.col("a").alias("class"), "links").unionByName(decided.select(F.col("a").alias("class"), F.col("n_b").alias("links"))).unionByName(
        decided.select(F.col("b").alias("class"), F.col("n_a").alias("links")))
    edges = linked.select("a", "b").unionByName(decided.select("a", "b"))
    if crowd is not None:
        dealt = cut_lineage(crowd.join(number("id"), digest).select("cell", F.lit(True).alias("home"), "id", "n", "vector"))
        more, bonds = join_cells(cut_lineage(cells_of(dealt, radius)), cosine)
        counts, edges = counts.unionByName(more.withColumnRenamed("id", "class")), edges.unionByName(bonds)
    smallest = connected_components(edges).join(classed.select(F.col("class").alias("component"), F.col("rep").alias("smallest")), "component")
    met = classed.join(counts.groupBy("class").agg(F.sum("links").alias("links")), "class", "left").join(
        smallest.select(F.col("id").alias("class"), "smallest"), "class", "left").select(*name, "links", "smallest")
    alike = several.join(classed, digest, "left_anti").select(*name, F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("smallest"))
    found = cut_lineage(met.unionByName(alike).select(
        *digest, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "rep").alias("component")))
    joined = unit_vectors(rows).join(found, digest, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias("vec_id"), F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
