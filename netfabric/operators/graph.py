"""Iterative graph operators as rounds of joins.

The driver only learns whether a round changed anything.  Each round is
written to the checkpoint folder, so plans stay short and a lost executor
costs one round at most.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfabric.functions.skew import lookup_join
from netfabric.session import cut_lineage, shared_path


def both_directions(edges: DataFrame, src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """Distinct undirected adjacency ``(src, dst)`` in both directions, no self-loops."""
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter(F.col("src") != F.col("dst"))
    flipped = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.unionByName(flipped).distinct()


def connected_components(edges: DataFrame, src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """``(id, component)`` for every vertex with an edge; the component is its smallest id.

    Every round a vertex takes the smallest label around it, hands it to its
    current root, and then jumps to its label's label, so long chains shrink by
    about half per round instead of one step.
    """
    adjacency = cut_lineage(both_directions(edges, src, dst))
    labels = cut_lineage(
        adjacency.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("_near"))
        .select("id", F.least("id", "_near").alias("label"))
    )
    while True:
        around = (
            lookup_join(adjacency, labels.select(F.col("id").alias("dst"), "label"), "dst")
            .groupBy(F.col("src").alias("id")).agg(F.min("label").alias("_near"))
        )
        candidates = labels.join(around, "id").select("id", "label", F.least("label", "_near").alias("_cand"))
        offers = candidates.select("id", F.col("_cand").alias("_new")).unionByName(
            candidates.select(F.col("label").alias("id"), F.col("_cand").alias("_new"))
        )
        hooked = offers.groupBy("id").agg(F.min("_new").alias("_new"))
        # The label of a vertex is a vertex too, so the jump is an inner join.
        jump = hooked.select(F.col("id").alias("_new"), F.col("_new").alias("_jump"))
        moved = lookup_join(hooked, jump, "_new").select("id", F.col("_jump").alias("_next"))
        step = cut_lineage(
            labels.join(moved, "id").select("id", F.col("_next").alias("label"), (F.col("_next") != F.col("label")).alias("_changed"))
        )
        labels = step.select("id", "label")
        if step.filter("_changed").isEmpty():
            return labels.select("id", F.col("label").alias("component"))


class Components(NamedTuple):
    """Components that grow: ``nodes (id, root, slot)`` at ``nodes_path``, by slot, and ``roots (root, component)``.

    A node keeps the root it was given; what its root has since become is in ``roots``,
    which has a row only for roots that were merged away.
    """

    nodes_path: str
    roots: DataFrame
    slots: int


def empty_components(spark: SparkSession, slots: int = 64) -> Components:
    path = shared_path(spark, "components")
    spark.createDataFrame([], "id string, root string, slot int").write.partitionBy("slot").parquet(path)
    return Components(path, spark.createDataFrame([], "root string, component string"), slots)


def add_edges(known: Components, edges: DataFrame, src: str = "src_id", dst: str = "dst_id") -> Components:
    """The components after a batch of edges.

    The nodes of the batch alone are looked up, in their slots; components of the batch
    are found on the graph of their present roots; and only the roots that lose their
    name are written again, whatever the number of nodes below them.
    """
    spark = edges.sparkSession
    slot = F.pmod(F.xxhash64("id"), F.lit(known.slots)).cast("int")
    pairs = cut_lineage(edges.select(F.col(src).cast("string").alias("a"), F.col(dst).cast("string").alias("b")))
    met = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("slot", slot))
    touched = [r["slot"] for r in met.select("slot").distinct().collect()]  # at most ``slots`` numbers
    stored = spark.read.schema("id string, root string, slot int").parquet(known.nodes_path).filter(F.col("slot").isin(touched))
    placed = cut_lineage(met.join(stored, ["id", "slot"], "left"))
    fresh = placed.filter("root IS NULL").select("id", F.col("id").alias("root"), "slot")
    now = cut_lineage(placed.join(known.roots, "root", "left").select("id", F.coalesce("component", "root", "id").alias("root")))
    ends = pairs.join(now.select(F.col("id").alias("a"), F.col("root").alias("src_id")), "a").join(
        now.select(F.col("id").alias("b"), F.col("root").alias("dst_id")), "b").select("src_id", "dst_id")
    merged = connected_components(ends).filter("id <> component").select(F.col("id").alias("root"), "component")
    # Older rows that lead to a root merged just now lead on to where it went.
    moved = known.roots.join(merged.select(F.col("root").alias("component"), F.col("component").alias("_to")), "component", "left")
    roots = cut_lineage(moved.select("root", F.coalesce("_to", "component").alias("component")).unionByName(merged))
    cut_lineage(fresh).write.mode("append").partitionBy("slot").parquet(known.nodes_path)
    return Components(known.nodes_path, roots, known.slots)


def component_labels(known: Components) -> DataFrame:
    """``(id, component)`` of every node seen; the component is its smallest id."""
    spark = known.roots.sparkSession
    nodes = spark.read.schema("id string, root string, slot int").parquet(known.nodes_path)
    return lookup_join(nodes, known.roots, "root", "left").select("id", F.coalesce("component", "root").alias("component"))


def _expand(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """``(root, node, parent)``: neighbours of the frontier, each once with the smallest frontier node beside it.

    Hubs sit on the edge side; the frontier has a row per (root, node).
    """
    stepped = lookup_join(edges, frontier.select("root", F.col("node").alias("from")), "from")
    return stepped.groupBy("root", F.col("to").alias("node")).agg(F.min("from").alias("parent"))


def _next_level(edges: DataFrame, levels: list[DataFrame], active: DataFrame | None = None) -> DataFrame:
    """The nodes one step beyond the last level, of the roots in ``active``.

    Edges go both ways, so a neighbour of the last level lies in it, in the one before
    or beyond both; older levels need no look.
    """
    last = levels[-1] if active is None else lookup_join(levels[-1], active, "root", "left_semi")
    stepped = _expand(edges, last)
    for level in levels[-2:]:
        stepped = stepped.join(level.select("root", "node"), ["root", "node"], "left_anti")
    return cut_lineage(stepped)


def _as_edges(adjacency: DataFrame) -> DataFrame:
    return cut_lineage(adjacency.select(F.col("src").alias("from"), F.col("dst").alias("to")))


def _roots(ids: DataFrame, column: str) -> DataFrame:
    rows = ids.select(F.col(column).alias("root")).distinct()
    return cut_lineage(rows.select("root", F.col("root").alias("node"), F.lit(None).cast("string").alias("parent")))


def twin_classes(adjacency: DataFrame) -> DataFrame:
    """``(id, class)``: vertices with the same neighbours share a class, named by its smallest id.

    Such twins, as the hosts of one switch, are no neighbours of each other and are equally
    far from everything else.  Classes are linked where their smallest ids are.  The
    neighbours are told apart by their number and two hashes of 64 bits.
    """
    sides = cut_lineage(adjacency.groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("dst")).alias("_a"), F.bit_xor(F.xxhash64(F.lit("twin"), "dst")).alias("_b")))
    same = ["_n", "_a", "_b"]
    # Written, as its size tells whether the vertices must be shuffled to meet their class.
    names = cut_lineage(sides.groupBy(*same).agg(F.min("id").alias("class")))
    return lookup_join(sides, names, same).select("id", "class")


def within_depth(adjacency: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``(start, node, hops)`` for every node at most ``depth`` steps from each start.

    ``adjacency(src, dst)`` holds both directions; ``starts(start)`` are node ids.
    """
    edges = _as_edges(adjacency)
    levels = [_roots(starts, "start")]
    for _ in range(depth):
        level = _next_level(edges, levels)
        if level.isEmpty():
            break
        levels.append(level)
    # Every part of this union is a written table.
    parts = [level.select(F.col("root").alias("start"), "node", F.lit(k).alias("hops")) for k, level in enumerate(levels)]
    return reduce(DataFrame.unionByName, parts)


def shortest_paths(adjacency: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(src, dst, path)`` for the pairs that are connected; of equally short paths the lexicographically smallest.

    All pairs are searched together, from both ends: each round the side with the
    smaller frontier takes a step, so that the levels reach about half of each distance
    only.  Rounds keep nodes and parents, no paths.  A pair leaves when its ends meet,
    or when either end has nothing left to reach.  Then the nodes that lie on a
    shortest path are marked back from where the ends met, each with its smallest
    successor, and one row per pair walks along those.
    """
    wanted = cut_lineage(pairs.select("src", "dst").distinct())
    same = wanted.filter("src = dst").select("src", "dst", F.array("src").alias("path"))
    open_pairs = cut_lineage(wanted.filter("src <> dst"))
    edges = _as_edges(adjacency)
    sides = {"src": [_roots(open_pairs, "src")], "dst": [_roots(open_pairs, "dst")]}
    sizes = {side: levels[0].count() for side, levels in sides.items()}
    roots = dict(sizes)
    met: list[tuple[int, DataFrame]] = []
    while not open_pairs.isEmpty():
        side = "src" if sizes["src"] <= sizes["dst"] else "dst"
        other = "dst" if side == "src" else "src"
        level = _next_level(edges, sides[side], open_pairs.select(F.col(side).alias("root")).distinct())
        sides[side].append(level)
        sizes[side] = level.count()
        # A node on both last levels is in the middle of a shortest path.
        # Pairs take the nodes of the end that has fewer of them, and look those up at the other.
        few, many = (side, other) if sizes[side] * roots[other] <= sizes[other] * roots[side] else (other, side)
        near = sides[few][-1].select(F.col("root").alias(few), "node").join(open_pairs, few)
        hits = cut_lineage(near.join(sides[many][-1].select(F.col("root").alias(many), "node"), [many, "node"]).select("src", "dst", "node"))
        met.append((len(sides["src"]) - 1, hits))
        left = open_pairs.join(hits.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
        open_pairs = cut_lineage(left.join(level.select(F.col("root").alias(side)).distinct(), side, "left_semi").select("src", "dst"))
    return same.unionByName(_paths(edges, sides, met))


def _paths(edges: DataFrame, sides: dict[str, list[DataFrame]], met: list[tuple[int, DataFrame]]) -> DataFrame:
    """Paths of the pairs in ``met``: how many steps from the source, and ``(src, dst, node)`` where the ends met."""
    keys = ["src", "dst"]
    every = reduce(DataFrame.unionByName, [hits for _, hits in met]) if met else None
    if every is None or every.isEmpty():
        return edges.select(F.col("from").alias("src"), F.col("from").alias("dst"), F.array("from").alias("path")).filter(F.lit(False))
    links, marked = [], None
    for step in range(len(sides["src"]) - 1, 0, -1):
        here = [hits for steps, hits in met if steps == step] + ([marked] if marked is not None else [])
        if not here:
            continue
        now = reduce(DataFrame.unionByName, [h.select(*keys, "node") for h in here]).distinct()
        back = lookup_join(edges, now.withColumnRenamed("node", "to"), "to").groupBy(*keys, F.col("from").alias("node")).agg(F.min("to").alias("next"))
        before = sides["src"][step - 1].select(F.col("root").alias("src"), "node")
        marked = cut_lineage(back.join(before, ["src", "node"], "left_semi").select(*keys, "node", "next"))
        links.append(marked)
    # One row per pair walks from its source to where its ends met, and on by the parents of the other side.
    walk = every.select(*keys).distinct().select(*keys, F.col("src").alias("node"), F.array("src").alias("path"))
    for step, link in enumerate(reversed(links), 1):
        ahead = walk.join(link, [*keys, "node"], "left")
        walk = _stepped(ahead, keys, step)
    for step, level in enumerate(reversed(sides["dst"][1:]), 1):
        ahead = walk.join(level.select(F.col("root").alias("dst"), "node", F.col("parent").alias("next")), ["dst", "node"], "left")
        walk = _stepped(ahead, keys, step)
    return walk.select(*keys, "path")


def _stepped(ahead: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Walks that took their next step, where they have one; written now and then, as a plan must stay short."""
    moved = ahead.select(
        *keys, F.coalesce("next", "node").alias("node"),
        F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path"))
    return moved if step % 6 else cut_lineage(moved)


def reaches_root(links: DataFrame, root: str = "") -> DataFrame:
    """Ids whose parent chain ends at ``root``; ``links(chain, id, parent)``.

    Pointer doubling: each round halves the distance of every open row, so a
    chain of n rows needs about log2(n) rounds.  Rows that arrived leave the
    loop; rows on a cycle never arrive and end it by making no progress.  A row
    whose parent is missing stays open and is not returned.
    """
    open_rows = cut_lineage(
        links.select("chain", "id", F.col("parent").alias("ptr")).distinct()
    )
    done = cut_lineage(open_rows.filter(F.col("ptr") == root).select("chain", "id").distinct())
    open_rows = cut_lineage(open_rows.filter(F.col("ptr") != root).join(done, ["chain", "id"], "left_anti"))
    arrived = done
    span, limit = 1, open_rows.count()
    while limit:
        # A pointer to an arrived row has arrived.
        hits = lookup_join(open_rows, arrived.select("chain", F.col("id").alias("ptr")), ["chain", "ptr"], "left_semi")
        newly = cut_lineage(hits.select("chain", "id").distinct())
        left = open_rows.join(newly, ["chain", "id"], "left_anti")
        # The jump goes through every open row, those that arrived just now
        # included.  A pointer to anything else leads nowhere, and so does all
        # that hangs on it: the inner join drops it.
        jump = open_rows.select("chain", F.col("id").alias("ptr"), F.col("ptr").alias("_next"))
        stepped = cut_lineage(
            lookup_join(left, jump, ["chain", "ptr"]).select("chain", "id", F.col("_next").alias("ptr")).distinct()
        )
        # Every part of this union is a written table.
        arrived = arrived.unionByName(newly)
        if span > limit or stepped.isEmpty():
            # Rows still open after doubling past their number are on a cycle.
            break
        span *= 2
        open_rows = stepped
    return arrived
