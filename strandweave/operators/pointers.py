"""Pointer jumping over parent links, and weakly connected components.

Chains are followed by doubling: every round a node's pointer skips to its pointer's pointer, so a chain of
length L needs log2(L) joins instead of L, and no chain is ever gathered in one place. The rounds work on
two or three narrow columns and cut their lineage with written tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.session import cut_lineage


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def follow(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Follows ``(node, parent)`` links to their ends.

    Returns ``(node, root, dist)`` for all nodes that reach a root, and the remaining ``(node, ptr)`` of
    nodes that run into a cycle (``None`` if there are none); ``ptr`` is then some node further along.
    """
    links = links.select("node", "parent")
    done = [cut_lineage(links.where("parent is null").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("dist")))]
    active = cut_lineage(links.where("parent is not null").select("node", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("dist")))
    left = active.count()
    while left:
        ends = _union(done).select(F.col("node").alias("ptr"), F.col("root").alias("_to"), F.col("dist").alias("_d"), F.lit(True).alias("_end"))
        steps = active.select(F.col("node").alias("ptr"), F.col("ptr").alias("_to"), F.col("dist").alias("_d"), F.lit(False).alias("_end"))
        moved = cut_lineage(active.join(ends.unionByName(steps), "ptr").select(
            "node", F.col("_to").alias("ptr"), (F.col("dist") + F.col("_d")).alias("dist"), "_end"))
        done.append(moved.where("_end").select("node", F.col("ptr").alias("root"), "dist"))
        active = moved.where("not _end").drop("_end")
        now = active.count()
        if now == left:  # no pointer reached an end between two rounds: all that is left is cyclic
            return _union(done), active.select("node", "ptr")
        left = now
    return _union(done), None


def cycle_members(active: DataFrame) -> DataFrame:
    """Nodes on a cycle among nodes that all lead to one, given jumps ``(node, ptr)``.

    The image of a long enough jump is exactly the set of cycle nodes; doubling stops when it no longer
    shrinks.
    """
    jumps, size = active, -1
    while True:
        image = jumps.select(F.col("ptr").alias("node")).distinct()
        now = image.count()
        if now == size:
            return cut_lineage(image)
        size = now
        step = jumps.select(F.col("node").alias("ptr"), F.col("ptr").alias("_to"))
        jumps = cut_lineage(jumps.join(step, "ptr").select("node", F.col("_to").alias("ptr")))


def cycle_positions(links: DataFrame) -> DataFrame:
    """Order along pure cycles of ``(node, parent)`` links: ``(node, last, at, size)``.

    ``last`` is the largest node of the cycle and has position 0, its parent position 1, and so on.
    """
    state = cut_lineage(links.select("node", F.col("parent").alias("ptr"), F.col("node").alias("last")))
    total = None
    while True:
        ahead = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_to"), F.col("last").alias("_m"))
        state = cut_lineage(state.join(ahead, "ptr").select(
            "node", F.col("_to").alias("ptr"), F.greatest("last", "_m").alias("last")))
        now = state.agg(F.sum(F.col("last").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    opened = links.join(state.select("node", "last"), "node")
    opened = opened.select("node", F.when(F.col("parent") != F.col("last"), F.col("parent")).alias("parent"), "last")
    to_end, _ = follow(opened)
    sizes = to_end.join(opened.select("node", "last"), "node")
    spans = sizes.where("node = last").select("last", (F.col("dist") + 1).alias("size"))
    return sizes.join(spans, "last").select("node", "last", (F.col("size") - 1 - F.col("dist")).alias("at"), "size")


def components(edges: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Weakly connected components of ``(a, b)`` edges as ``(node, component)``, named by their smallest node.

    With ``group`` columns the edges of every group are a graph of their own. Nodes should be plain numbers: minima of
    structs cannot be found by hash, and all edges would be sorted in every round.

    Alternates large-star and small-star contraction, which needs a logarithmic number of rounds. A star
    centre is joined with its aggregated minimum instead of being collected, so a centre that owns a
    third of all edges is no special case.
    """
    at = list(group)
    nodes = edges.select(*at, F.col("a").alias("node")).union(edges.select(*at, "b")).distinct()
    # the edges are not freed of copies: that would shuffle all of them, and the first round does it on what is left
    cur = cut_lineage(edges.where("a <> b").select(*at, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    before = None
    while True:
        both = cur.select(*at, F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(*at, "b", "a"))
        low = both.groupBy(*at, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, [*at, "u"]).select(*at, F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = cut_lineage(large)
        # small star: every node with its smaller neighbours and itself moves to their minimum
        down = large.select(*at, F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy(*at, "u").agg(F.min("v").alias("m"))
        small = down.join(low, [*at, "u"]).select(*at, F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
        small = small.union(low.select(*at, F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        cur = cut_lineage(small)
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64(*at, "a", "b").cast("decimal(38,0)"))).first()
        mark = (mark[0], mark[1])
        if mark == before:
            break
        before = mark
    return nodes.join(cur.select(*at, F.col("b").alias("node"), F.col("a").alias("component")), [*at, "node"], "left").select(
        *at, "node", F.coalesce("component", "node").alias("component"))
