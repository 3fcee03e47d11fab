"""Chains of directed pairs: branch pruning, tracking, chain ends.

Every pair of a class is an edge between two particles. An edge is followed by the first edge (in row
order) that starts where it ends, so the edges of a class form paths, paths that merge, and cycles. With a
greater branch depth the second, third .. edge is followed in further rounds. Where nothing forks these rounds
only renumber, and everything is pointer doubling; of a connected part with a fork the edges that walks follow (a few
per particle) are tracked in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.distance import distance_to_centre
from strandweave.operators.pointers import components, cycle_members, cycle_positions, follow
from strandweave.operators.ranking import ranked
from strandweave.schema import ANGLE, END_COLUMNS, VECT
from strandweave.session import cut_lineage, ship_code


# --- pruning -----------------------------------------------------------------------------------------

def best_edges(scored: DataFrame, distance: str = "cn_distance") -> DataFrame:
    """``row_no`` of the edges that are closest to the class mean at both of their ends.

    The two directions are judged independently on the same input: an edge that loses at its start still
    competes at its end. Ties go to the earlier row.
    """
    narrow = cut_lineage(scored.select("row_no", "pairClass", "pairIDX1", "pairIDX2", F.col(distance).alias("_d")))
    winners = []
    for end in ("pairIDX1", "pairIDX2"):  # minima of plain numbers are found by hash; those of structs would sort all edges
        keys = ["pairClass", end]
        least = cut_lineage(narrow.groupBy(*keys).agg(F.min("_d").alias("_least")))
        level = narrow.join(least, keys).where("_d <=> _least")
        winners.append(level.groupBy(*keys).agg(F.min("row_no").alias("row_no")).select("row_no"))
    return winners[0].join(winners[1], "row_no", "left_semi")


def prune_branches(
    pairs: DataFrame, centres: DataFrame, radius: float, metric: str = "scale2Ang",
) -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)``: leaves at most one outgoing and one incoming edge per particle and class."""
    narrow = pairs.where("pairClass <> 0").select("row_no", "pairClass", "pairIDX1", "pairIDX2", *VECT, *ANGLE)
    scored = distance_to_centre(narrow.join(centres, "pairClass"), radius, metric)
    best = cut_lineage(best_edges(scored))
    kept = pairs.where("pairClass = 0").unionByName(
        pairs.where("pairClass <> 0").join(best, "row_no", "left_semi").select(pairs.columns))
    removed = pairs.where("pairClass <> 0").join(best, "row_no", "left_anti").select(pairs.columns)
    return kept, removed


# --- tracking ----------------------------------------------------------------------------------------

def _successors(edges: DataFrame) -> DataFrame:
    first = edges.groupBy("pairClass", "pairTomoID", F.col("pairIDX1").alias("_at")).agg(F.min("row_no").alias("succ"))
    ends = edges.withColumn("_at", F.col("pairIDX2"))
    return ends.join(first, ["pairClass", "pairTomoID", "_at"], "left").drop("_at")


def _plain_chains(links: DataFrame) -> tuple[DataFrame, bool]:
    """Chains without merges: ``(node, key, step, flag)``; ``key`` orders and names the chain."""
    preds = links.where("parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("_p"))
    back = links.select("node").join(preds, "node", "left").select("node", F.col("_p").alias("parent"))
    back = cut_lineage(back)
    paths, rest = follow(back)
    out = paths.select("node", F.col("root").alias("key"), (F.col("dist") + 1).alias("step"), F.lit(1).alias("flag"))
    if rest is None:
        return out, False
    ring = links.join(rest.select("node"), "node", "left_semi")
    at = cycle_positions(ring)
    return out.unionByName(at.select("node", F.col("last").alias("key"), (F.col("at") + 1).alias("step"),
                                     F.lit(1).alias("flag"))), True


def _upstream_doubling(state: DataFrame, value: str, pick) -> DataFrame:
    """Aggregates ``value`` over everything upstream of a node in a forest of ``(node, parent)`` links."""
    state = cut_lineage(state)
    while not state.where("parent is not null").isEmpty():
        inflow = state.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(pick(value).alias("_in"))
        jump = state.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
        both = F.greatest if pick is F.max else F.least
        state = cut_lineage(
            state.join(inflow, "node", "left").join(jump, "parent", "left")
            .select("node", F.col("_next").alias("parent"), both(value, "_in").alias(value)))
    return state.drop("parent")


def _count_downstream(state: DataFrame, value: str) -> DataFrame:
    """Sums ``value`` over the node and everything downstream of it."""
    state = cut_lineage(state)
    while not state.where("parent is not null").isEmpty():
        jump = state.select(F.col("node").alias("parent"), F.col("parent").alias("_next"), F.col(value).alias("_v"))
        state = cut_lineage(state.join(jump, "parent", "left").select(
            "node", F.col("_next").alias("parent"), (F.col(value) + F.coalesce("_v", F.lit(0))).alias(value)))
    return state.drop("parent")


def _thinned(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, beside)``: edges that decide about the chains, and ``(row_no, _like)`` of all others.

    Only the first edge of a particle is followed, so every other edge is only the start of its own walk. Of those that
    lead to the same particle the first and the last in row order decide; one between them becomes a side branch
    of one step in the chain of the first (``_like``). A few edges per particle are left, however many pairs there are.
    """
    first = cut_lineage(edges.groupBy(*_GROUP, F.col("pairIDX1").alias("_n")).agg(F.min("row_no").alias("_first")))
    tops = first.select(F.col("_first").alias("row_no"))
    rest = edges.join(tops, "row_no", "left_anti")
    keys = [*_GROUP, "pairIDX2"]
    bounds = rest.groupBy(*keys).agg(F.min("row_no").alias("_like"), F.max("row_no").alias("_last"), F.count("*").alias("_n"))
    bounds = bounds.where("_n > 2").drop("_n").join(first.select(*_GROUP, F.col("_n").alias("pairIDX2")), keys, "left_semi")
    bounds = cut_lineage(bounds)
    if bounds.isEmpty():
        return edges, bounds.select(F.col("_last").alias("row_no"), "_like")
    between = (F.col("row_no") > F.col("_like")) & (F.col("row_no") < F.col("_last"))
    beside = cut_lineage(rest.join(bounds, keys).where(between).select("row_no", "_like"))
    kept = rest.join(bounds, keys, "left").where(F.coalesce(~between, F.lit(True))).select(*edges.columns)
    return cut_lineage(kept.unionByName(edges.join(tops, "row_no", "left_semi").select(*edges.columns))), beside


def _merging_chains(links: DataFrame, beside: DataFrame) -> tuple[DataFrame, bool]:
    """Chains where several edges may lead into one; same output as :func:`_plain_chains`.

    Walking from the edges in row order, a walk is recorded unless an earlier row already passed through
    its start. So an edge is recorded when no smaller row lies upstream of it, and an edge belongs to the
    last recorded walk upstream of it. A merged chain keeps its place in the numbering from the last
    recorded walk that still ran through all rows before it. Edges outside the last walk are side branches.
    The edges ``beside`` (:func:`_thinned`) count in that numbering, as far as it can matter.
    """
    done, rest = follow(links)
    looped = rest is not None
    tree = links
    if looped:
        on_cycle = cycle_members(rest)
        ring = links.join(on_cycle, "node", "left_semi")
        at = cut_lineage(cycle_positions(ring))
        entry = at.select(F.col("node").alias("parent"), F.lit(True).alias("_enters"))
        tree = links.join(on_cycle, "node", "left_anti").join(entry, "parent", "left").select(
            "node", F.when(F.col("_enters").isNull(), F.col("parent")).alias("parent"),
            F.when(F.col("_enters"), F.col("parent")).alias("entry"))
        done, _ = follow(tree)
        enters = tree.where("entry is not null").select(F.col("node").alias("root"), "entry")
        done = done.join(enters, "root", "left").join(
            at.select(F.col("node").alias("entry"), F.col("last").alias("_ring")), "entry", "left")
        done = done.withColumn("comp", F.coalesce("_ring", "root")).drop("_ring")
    else:
        done = done.withColumn("comp", F.col("root")).withColumn("entry", F.lit(None).cast("long"))
    done = cut_lineage(done)
    tree = cut_lineage(tree.select("node", "parent"))

    low = _upstream_doubling(tree.withColumn("low", F.col("node")), "low", F.min)
    tree_rec = tree.join(low, "node").withColumn("rec", F.col("low") == F.col("node")).drop("low")
    tree_rec = cut_lineage(tree_rec)
    owner = _upstream_doubling(
        tree_rec.select("node", "parent", F.when(F.col("rec"), F.col("node")).alias("owner")), "owner", F.max)
    depth = _count_downstream(tree_rec.select("node", "parent", F.col("rec").cast("long").alias("records")), "records")

    recorded = cut_lineage(tree_rec.where("rec").select("node").join(done, "node").join(depth, "node"))
    lasts = recorded.groupBy("comp").agg(F.max(F.struct("node", "dist", "entry")).alias("last"))
    numbered = ranked(recorded, ["comp"], ["node"], "_nth").select("comp", "node", "records", "_nth")
    # a row that stands after as many recorded rows as a walk passes at most cannot name its chain
    most = cut_lineage(recorded.groupBy("comp").agg(F.max("records").alias("_most")))
    upto = numbered.join(most, "comp").where("_nth >= _most").groupBy("comp").agg(F.min("node").alias("_upto"))
    upto = cut_lineage(most.select("comp").join(upto, "comp", "left"))
    early = recorded.join(upto, "comp").where("_upto is null or node <= _upto").select("comp", "node", "records", "_upto")
    like = cut_lineage(early.select(F.col("node").alias("_like"), "comp", "records", "_upto"))
    more = beside.join(like, "_like").where("_upto is null or row_no <= _upto").select("comp", F.col("row_no").alias("node"), "records")
    numbered = ranked(early.drop("_upto").unionByName(more), ["comp"], ["node"], "_nth")
    keys = numbered.where("_nth = records").groupBy("comp").agg(F.max("node").alias("key"))
    chains = cut_lineage(lasts.join(keys, "comp", "left"))
    base = done.join(owner, "node").join(chains, "comp")
    start = done.select(F.col("node").alias("owner"), F.col("dist").alias("_od"))
    out = base.join(start, "owner").select(
        "node", "key", (F.col("_od") - F.col("dist") + 1).alias("step"),
        F.when(F.col("owner") == F.col("last.node"), 1).otherwise(2).alias("flag"))
    if not looped:
        return out, False
    from_entry = at.select(F.col("node").alias("_e"), F.col("at").alias("_eat"))
    tails = chains.select(F.col("comp").alias("last"), "key", F.col("last").alias("tail"))
    rings = at.join(tails, "last", "left").withColumn("_e", F.col("tail.entry")).join(from_entry, "_e", "left")
    round_trip = F.pmod(F.col("at") - F.coalesce("_eat", F.lit(0)), F.col("size"))
    lead = F.when(F.col("tail").isNotNull(), F.col("tail.dist") + 1).otherwise(F.lit(0))
    return out.unionByName(rings.select(
        "node", F.coalesce("key", "last").alias("key"), (lead + round_trip + 1).alias("step"), F.lit(1).alias("flag"))), True


class _Part:
    """Chains of one connected part, walked round by round; rows are numbered from 0 in row order.

    Every row is visited once a round: a walk that meets a row an earlier walk of the round has passed goes on as that
    one did, through rows of one chain. Chains are sets with a size; what a walk leaves to its rows (step, main line) is
    handed down the links at the end of the round, from the last walk that came by.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.n = len(first)
        order = np.argsort(first, kind="stable")
        sources, begin, count = np.unique(first[order], return_index=True, return_counts=True)
        at = np.minimum(np.searchsorted(sources, second), len(sources) - 1)
        self.follows = sources[at] == second
        self.order, self.begin, self.count = order, begin[at], count[at]
        self.parent = list(range(self.n))  # sets of rows; the head of a set stands for the chain
        self.inside = [False] * self.n  # has any walk passed the row
        self.size, self.place, self.newest = [0] * self.n, [-1] * self.n, [-1] * self.n  # by head; walks are n * round + start
        self.step, self.walk = [0] * self.n, [-1] * self.n

    def head(self, row: int) -> int:
        parent = self.parent
        while parent[row] != row:
            parent[row] = row = parent[parent[row]]
        return row

    @property
    def path(self) -> list[int]:
        """Chain of every row."""
        return [self.head(row) for row in range(self.n)]

    @property
    def flag(self) -> list[int]:
        """1 on the rows of the last walk that made the chain, 2 on its side branches."""
        return [1 if self.walk[row] == self.newest[p] else 2 for row, p in enumerate(self.path)]

    def walk_round(self, number: int) -> None:
        following = np.where(self.follows, self.order[self.begin + np.minimum(number, self.count - 1)], -1).tolist()
        seen, ring = [-1] * self.n, [0] * self.n  # start of the first walk through the row; size of the ring it is on
        reach, place_in = [0] * self.n, [0] * self.n  # rows from here to the end, place in the first walk
        owner = [-1] * self.n  # start of the last merging walk through the row
        for start in range(self.n):
            fresh, at = [], start
            if seen[start] >= 0:
                if not ring[start] or self.size[self.head(start)] > ring[start]:
                    continue  # inside an earlier walk of this round
            while at >= 0 and seen[at] < 0:
                seen[at], place_in[at] = start, len(fresh)
                fresh.append(at)
                at = following[at]
            beyond = 0
            if at >= 0 and fresh and seen[at] == start:  # back at its own rows: a ring
                turn, at = place_in[at], -1
                for row in fresh[turn:]:
                    ring[row] = reach[row] = len(fresh) - turn
                for k, row in enumerate(fresh[:turn]):
                    reach[row] = len(fresh) - k
            else:
                beyond = reach[at] if at >= 0 else 0
                for k, row in enumerate(fresh):
                    reach[row] = len(fresh) - k + beyond
            if self._merge(fresh, at, beyond, self.n * number + start):
                owner[start] = start
        self._hand_down(number, following, reach, ring, owner)

    def _merge(self, fresh: list[int], tail: int, beyond: int, now: int) -> bool:
        """Joins the chains a walk meets: its rows in ``fresh``, then ``beyond`` rows from ``tail`` on, all of one chain."""
        touched = {self.head(row) for row in fresh if self.inside[row]}
        known = sum(self.inside[row] for row in fresh) + beyond
        if tail >= 0:
            touched.add(self.head(tail))
        total, length = sum(self.size[p] for p in touched), len(fresh) + beyond
        if len(touched) == 1 and total > length and known == length:
            return False  # part of a chain
        place = min(self.place[p] for p in touched) if total > known else now
        name = max(touched, key=lambda p: self.size[p]) if touched else fresh[0]
        for p in touched:
            self.parent[p] = name
        for row in fresh:
            if not self.inside[row]:
                self.inside[row], self.parent[row] = True, name
        self.size[name], self.place[name], self.newest[name] = total - known + length, place, now
        return True

    def _hand_down(self, number: int, following: list[int], reach: list[int], ring: list[int], owner: list[int]) -> None:
        entered: dict[int, int] = {}  # ring by its smallest row: the row at which the last walk entered
        for row in np.argsort(-np.array(reach, np.int64), kind="stable").tolist():
            if not ring[row]:
                to = following[row]
                if to >= 0:
                    owner[to] = max(owner[to], owner[row])
        done = [False] * self.n
        for row in range(self.n):
            if ring[row] and not done[row]:
                best, at = row, row
                while not done[at]:
                    done[at] = True
                    best = at if owner[at] > owner[best] else best
                    at = following[at]
                last, lead = owner[best], reach[owner[best]] - ring[best] if owner[best] >= 0 else 0
                for k in range(ring[best]):
                    owner[at := best if k == 0 else following[at]] = last
                    if last >= 0:
                        self.step[at], self.walk[at] = lead + k + 1, self.n * number + last
            elif not ring[row] and owner[row] >= 0:
                self.step[row], self.walk[row] = reach[owner[row]] - reach[row] + 1, self.n * number + owner[row]


def _tracked_part(depth: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_no")
        part = _Part(table.column("pairIDX1").to_numpy(), table.column("pairIDX2").to_numpy())
        for number in range(depth):
            part.walk_round(number)
        rows = table.column("row_no").to_numpy()
        places = np.array(part.place, np.int64)[np.array(part.path, np.int64)]
        return pa.table({"row_no": rows, "round": places // part.n, "key": rows[places % part.n],
                         "step": np.array(part.step, np.int64), "flag": np.array(part.flag, np.int32)})

    return work


_GROUP = ["pairClass", "pairTomoID"]
_PLACED = ["row_no", "pairClass", "pairTomoID", "pairIDX1", "pairIDX2", "round", "key", "step", "flag"]


def _forked(edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(forked, inner, plain, branched)``: chains of the connected parts with a fork, edges of these parts that stand
    for themselves (``_like`` is the edge they share the chain with), the edges of all other parts, and the groups in
    which anything forks or merges.

    Walks follow the first ``depth`` edges of a particle that something leads to. Every other edge is only the start of
    its own walk. Of those that lead to the same particle the first and the last in row order decide everything: the
    first joins the chains, the last leaves its steps, and one between them becomes a side branch of one step. So a part
    has a few edges per particle to walk, however many pairs there are.
    """
    def at(c: str):
        return [*_GROUP, F.col(c).alias("_n")]

    keys = [*_GROUP, "_n"]
    out = edges.groupBy(*at("pairIDX1")).agg(F.count("*").alias("_out"), F.min("row_no").alias("_top"))
    into = edges.groupBy(*at("pairIDX2")).agg(F.count("*").alias("_into"))
    out, into = cut_lineage(out), cut_lineage(into)
    branched = cut_lineage(out.where("_out > 1").select(*_GROUP).union(into.where("_into > 1").select(*_GROUP)).distinct())
    passed = out.join(into.select(*keys), keys)  # particles that walks pass through
    starts = edges.select(*at("pairIDX1"), "row_no")
    for _ in range(1, depth):  # the last edge that is followed
        later = starts.join(passed.where("_out > 1").select(*keys, "_top"), keys).where(F.col("row_no") > F.col("_top"))
        later = later.groupBy(*keys).agg(F.min("row_no").alias("_next"))
        passed = passed.join(later, keys, "left").withColumn("_top", F.coalesce("_next", "_top")).drop("_next")
    passed = cut_lineage(passed)

    sources = passed.select(*_GROUP, F.col("_n").alias("pairIDX1"), "_top")
    image = edges.join(sources, [*_GROUP, "pairIDX1"]).where(F.col("row_no") <= F.col("_top")).drop("_top")
    image = cut_lineage(image)
    parts = components(image.select(*_GROUP, F.col("pairIDX1").alias("a"), F.col("pairIDX2").alias("b")), tuple(_GROUP))
    parts = cut_lineage(parts.select(*_GROUP, F.col("node").alias("_n"), F.col("component").alias("_part")))
    hit = parts.join(passed.where("_out > 1").select(*keys), keys, "left_semi").select(*_GROUP, "_part").distinct()
    parts = cut_lineage(parts.join(hit, [*_GROUP, "_part"], "left_semi").join(passed.select(*keys, "_top"), keys))
    walked = image.join(parts.select(*_GROUP, F.col("_n").alias("pairIDX1"), "_part"), [*_GROUP, "pairIDX1"])
    own = edges.join(parts.select(*_GROUP, F.col("_n").alias("pairIDX2"), "_part"), [*_GROUP, "pairIDX2"])
    own = own.join(sources, [*_GROUP, "pairIDX1"], "left").where("_top is null or row_no > _top").drop("_top")
    bounds = cut_lineage(own.groupBy(*_GROUP, "pairIDX2").agg(F.min("row_no").alias("_lo"), F.max("row_no").alias("_like")))
    own = own.join(bounds, [*_GROUP, "pairIDX2"])
    outer = own.where(F.col("row_no").isin(F.col("_lo"), F.col("_like")))
    inner = own.where((F.col("row_no") > F.col("_lo")) & (F.col("row_no") < F.col("_like"))).select(*edges.columns, "_like")
    ship_code(edges.sparkSession)
    skeleton = cut_lineage(walked.select(*edges.columns, "_part").unionByName(outer.select(*edges.columns, "_part")))
    found = skeleton.groupBy(*_GROUP, "_part").applyInArrow(
        _tracked_part(depth), "row_no long, round long, key long, step long, flag int")
    forked = cut_lineage(skeleton.drop("_part").join(found, "row_no").select(*_PLACED))
    # an edge is in a walked part through its start if it is followed, else through its end
    ends = parts.select(*_GROUP, F.col("_n").alias("pairIDX2"), F.lit(True).alias("_in"))
    followed = image.join(parts.select(*_GROUP, F.col("_n").alias("pairIDX1")), [*_GROUP, "pairIDX1"], "left_anti")
    alone = edges.join(ends, [*_GROUP, "pairIDX2"], "left_anti").join(sources, [*_GROUP, "pairIDX1"], "left")
    alone = alone.where("_top is null or row_no > _top").select(*edges.columns)
    return forked, inner, cut_lineage(alone.unionByName(followed.select(*edges.columns))), branched


def track(pairs: DataFrame, depth: int = 1) -> DataFrame:
    """Chain id, position and side-branch flag per edge: ``(row_no, pairClass, chain, step, flag, closing)``.

    In round b of ``depth`` a walk starts at every edge in row order and takes the b-th edge at a fork (the last one if
    there are fewer). A walk that meets several chains, or leaves one, joins them: its own edges are the main line,
    what it does not pass becomes a side branch (flag 2) and keeps its steps, and the result stands where the first of
    the joined chains stood. A walk that passes every edge of the chains it meets replaces them and stands last.
    In a volume and class without forks and merges there is one round.

    Chain ids run on across the volumes of a class. ``closing`` is 1 or 2 on the last edge of a chain that
    returns to the start or the end of its first edge. Memory: when ``depth`` is above 1, the followed edges of a
    connected part with a fork must fit one task (at most ``depth + 2`` edges a particle, however many pairs it has);
    all else is distributed.
    """
    edges = cut_lineage(pairs.where("pairClass <> 0").select(
        "pairClass", "pairTomoID", "row_no", "pairIDX1", "pairIDX2"))
    forked, inner, plain, branched = _forked(edges, depth) if depth > 1 else (None, None, edges, None)
    plain, beside = _thinned(plain)
    succ = cut_lineage(_successors(plain).select(F.col("row_no").alias("node"), F.col("succ").alias("parent")))
    merging = not succ.where("parent is not null").groupBy("parent").count().where("count > 1").isEmpty()
    chains, looped = _merging_chains(succ, beside) if merging else _plain_chains(succ)
    chains = cut_lineage(chains).withColumnRenamed("node", "row_no")
    placed = plain.join(chains, "row_no").withColumn("round", F.lit(0).cast("long"))
    if forked is not None:  # a walk through the whole of a chain puts it last again in every round
        placed = cut_lineage(placed)
        whole = placed.groupBy("pairClass", "pairTomoID", "key").agg(F.max("flag").alias("_f")).where("_f = 1").drop("_f")
        whole = whole.join(branched, ["pairClass", "pairTomoID"], "left_semi").withColumn("_last", F.lit(depth - 1))
        placed = placed.join(whole, ["pairClass", "pairTomoID", "key"], "left").withColumn("round", F.coalesce("_last", "round")).drop("_last")
        placed = placed.select(*_PLACED).unionByName(forked)
    placed = cut_lineage(placed)
    heads = placed.select("pairClass", "pairTomoID", "round", "key").distinct()
    named = ranked(heads, ["pairClass"], ["pairTomoID", "round", "key"], "chain").select("pairClass", "pairTomoID", "round", "key", "chain")
    out = placed.join(named, ["pairClass", "pairTomoID", "round", "key"])
    if not (looped or merging) and forked is None:
        return out.select("row_no", "pairClass", "chain", "step", "flag", F.lit(0).alias("closing"))
    at = F.struct("step", "row_no", "pairIDX1", "pairIDX2")
    ends = out.groupBy("pairClass", "chain").agg(F.min(at).alias("_a"), F.max(at).alias("_z"), F.count("*").alias("_n"))
    closing = (F.when((F.col("_n") > 1) & (F.col("_z.pairIDX2") == F.col("_a.pairIDX2")), 2)
               .when((F.col("_n") > 1) & (F.col("_z.pairIDX2") == F.col("_a.pairIDX1")), 1).otherwise(0))
    ends = ends.select("pairClass", "chain", F.col("_z.row_no").alias("_zrow"), closing.alias("_c")).where("_c > 0")
    out = out.join(ends, ["pairClass", "chain"], "left")
    out = out.select("row_no", "pairClass", "chain", "step", "flag",
                     F.when(F.col("row_no") == F.col("_zrow"), F.col("_c")).otherwise(0).alias("closing"))
    # never the first or the last edge of a chain, so they only take its number
    out = cut_lineage(out)
    beside = beside if inner is None else beside.unionByName(inner.select("row_no", "_like"))
    beside = beside.join(out.select(F.col("row_no").alias("_like"), "pairClass", "chain"), "_like")
    return out.unionByName(beside.select("row_no", "pairClass", "chain", F.lit(1).cast("long").alias("step"),
                                         F.lit(2).alias("flag"), F.lit(0).alias("closing")))


def track_chains(pairs: DataFrame, depth: int = 1) -> DataFrame:
    """Writes chain labels and positions into the pair table; class 0 keeps its values."""
    found = track(pairs, depth).drop("pairClass")
    label = F.col("chain") + (F.col("flag") - 1) / 10
    hit = F.col("chain").isNotNull()
    second = F.when(F.col("closing") > 0, F.col("closing")).otherwise(F.col("step") + 1)
    joined = pairs.join(found, "row_no", "left").withColumns({
        "pairLabel": F.when(hit, label).otherwise(F.col("pairLabel")),
        "pairPosInPoly1": F.when(hit, F.col("step").cast("int")).otherwise(F.col("pairPosInPoly1")),
        "pairPosInPoly2": F.when(hit, second.cast("int")).otherwise(F.col("pairPosInPoly2")),
    })
    return joined.select(pairs.columns)


# --- chain ends --------------------------------------------------------------------------------------

def chain_ends(pairs: DataFrame) -> DataFrame:
    """Heads (nothing leads in) and tails (nothing leads out) of the weakly connected parts of every class.

    A part with forks has several heads or tails; a closed ring takes a number and has no row. Numbers
    follow the first row of the part and run on across the volumes of a class.
    """
    edges = cut_lineage(pairs.where("pairClass <> 0").select(
        "pairClass", "pairTomoID", "pairTomoName", "row_no", "pairIDX1", "pairIDX2"))
    # a particle takes part in each class separately
    comp = components(edges.select("pairClass", F.col("pairIDX1").alias("a"), F.col("pairIDX2").alias("b")), ("pairClass",))
    comp = cut_lineage(comp.withColumnsRenamed({"node": "pairIDX", "component": "comp"}))
    sides = [edges.select("pairClass", "pairTomoID", "pairTomoName", "row_no", F.col(c).alias("pairIDX"), F.lit(o).alias("out"), F.lit(1 - o).alias("into"))
             for c, o in (("pairIDX1", 1), ("pairIDX2", 0))]
    # the name is a key of the first grouping: a minimum of texts there would sort all edges
    degree = sides[0].union(sides[1]).groupBy("pairClass", "pairIDX", "pairTomoID", "pairTomoName").agg(
        F.sum("out").alias("_out"), F.sum("into").alias("_in"), F.min("row_no").alias("_row"))
    degree = degree.groupBy("pairClass", "pairIDX").agg(
        F.min("pairTomoID").alias("pairTomoID"), F.min("pairTomoName").alias("pairTomoName"),
        F.sum("_out").alias("_out"), F.sum("_in").alias("_in"), F.min("_row").alias("_row"))
    degree = cut_lineage(degree.join(comp, ["pairClass", "pairIDX"]))
    parts = degree.groupBy("pairClass", "comp").agg(
        F.min("pairTomoID").alias("_t"), F.min("_row").alias("_row"), F.count("*").alias("polylen_riboNr"))
    parts = ranked(parts, ["pairClass"], ["_t", "_row"], "pairLabel")
    ends = degree.where("_out = 0 or _in = 0").join(
        parts.select("pairClass", "comp", "pairLabel", "polylen_riboNr"), ["pairClass", "comp"])
    tail = F.when(F.col("_out") == 0, 1).otherwise(0)
    return ends.select("pairTomoName", "pairTomoID", "pairClass", "pairIDX", tail.alias("ifWoOut"),
                       (1 - tail).alias("ifWoIn"), "pairLabel", "polylen_riboNr").select(*END_COLUMNS)
