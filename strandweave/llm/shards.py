"""Shards of near equal bytes: best-fit-decreasing bin packing of indivisible groups of equal texts.

Groups enter by falling size the shard with the tightest remaining capacity that still holds them; the remaining
capacities are kept in a balanced tree. Groups of one size are interchangeable: as long as it fits, the tightest shard
stays the tightest, so the packing of a whole size class is a few runs ``shard, first rank``. So one task packs the
histogram of group sizes (of N bytes in all there are at most sqrt(2 N) different sizes), and Spark ranks the groups
within their class and looks their shard up. The number of shards is given; the capacity is the smallest of
``average + 2**k - 1`` in which best fit decreasing needs no further shard. A group above the average of what is left
fits no such shard and has one of its own.

Defined results: a null text counts as empty; the overhead of a row counts for every row; shards are numbered by
opening, the groups with a shard of their own first; slots ascend by id (null first) and text digest; of groups of one
size the smaller digest enters first; with fewer groups than shards some shards stay empty; repeated rows are members
of one group; texts are never cut; an empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm.spread import lookup_join
from strandweave.operators.ranking import ranked
from strandweave.session import cut_lineage, ship_code

#: Bytes a row takes besides its text.
OVERHEAD = 16


class Gaps:
    """Remaining capacities of the open shards: a height-balanced tree of ``(capacity, shard)``."""

    def __init__(self):
        self.root = None

    def add(self, gap: int, shard: int) -> None:
        self.root = _added(self.root, (gap, shard))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes the least capacity of at least ``size`` out of the tree."""
        node, best = self.root, None
        while node:
            key, left, right, _ = node
            if key[0] >= size:
                node, best = left, key
            else:
                node = right
        if best:
            self.root = _removed(self.root, best)
        return best


def _node(key, left, right):
    """A node over two subtrees whose heights differ by at most two, balanced by rotations."""
    hl, hr = left[3] if left else 0, right[3] if right else 0
    if hl > hr + 1:
        k, a, b, _ = left
        if (b[3] if b else 0) > (a[3] if a else 0):
            return _node(b[0], _node(k, a, b[1]), _node(key, b[2], right))
        return _node(k, a, _node(key, b, right))
    if hr > hl + 1:
        k, a, b, _ = right
        if (a[3] if a else 0) > (b[3] if b else 0):
            return _node(a[0], _node(key, left, a[1]), _node(k, a[2], b))
        return _node(k, _node(key, left, a), b)
    return key, left, right, 1 + max(hl, hr)


def _added(node, key):
    if not node:
        return _node(key, None, None)
    k, left, right, _ = node
    return _node(k, _added(left, key), right) if key < k else _node(k, left, _added(right, key))


def _removed(node, key):
    k, left, right, _ = node
    if key < k:
        return _node(k, _removed(left, key), right)
    if key > k:
        return _node(k, left, _removed(right, key))
    if not left or not right:
        return left or right
    heir = right
    while heir[1]:
        heir = heir[1]
    return _node(heir[0], left, _removed(right, heir[0]))


def best_fit(sizes: list[int], counts: list[int], capacity: int, shards: int) -> list[list[tuple[int, int]]] | None:
    """Per size (falling) the runs ``(first rank, shard)`` of its groups; None if ``shards`` shards do not hold them."""
    gaps, opened, out = Gaps(), 0, []
    for size, count in zip(sizes, counts):
        runs, rank = [], 0
        while rank < count:
            found = gaps.tightest(size)
            if not found:
                if opened == shards or capacity < size:
                    return None
                found, opened = (capacity, opened), opened + 1
            gap, shard = found
            taken = min(count - rank, gap // size)
            runs.append((rank, shard))
            gaps.add(gap - taken * size, shard)
            rank += taken
        out.append(runs)
    return out


def packed(sizes: list[int], counts: list[int], shards: int) -> list[list[tuple[int, int]]]:
    """Runs of all size classes (falling sizes) in at most ``shards`` shards of near equal load."""
    total = sum(s * c for s, c in zip(sizes, counts))
    own: list[list[tuple[int, int]]] = []
    used, k, left = 0, 0, list(counts)
    while k < len(sizes) and shards - used > 1 and sizes[k] * (shards - used) > total:
        if len(own) == k:
            own.append([])
        own[k].append((counts[k] - left[k], used))
        total -= sizes[k]
        used, left[k] = used + 1, left[k] - 1
        k += not left[k]
    least, slack = -(-total // (shards - used)), 0
    while (rest := best_fit(sizes[k:], left[k:], least + slack, shards - used)) is None:
        slack = 2 * slack + 1
    out = own[:k] + [[(counts[k + i] - left[k + i] + rank, used + shard) for rank, shard in runs] for i, runs in enumerate(rest)]
    if len(own) > k:
        out[k] = own[k] + out[k]
    return out


PLAN = T.StructType([
    T.StructField("bytes", T.LongType()), T.StructField("groups", T.LongType()),
    T.StructField("firsts", T.ArrayType(T.LongType())), T.StructField("shards", T.ArrayType(T.IntegerType()))])


def plan(histogram: DataFrame, shards: int) -> DataFrame:
    """Per group size (``bytes, groups``) the first ranks and shards of its runs; one task packs the histogram."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        sizes, counts = (np.concatenate(x).tolist() for x in zip(*parts))
        runs = packed(sizes, counts, shards)
        for a in range(0, len(sizes), 10_000):
            some = runs[a:a + 10_000]
            yield pa.RecordBatch.from_arrays([
                pa.array(sizes[a:a + 10_000], pa.int64()), pa.array(counts[a:a + 10_000], pa.int64()),
                pa.array([[r for r, _ in x] for x in some], pa.list_(pa.int64())),
                pa.array([[s for _, s in x] for x in some], pa.list_(pa.int32()))], names=PLAN.names)

    one = histogram.select("bytes", "groups").repartition(1).sortWithinPartitions(F.desc("bytes"))
    return one.mapInArrow(work, PLAN)


def sharded(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``<id_col>, size, text_crc32, law, shard, slot, grown_shard``."""
    ship_code(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("_size"), F.crc32(text).alias("_crc"),
        F.unhex(F.sha2(text, 256)).alias("_digest")))
    groups = rows.groupBy("_digest").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes"))
    groups = cut_lineage(groups)
    histogram = groups.groupBy(F.col("_bytes").alias("bytes")).agg(F.count("*").alias("groups"))
    def as_key(c: str):
        return F.col(c).cast("string").cast("binary").alias("_class")

    runs = cut_lineage(plan(histogram, shards)).select(as_key("bytes"), F.col("groups").alias("_groups"), "firsts", "shards")
    placed = ranked(groups, ["_bytes"], ["_digest"], "_rank").select("_digest", "_n", "_rank", as_key("_bytes"))
    placed = lookup_join(placed, runs, ["_class"], "_groups", F.xxhash64("_digest"))
    run = F.size(F.filter("firsts", lambda f: f < F.col("_rank")))
    placed = cut_lineage(placed.select("_digest", "_n", F.element_at("shards", run).alias("_shard")))
    found = lookup_join(rows, placed, ["_digest"], "_n", F.xxhash64("_id"))
    found = ranked(found.drop("_n"), ["_shard"], ["_id", "_digest"], "_slot")
    return found.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"), (F.col("_slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
