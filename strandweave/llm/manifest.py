"""Merkle manifest of a table: a tree per group, a tree over the groups' roots, and a proof per row.

Leaves of a group are ranked, and the base-``FAN`` digits of the ranks are grouped away one after the other, lowest
first: each grouping hashes the runs of ``FAN`` children and nests their structs in the parent's. ``HEIGHT`` digits
make a block of at most ``FAN ** HEIGHT`` leaves in one row; the blocks' roots are ranked by their block number and
climb in blocks again, then the groups' roots do. On the way down a block's row meets the proof of its root in a
grouping of both, and ``transform`` and ``explode`` turn the nested structs into proofs. No join and no row or
task depends on the size of a group, so a source with a third of all rows is as good as any other.

Defined results: a null value is hashed as ``-``; null is a group of its own, the first one; ties of the order column,
null ids among them (first), are ordered by leaf, so repeated rows are neighbouring equal leaves; empty and very long
texts are hashed whole; a null id is never tampered with; an empty table gives an empty result; columns that are not
named, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.ranking import ranked
from strandweave.session import cut_lineage

FAN = 3
#: Levels in one row: at most 3**5 = 243 leaves.
HEIGHT = 5
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of each value's byte count, a colon and the value, or a minus for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _node_hash(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda c: c["h"]), ""), 256)


def _nested(nodes: DataFrame, group: list[str]) -> DataFrame:
    """``group, _block, _tree`` from ``group, _rank, _node`` with ranks from 0: the digits grouped away within blocks.

    A single node of the whole group is no run: it is passed on with an empty list of children in its place.
    """
    digits = [f"_d{k}" for k in range(HEIGHT)]
    rows = nodes.withColumns({d: F.pmod(F.floor(F.col("_rank") / FAN ** k), F.lit(FAN)).cast("int") for k, d in enumerate(digits)})
    rows = rows.withColumn("_block", F.floor(F.col("_rank") / FAN ** HEIGHT)).drop("_rank")
    rows = rows.withColumnRenamed("_node", "_tree").repartition(*[F.col(c) for c in (*group, "_block")])
    for k, digit in enumerate(digits):
        left = digits[k + 1:]
        rows = rows.groupBy(*group, "_block", *left).agg(F.array_sort(F.collect_list(F.struct(F.col(digit).alias("at"), "_tree"))).alias("_kids"))
        rows = rows.withColumn("_kids", F.transform("_kids", lambda c: c["_tree"]))
        lone = reduce(lambda a, d: a & (F.col(d) == 0), left, (F.size("_kids") == 1) & (F.col("_block") == 0))
        tree = F.struct(F.when(lone, F.col("_kids")[0]["h"]).otherwise(_node_hash(F.col("_kids"))).alias("h"), lone.alias("lone"), F.col("_kids").alias("kids"))
        rows = rows.select(*group, "_block", *left, tree.alias("_tree"))
    return rows


def _siblings(kids: Column, at: Column) -> Column:
    """The hashes before and after child ``at`` of a run, each joined to one text."""
    def joined(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda c: c["h"]), "")

    return F.struct(joined(F.slice(kids, F.lit(1), at)).alias("before"), joined(F.slice(kids, at + 2, F.lit(FAN))).alias("after"))


def _paths(tree: Column, height: int) -> Column:
    """Array of ``(leaf, path)`` of a nested tree; a path lists the siblings level by level from the leaf upwards."""
    if not height:
        none = F.lit(None).cast("array<struct<before:string,after:string>>")
        return F.array(F.struct(tree.alias("leaf"), F.coalesce(none, F.array()).alias("path")))

    def child(c: Column, i: Column) -> Column:
        own = F.when(tree["lone"], F.array()).otherwise(F.array(_siblings(tree["kids"], i)))
        return F.transform(_paths(c, height - 1), lambda x: F.struct(x["leaf"].alias("leaf"), F.concat(x["path"], own).alias("path")))

    return F.flatten(F.transform(tree["kids"], child))


def _meet(blocks: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """Each block's row with the row of ``above`` that has its keys, by grouping both."""
    both = blocks.unionByName(above, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns if c not in keys])


def _climb(nodes: DataFrame, group: list[str], nodes_in_group: int, top) -> DataFrame:
    """``group, _rank, _leaf, _path, _top, _root`` per node; ``top`` finds ``group, _up, _top, _root`` of the groups' roots."""
    blocks = cut_lineage(_nested(nodes, group))
    roots = blocks.select(*group, F.col("_block").alias("_rank"), F.struct(F.col("_tree.h").alias("h")).alias("_node"))
    n_blocks = -(-nodes_in_group // FAN ** HEIGHT)
    if n_blocks <= 1:
        above = top(roots).withColumn("_rank", F.lit(0).cast("bigint"))
    else:
        above = _climb(roots, group, n_blocks, top).select(*group, "_rank", F.col("_path").alias("_up"), "_top", "_root")
    met = _meet(blocks, above.withColumnRenamed("_rank", "_block"), [*group, "_block"])
    rows = met.select(*group, "_block", "_up", "_top", "_root", F.posexplode(_paths(F.col("_tree"), HEIGHT)).alias("_at", "_x"))
    rank = F.col("_block") * FAN ** HEIGHT + F.col("_at")
    return rows.select(*group, rank.alias("_rank"), F.col("_x.leaf").alias("_leaf"), F.concat("_x.path", "_up").alias("_path"), "_top", "_root")


def proofs(leaves: DataFrame, group_col: str, order_col: str, leaf_col: str) -> DataFrame:
    """``leaves`` with ``_path`` (array of the siblings before and after, from the leaf to the root), ``_subroot``
    and ``_root``. Leaves ascend by ``order_col`` within a group, the groups' roots by group."""
    own = leaves.columns
    packed = leaves.select(
        F.col(group_col).alias("_group"), F.col(order_col).alias("_order"), F.col(leaf_col).alias("_h"),
        F.struct(F.col(leaf_col).alias("h"), F.struct(*own).alias("row")).alias("_node"))
    placed = ranked(packed, ["_group"], ["_order", "_h"], "_rank").select("_group", (F.col("_rank") - 1).alias("_rank"), "_node")
    placed = cut_lineage(placed)
    most = (placed.agg(F.max("_rank")).first()[0] or 0) + 1

    def over_groups(subroots: DataFrame) -> DataFrame:
        tops = subroots.select(F.lit(0).alias("_all"), "_group", F.struct(F.col("_node.h").alias("h"), F.col("_group").alias("group")).alias("_node"))
        numbered = cut_lineage(ranked(tops, ["_all"], ["_group"], "_rank").select("_all", (F.col("_rank") - 1).alias("_rank"), "_node"))
        count = (numbered.agg(F.max("_rank")).first()[0] or 0) + 1
        return _climb(numbered, ["_all"], count, single).select(
            F.col("_leaf.group").alias("_group"), F.col("_path").alias("_up"), F.col("_leaf.h").alias("_top"), "_root")

    def single(root: DataFrame) -> DataFrame:
        nothing = F.lit(None).cast("array<struct<before:string,after:string>>")
        return root.select("_all", F.coalesce(nothing, F.array()).alias("_up"), F.col("_node.h").alias("_top"), F.col("_node.h").alias("_root"))

    found = _climb(placed, ["_group"], most, over_groups)
    return found.select("_leaf.row.*", "_path", F.col("_top").alias("_subroot"), "_root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def manifest(docs: DataFrame, tampered: Column, id_col: str = "doc_id", group_col: str = "source", columns: list[str] = COLUMNS) -> DataFrame:
    """Per row: ``<id_col>, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``tampered`` is the text of the copy that is checked against the manifest; its leaf is folded with the siblings of
    the original tree.
    """
    original = [F.col(c) for c in columns]
    copy = [tampered if c == "text" else F.col(c) for c in columns]
    leaves = docs.select(F.col(id_col).alias("_id"), F.col(group_col).alias("_source"), leaf_hash(original).alias("_leaf"), leaf_hash(copy).alias("_copy"))
    found = proofs(leaves, "_source", "_id", "_leaf").withColumn("_folded", folded(F.col("_copy"), F.col("_path")))
    return found.select(
        F.col("_id").alias(id_col), F.col("_leaf").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"),
        proof_digest(F.col("_path")).alias("proof_sha256"), F.col("_folded").alias("folded_root"), (F.col("_folded") == F.col("_root")).alias("verified"))


def without_newlines(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text of a copy that lost its line feeds where the checksum of the id is even."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(even, F.lit(False)), F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
