"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signatures. Two permutations of the 32-bit shingle hashes: the first scatters them, the second is shifted
circularly by one step per coordinate, so all coordinates come from the same two functions. A coordinate is the
minimum over the shingle set, stored with 16 bits; four coordinates are a band.

Classes. Documents with the same shingle set (128-bit digest) form a class; only classes are compared.

Star step. In every band bucket the class with most bucket neighbours is the centre; the others are verified
against it, in groups of bounded size per centre. That finds most links with a linear number of pairs.

Rest step. In buckets whose classes are still in different components, the classes outside the bucket's largest
component meet all others in blocks of at most ``BLOCK`` classes. A pair is looked at in its first common
band only, and verified on the full sets unless its components met meanwhile. So no two classes of a common
bucket stay uncompared unless they are connected already, and no task holds more than two blocks.

A pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.

Defined results: null, empty or white-space-only texts have no shingles and are linked with nothing; rows of one
id with different texts are different documents, of which at most one of a component is kept, and so are rows without
an id, which come after all ids; repeated rows repeat their result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import flat
from strandweave.llm.spread import lookup_join, sieve
from strandweave.operators.pointers import components
from strandweave.session import cut_lineage, ship_code

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
STEP = 0x9E3779B1
#: Partners of a centre in one group, and classes in one block.
GROUP, BLOCK = 64, 512
#: Equal coordinates below which a pair is not verified: 6 standard deviations under the mean at similarity 0.8.
LEAST_EQUAL = 75
LINKS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def _sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, at = flat.words(texts)
    return flat.distinct(*flat.shingles(hashes, at, width))


def _digests(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit digest of each set: two sums of permuted hashes."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full, 0] = np.add.reduceat(flat.mix(values), at[full])
        out[full, 1] = np.add.reduceat(flat.mix(values ^ np.uint64(0xA5A5A5A5DEADBEEF)), at[full])
    return out


def _signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``COORDINATES`` 16-bit minima per set; zeros for an empty set."""
    out = np.zeros((len(at) - 1, COORDINATES), np.uint16)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    scattered = (flat.mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    y, z = np.empty_like(scattered), np.empty_like(scattered)
    for k in range(COORDINATES):
        np.add(scattered, np.uint32(k * STEP & 0xFFFFFFFF), out=y)
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            np.right_shift(y, shift, out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(factor), out=y)
        np.right_shift(y, 16, out=z)
        np.bitwise_xor(y, z, out=y)
        low = np.minimum.reduceat(y, at[full])
        out[full, k] = (flat.mix(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as binary values."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``_doc, _n, _set, _sig`` per document."""
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in flat.chunks([len(t) for t in texts]):
                values, at = _sets(texts[a:b], width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(at)), _fixed(_digests(values, at)), _fixed(_signatures(values, at))],
                    names=["_doc", "_n", "_set", "_sig"])

    kind = rows.schema["_doc"].dataType
    return rows.mapInArrow(flat.trimmed(work), T.StructType([
        T.StructField("_doc", kind), T.StructField("_n", T.LongType()), T.StructField("_set", T.BinaryType()), T.StructField("_sig", T.BinaryType())]))


class _Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> None:
        self.up[self.find(x)] = self.find(y)


def _members(table: pa.Table, width: int) -> dict[bytes, np.ndarray]:
    """Shingle sets of the classes in a group; a text that belongs to another class of the same id is passed over."""
    wanted, found = table.column("_set").to_pylist(), {}
    texts = table.column("_text").to_pylist()
    for a, b in flat.chunks([len(t) for t in texts]):
        values, at = _sets(texts[a:b], width)
        for i, digest in enumerate(_digests(values, at)):
            if digest.tobytes() == wanted[a + i]:
                found[wanted[a + i]] = values[at[i]:at[i + 1]]
    return found


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    same = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _as_links(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})


def _star_links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between each bucket's centre and its other classes. ``members`` is ``_key, _set, _size``."""
    degree = members.groupBy("_set").agg(F.sum("_size").alias("_degree"))
    ranked = members.join(degree, "_set")
    centres = ranked.groupBy("_key").agg(F.max(F.struct("_degree", "_set")).alias("_top"), F.count("*").alias("_size"))
    centres = centres.select("_key", F.col("_top._set").alias("_centre"), "_size")
    pairs = lookup_join(members.select("_key", "_set"), centres, ["_key"], "_size", F.xxhash64("_set"))
    pairs = cut_lineage(pairs.where("_centre <> _set").select("_centre", "_set").distinct())
    counts = pairs.groupBy("_centre").agg(F.count("*").alias("_partners"))
    pairs = lookup_join(pairs, counts.withColumn("_size", F.col("_partners")), ["_centre"], "_size", F.xxhash64("_set"))
    pairs = pairs.select("_centre", F.pmod(F.xxhash64("_set"), F.ceil(F.col("_partners") / GROUP)).alias("_salt"), "_set")
    legs = pairs.unionByName(pairs.select("_centre", "_salt", F.col("_centre").alias("_set")).distinct())
    legs = legs.join(texts.select("_set", "_text").hint("shuffle_merge"), "_set")

    def verify(key, table):
        sets, centre = _members(table, width), key[0].as_py()
        own = sets.get(centre)
        links = [] if own is None else [(centre, s) for s, x in sets.items() if s != centre and _linked(own, x, percent)]
        return _as_links(links)

    return legs.groupBy("_centre", "_salt").applyInArrow(verify, LINKS)


def _rest_links(members: DataFrame, comps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between classes of a common bucket that are in different components. ``comps`` is ``_set, _comp``."""
    placed = members.select("_key", "_set").join(comps, "_set")
    parts = placed.groupBy("_key", "_comp").agg(F.count("*").alias("_n"))
    open_keys = parts.groupBy("_key").agg(
        F.count("*").alias("_parts"), F.sum("_n").alias("_size"), F.max(F.struct("_n", "_comp")).alias("_top")).where("_parts > 1")
    open_keys = open_keys.select("_key", "_size", F.col("_top._comp").alias("_main"), F.col("_top._n").alias("_of_main"))
    placed = lookup_join(placed, open_keys.withColumn("_weight", F.col("_size")), ["_key"], "_weight", F.xxhash64("_set")).where("_size is not null")
    whole = F.col("_size") <= BLOCK
    rest = whole | (F.col("_comp") != F.col("_main"))
    n_rest = F.when(whole, 1).otherwise(F.ceil((F.col("_size") - F.col("_of_main")) / BLOCK))
    n_main = F.when(whole, 0).otherwise(F.ceil(F.col("_of_main") / BLOCK))
    placed = placed.select("_key", "_set", "_comp", rest.alias("_rest"), n_rest.cast("int").alias("_n_rest"), n_main.cast("int").alias("_n_main"))
    h = F.xxhash64("_set", F.lit(7))
    placed = placed.withColumn("_block", F.when(F.col("_rest"), F.pmod(h, F.col("_n_rest"))).otherwise(F.col("_n_rest") + F.pmod(h, F.col("_n_main"))).cast("int"))
    # tasks (i, j): rest block i meets block j >= i, blocks of the largest component follow the rest blocks
    tasks = F.expr("""if(_rest,
        concat(transform(sequence(_block, _n_rest + _n_main - 1), j -> struct(_block AS i, j AS j)),
            if(_block > 0, transform(sequence(0, _block - 1), k -> struct(k AS i, _block AS j)), array())),
        transform(sequence(0, _n_rest - 1), k -> struct(k AS i, _block AS j)))""")
    placed = placed.select("_key", "_set", "_comp", "_block", F.explode(tasks).alias("_task"))
    placed = placed.select("_key", "_set", "_comp", "_block", F.col("_task.i").alias("_i"), F.col("_task.j").alias("_j"))
    placed = placed.join(texts.hint("shuffle_merge"), "_set")

    def verify(key, table):
        band, i, j = key[0].as_py()[0], key[1].as_py(), key[2].as_py()
        sets = _members(table, width)
        rows = {s: k for k, s in enumerate(table.column("_set").to_pylist()) if s in sets}
        comp, block = table.column("_comp").to_pylist(), table.column("_block").to_pylist()
        names = sorted(rows)
        at = [rows[s] for s in names]
        sig = np.frombuffer(b"".join(table.column("_sig").take(at).to_pylist()), np.uint16).reshape(-1, COORDINATES)
        bands = sig.view(np.uint64)
        side = np.array([block[k] for k in at])
        sizes = np.array([len(sets[s]) for s in names])
        joined, links = _Union(), []
        for x in np.flatnonzero(side == i):
            right = np.flatnonzero((side == j) & ((np.arange(len(names)) > x) | (i != j)))
            common = bands[right] == bands[x]
            first = common.any(1) & (common.argmax(1) == band)
            near = 100 * np.minimum(sizes[right], sizes[x]) >= percent * np.maximum(sizes[right], sizes[x])
            right = right[first & near]
            equal = (sig[right] == sig[x]).sum(1)
            order = np.argsort(-equal, kind="stable")
            for y in right[order][equal[order] >= LEAST_EQUAL]:
                a, b = comp[at[x]], comp[at[y]]
                if joined.find(a) != joined.find(b) and _linked(sets[names[x]], sets[names[y]], percent):
                    joined.join(a, b)
                    links.append((names[x], names[y]))
        return _as_links(links)

    return placed.groupBy("_key", "_i", "_j").applyInArrow(verify, LINKS)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Id and digest of the text; never null, ordered by id with null last, different for texts that share an id."""
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("digest"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Per document: ``<id_col>, n_shingles, component_id, kept``, and its :func:`row_key` as ``key_col`` if wanted.

    Documents with ``100 * intersection >= percent * union`` of their sets of ``width``-word shingles are linked;
    ``component_id`` is the smallest id that links lead to.
    """
    ship_code(docs.sparkSession)
    docs = docs.select(row_key(id_col, text_col).alias("_doc"), F.col(text_col).alias("_text"))
    signed = cut_lineage(signatures(docs, width, "_doc", "_text"))
    classes = signed.where("_n > 0").groupBy("_set").agg(
        F.min("_doc").alias("_rep"), F.count("*").alias("_members"), F.first("_sig").alias("_sig"))
    classes = cut_lineage(classes)
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substr(F.col("_sig"), b * 8 + 1, F.lit(8))))
    opened = classes.select("_set", band.alias("_band", "_part"))
    opened = opened.select("_set", F.concat(F.unhex(F.lpad(F.hex("_band"), 2, "0")), "_part").alias("_key"))
    buckets = opened.groupBy("_key").agg(F.count("*").alias("_size")).where("_size > 1")
    members = lookup_join(opened, cut_lineage(buckets).withColumn("_weight", F.col("_size")), ["_key"], "_weight", F.xxhash64("_set"))
    members = cut_lineage(members.where("_size is not null").select("_key", "_set", "_size"))

    wanted = classes.join(members.select("_set").distinct(), "_set", "left_semi").select("_set", "_sig", "_rep")
    wanted = cut_lineage(wanted)
    texts = docs.select(F.col("_doc").alias("_rep"), F.coalesce("_text", F.lit("")).cast("binary").alias("_text"))
    texts = sieve(texts, wanted, "_rep").join(wanted.hint("shuffle_merge"), "_rep").dropDuplicates(["_rep"])
    texts = cut_lineage(texts.select("_set", "_sig", "_text"))

    links = cut_lineage(_star_links(members, texts, width, percent))
    in_buckets = wanted.select("_set")
    comps = cut_lineage(_labelled(in_buckets, links))
    more = cut_lineage(_rest_links(members, comps, texts, width, percent))
    links = links.unionByName(more)
    comps = _labelled(in_buckets, links)

    named = classes.select("_set", "_rep", "_members").join(comps, "_set", "left").withColumn("_comp", F.coalesce("_comp", "_set"))
    first = named.groupBy("_comp").agg(F.min("_rep").alias("_first"), F.count("*").alias("_size"))
    named = lookup_join(named, first, ["_comp"], "_size", F.xxhash64("_set")).select("_set", "_members", "_first")
    out = lookup_join(signed.select("_doc", "_n", "_set"), cut_lineage(named), ["_set"], "_members", F.xxhash64("_doc"))
    component = F.when(F.col("_n") > 0, F.col("_first")).otherwise(F.col("_doc"))
    key = [F.col("_doc").alias(key_col)] if key_col else []
    return out.select(F.col("_doc.id").alias(id_col), F.col("_n").alias("n_shingles"), component["id"].alias("component_id"),
                      (F.col("_doc") == component).alias("kept"), *key)


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``_set, _comp`` of all ``nodes``; a node without links is its own component."""
    found = components(links).select(F.col("node").alias("_set"), F.col("component").alias("_comp"))
    return nodes.join(found, "_set", "left").select("_set", F.coalesce("_comp", "_set").alias("_comp"))
