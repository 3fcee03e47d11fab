"""Lines that repeat across documents, found by range-partitioned hashes and returned as keep bitmaps.

1. Counting: every document gives each of its line keys once, as a 64-bit hash; counts are combined before the
   shuffle. Hashes of at least ``min_docs`` documents are folded into at most 2**20 buckets with their counts, a
   table of bounded size that is broadcast. Lines outside these buckets cannot repeat often enough.
2. Streaming: the other lines are range-partitioned by (128-bit key, slot) and sorted by document and position
   inside. A slot is a share of the documents, chosen so that no key has more than about ``SLOT_ROWS`` lines in one
   slot; each slot is streamed once, marking where a document first shows the key.
3. Decision: slot counts are added up per key, and the (key, slot) pairs that are to go meet the streamed lines
   again, so a very common line is never in one task.
4. Bitmaps: positions to drop become 64-bit words per document; words without a drop are left out.

The 64-bit hash of step 1 only selects candidates (by full lower-casing, which joins at least what A-Z
lower-casing joins); step 3 counts 128-bit hashes of the exact keys.

Defined results: a null or empty text is one empty line; rows that share id and text are one document for the
bitmap but count one by one; rows that share the id only are told apart by their text; a null id is an id; an
empty table gives empty tables; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 1 << 20
SLOT_ROWS = 2_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def line_key(line: Column) -> Column:
    """128-bit hash of the line's key: stripped, A-Z lower-cased."""
    return F.unhex(F.md5(F.translate(stripped(line), UPPER, LOWER).cast("binary")))


def _coarse(line: Column) -> Column:
    return F.xxhash64(F.lower(stripped(line)))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_of"), lines_of(F.col(text_col)).alias("_lines"))


def _candidate_buckets(docs: DataFrame, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """``(_bucket, _rows)``: buckets that hold a hash of enough documents, with the documents of such hashes."""
    lines = F.filter(lines_of(F.col(text_col)), lambda x: F.length(stripped(x)) >= min_chars)
    hashes = docs.select(F.explode(F.array_distinct(F.transform(lines, _coarse))).alias("_hash"))
    common = hashes.groupBy("_hash").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs)
    return common.groupBy(F.pmod("_hash", F.lit(BUCKETS)).alias("_bucket")).agg(F.sum("_n").alias("_rows"))


def repeated_lines(docs: DataFrame, min_docs: int, keep_first: bool, id_col: str, text_col: str, min_chars: int = 1) -> DataFrame:
    """``(_doc, _of, _pos)`` of the lines to drop."""
    buckets = cut_lineage(_candidate_buckets(docs, text_col, min_docs, min_chars))
    lines = _identified(docs, id_col, text_col).select("_doc", "_of", F.posexplode("_lines").alias("_pos", "_line"))
    lines = lines.where(F.length(stripped(F.col("_line"))) >= min_chars)
    lines = lines.withColumn("_bucket", F.pmod(_coarse(F.col("_line")), F.lit(BUCKETS))).join(F.broadcast(buckets), "_bucket")
    slots = F.ceil(F.col("_rows") / SLOT_ROWS)
    lines = lines.select(line_key(F.col("_line")).alias("_key"), F.pmod(F.xxhash64("_doc", "_of"), slots).alias("_slot"), "_doc", "_of", "_pos")

    order = Window.partitionBy("_key", "_slot").orderBy("_doc", "_of", "_pos")
    ranged = lines.repartitionByRange("_key", "_slot")
    # two rows of the same id and text show a position twice: each is a document of its own
    again = F.lag("_doc").over(order).eqNullSafe(F.col("_doc")) & (F.lag("_of").over(order) == F.col("_of")) & (F.lag("_pos").over(order) != F.col("_pos"))
    streamed = cut_lineage(ranged.withColumn("_new", F.when(again, 0).otherwise(1)))

    slots = streamed.groupBy("_key", "_slot").agg(F.sum("_new").alias("_docs"), F.min(F.struct("_doc", "_of", "_pos")).alias("_head"))
    key = Window.partitionBy("_key")
    slots = slots.withColumn("_docs", F.sum("_docs").over(key)).withColumn("_head", F.min("_head").over(key)).where(F.col("_docs") >= min_docs)
    hit = streamed.join(slots, ["_key", "_slot"])
    if keep_first:
        hit = hit.where(~F.struct("_doc", "_of", "_pos").eqNullSafe(F.col("_head")))
    return hit.select("_doc", "_of", "_pos")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bitmaps of documents that lose lines: ``_doc, _of, words`` with ``words`` an array of (word, bits).

    Bit ``i % 64`` of word ``i / 64`` is set if line ``i`` goes; a word without a set bit is not stored, and a
    document without a row keeps everything. Lines whose key is in at least ``min_docs`` documents go, with
    ``keep_first`` all but the first in order of document and position.
    """
    drop = repeated_lines(docs, min_docs, keep_first, id_col, text_col, min_chars)
    bit = F.expr("shiftleft(1L, _pos % 64)")
    words = drop.groupBy("_doc", "_of", F.expr("_pos div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("_doc", "_of").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept text in ``text_col``, plus ``_n_lines`` and ``_n_dropped``."""
    rows = docs.withColumns({"_doc_key": F.col(id_col), "_of_key": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    bitmaps = bitmaps.withColumnRenamed("words", "_bits").hint("shuffle_merge")  # they grow with the documents: never a broadcast
    met = rows.join(bitmaps, rows["_doc_key"].eqNullSafe(bitmaps["_doc"]) & (rows["_of_key"] == bitmaps["_of"]), "left")
    bits = F.map_from_entries(F.col("_bits"))
    kept = F.filter(lines_of(F.col(text_col)), lambda x, i: F.coalesce(
        F.call_function("getbit", bits[F.floor(i / 64).cast("bigint")], (i % 64).cast("int")), F.lit(0)) == 0)
    dropped = F.coalesce(F.aggregate("_bits", F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w["bits"])), F.lit(0).cast("bigint"))
    met = met.withColumns({"_n_lines": F.size(lines_of(F.col(text_col))).cast("bigint"), "_n_dropped": dropped})
    met = met.withColumn(text_col, F.when(F.col("_n_dropped") == 0, F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    return met.select(*docs.columns, "_n_lines", "_n_dropped")
