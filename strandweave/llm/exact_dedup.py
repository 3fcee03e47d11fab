"""Exact duplicates by 128-bit content hash, with bytes compared inside every hash group.

Texts are compared after each run of ASCII white space became one space. Aggregation happens in two steps: rows
are grouped by hash *and* text, so two texts that share a hash stay two groups, and copies inside one task are
combined before the shuffle; each distinct text crosses the network once per task that holds it. The second
pass reads the table again and joins only hashes.

Defined results: a null text counts as empty; a null id is no candidate for ``keep_id`` unless the whole group
has none, and is kept only then; repeated rows of the keeper's id are the same document and all stay; an empty
table gives an empty result; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.spread import lookup_join
from strandweave.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    """Text with every run of ASCII white space turned into one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: ``content_hash, text_hash, keep_id, group_size``."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    rows = rows.withColumn("content_hash", F.unhex(F.md5(F.col("_text").cast("binary"))))
    groups = rows.groupBy("content_hash", "_text").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.select("content_hash", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("text_hash"), "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    A group of more than a 10,000th of all rows is looked up by broadcast, the others by a shuffle of hashes.
    """
    groups = cut_lineage(duplicate_groups(docs, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).cast("binary").alias("_text"))
    rows = rows.select("_id", F.unhex(F.md5("_text")).alias("content_hash"), F.unhex(F.sha2("_text", 256)).alias("text_hash"))
    out = lookup_join(rows, groups, ["content_hash", "text_hash"], "group_size", F.xxhash64("_id"))
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("text_hash")).alias("text_sha256"))
