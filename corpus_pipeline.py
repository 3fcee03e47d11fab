"""Training corpus from the table ``documents`` in five stages.

Every stage reads what its predecessor kept. :func:`run` writes each result to the shared folder of the session and
reads it again, so a lost executor repeats at most one stage's tasks.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows, empty tables and further columns,
whatever their names: a null or empty text is an empty document (one empty line, no words, begin and end id only),
and rows that repeat id and text are one document, which stays or goes as a whole.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import decontaminate, line_dedup, minhash, piece_bpe, quality
from strandweave.session import cut_lineage

#: No SQL: a trained model, a table of merges and an edit distance take part.
ORACLE_SQL = None

#: Columns of the table ``documents``.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_other_columns(stage):
    """A stage that returns its input's columns: those beside :data:`COLUMNS` pass it in one struct, so their names, whatever
    they are, meet none of its own."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        own = [c for c in docs.columns if c in COLUMNS]
        packed = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others"))
        kept = stage(spark, packed, sf_dir)
        return kept.select(*[F.col("_others").getField(c).alias(c) if c in others else F.col(c) for c in docs.columns])

    return run


@with_other_columns
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted to these documents and the known labels, does not reject."""
    scorer, _ = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, scorer, prefix="_").where("_keep").select(*docs.columns)


@with_other_columns
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that at least ten documents share; ``n_chars`` follows the text."""
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10))
    size = F.when(F.col("_n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).select(*docs.columns)


@with_other_columns
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of at least 0.8.

    Rows are dropped by id and text, so a shared id drops no other text; of equal texts without an id one stays.
    """
    found = minhash.near_duplicates(docs, width=5, percent=80, key_col="_copy")
    copies = cut_lineage(found.where(~F.col("kept")).select("_copy").distinct())
    left = docs.join(copies.hint("shuffle_merge"), minhash.row_key() == F.col("_copy"), "left_anti").select(*docs.columns)
    if docs.where("doc_id is null").isEmpty():
        return left
    single = F.col("doc_id").isNull() & F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return left.where(~single).unionByName(left.where(single).dropDuplicates(["text"]))


@with_other_columns
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item within a fifth of its words."""
    found = decontaminate.matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), tolerance=0.2, into="_matches")
    return found.where(F.size("_matches") == 0).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with begin and end id, and whether they decode to the text."""
    rows = piece_bpe.encoded(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), ids_col="ids", decoded_col="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"), "ids")


STAGES = [("quality", keep_good), ("lines", drop_lines), ("near_copies", drop_near_copies), ("leaks", drop_leaks), ("pieces", to_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
