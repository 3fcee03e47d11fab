"""Token-id files of patched frame-of-reference blocks.

Documents are range-partitioned by id; each partition is a shard and writes segments of up to ``SEGMENT`` ids (or
one longer document) as Parquet rows: ``shard, segment, start, n, docs, sizes, block_starts, payload``. The payload
is a sequence of blocks of up to ``BLOCK`` ids, and ``block_starts`` indexes their first bytes. A block is

    base uint32 | count uint16 | width uint8 | wide uint8 | exceptions uint16 | low bits | positions | high bits

with the ids minus ``base`` packed at the width that holds ``PERCENTILE`` percent of them; of the others the low
bits are packed with the rest, and position and high bits (uint16, or uint32 if ``wide``) are listed. A second
table gives the first global position of each shard, so any id is found from its position by two lookups.

Tasks write through Spark's committer; a lost executor's tasks run again and give the same shard.

Defined results: a null or empty text is the end id alone; rows of one id are ordered by their text, a null id
comes first; repeated rows are documents of their own; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import flat, pieces
from strandweave.session import ship_code

BLOCK, SEGMENT, PERCENTILE = 4096, 1 << 16, 90
_HEADER = np.dtype([("base", "<u4"), ("count", "<u2"), ("width", "u1"), ("wide", "u1"), ("exceptions", "<u2")])


def pack_block(ids: np.ndarray) -> bytes:
    base = int(ids.min())
    rest = (ids - base).astype(np.uint32)
    width = int(np.partition(rest, k := (len(rest) - 1) * PERCENTILE // 100)[k]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    high = rest[over] >> np.uint32(width)
    wide = bool(len(high) and high.max() >= 1 << 16)
    head = np.array([(base, len(ids), width, wide, len(over))], _HEADER)
    bits = (rest[:, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    return b"".join((head.tobytes(), np.packbits(bits).tobytes(), over.astype("<u2").tobytes(), high.astype("<u4" if wide else "<u2").tobytes()))


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    head = np.frombuffer(data, _HEADER, 1, at)[0]
    count, width, over, kind = int(head["count"]), int(head["width"]), int(head["exceptions"]), "<u4" if head["wide"] else "<u2"
    at += _HEADER.itemsize
    packed = (count * width + 7) // 8
    out = np.zeros(count, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, packed, at), count=count * width).reshape(count, width)
        padded = np.zeros((count, 32), np.uint8)
        padded[:, :width] = bits
        out = np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel().copy()
    at += packed
    where = np.frombuffer(data, "<u2", over, at)
    out[where] |= np.frombuffer(data, kind, over, at + 2 * over).astype(np.uint32) << np.uint32(width)
    return out + head["base"]


def pack(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Payload and the first byte of each block."""
    blocks = [pack_block(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    return b"".join(blocks), flat.offsets_of([len(b) for b in blocks])[:-1].tolist()


def unpack(payload: bytes, block_starts: list[int]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *[unpack_block(payload, at) for at in block_starts]])


def _schema(id_type: T.DataType) -> T.StructType:
    long, array = T.LongType(), T.ArrayType
    return T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("segment", long), T.StructField("start", long), T.StructField("n", long),
        T.StructField("docs", array(id_type)), T.StructField("sizes", array(long)),
        T.StructField("block_starts", array(T.IntegerType())), T.StructField("payload", T.BinaryType())])


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``path/segments`` and ``path/shards``. Each document is followed by ``end_id``."""
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.repartitionByRange("_doc", F.xxhash64("_text")).sortWithinPartitions("_doc", "_text")
    schema = _schema(rows.schema["_doc"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard, segment, position = pieces.tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names = batch.column(0)
            for a, b in flat.chunks([len(t) for t in texts]):
                ids, at = tok.encode(texts[a:b])
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                first = 0
                while first < b - a:
                    last = max(first + 1, int(np.searchsorted(at, at[first] + SEGMENT, "right")) - 1)
                    payload, starts = pack(ids[at[first]:at[last]])
                    n = int(at[last] - at[first])
                    sizes = np.diff(at[first:last + 1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard], pa.int32()), pa.array([segment], pa.int64()), pa.array([position], pa.int64()), pa.array([n], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), names.slice(a + first, last - first)),
                        pa.array([sizes], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int32())), pa.array([payload], pa.binary())],
                        names=schema.names)
                    first, segment, position = last, segment + 1, position + n

    rows.mapInArrow(flat.trimmed(work), schema).write.parquet(f"{path}/segments")
    shards = spark.read.schema(schema).parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards.select("shard", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).write.parquet(f"{path}/shards")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with the global position of their first id in ``start``."""
    shards = spark.read.parquet(f"{path}/shards").select("shard", "first")
    segments = spark.read.parquet(f"{path}/segments").join(F.broadcast(shards), "shard")  # one row per written file
    return segments.withColumn("start", F.col("start") + F.col("first")).drop("first")


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: ``<id_col>, start, n_tokens, ids_crc32``."""
    ship_code(spark)
    rows = read_segments(spark, path).select("start", "docs", "sizes", "block_starts", "payload")
    kind = rows.schema["docs"].dataType.elementType
    long = T.LongType()
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("start", long), T.StructField("n_tokens", long), T.StructField("ids_crc32", long)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, sizes = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                ids = unpack(batch.column(4)[i].as_py(), batch.column(3)[i].as_py()).astype("<u4")
                at = flat.offsets_of(sizes)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[i].values, pa.array(start + at[:-1]), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return rows.mapInArrow(flat.trimmed(work), schema)


def read_ids(spark: SparkSession, path: str, start: int, stop: int) -> list[int]:
    """Ids of the global positions ``start .. stop``; only the blocks that hold them are unpacked."""
    out: list[int] = []
    rows = read_segments(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n") > start)).orderBy("start")
    for row in rows.select("start", "n", "block_starts", "payload").toLocalIterator():
        lo, hi = max(start - row.start, 0), min(stop - row.start, row.n)
        first = lo // BLOCK
        blocks = row.block_starts[first:(hi - 1) // BLOCK + 1]
        out += unpack(row.payload, blocks)[lo - first * BLOCK:hi - first * BLOCK].tolist()
    return out
