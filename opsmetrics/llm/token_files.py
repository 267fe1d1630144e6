"""Token ids as files of independent entropy-coded blocks (operator 5).

``write_tokens``: documents are ranged by id, each task sorts its range and encodes the texts
with the tokenizers library; the ids are kept once in the shared folder. Token counts over all
documents, one row for each id of the vocabulary, give the frequency table that all blocks
share. Each block of whole documents, about ``block_tokens`` ids, is then coded by interleaved
range asymmetric numerals (``rans.py``) and written as a row of a Parquet file: shard and block
number, the documents' ids and lengths, and the coded block. Shards and blocks ascend with the
ids of their documents. Spark's commit protocol makes the files whole or absent.

``read_tokens``: blocks decode in parallel, each on its own, checked against their checksums; the
place of a document's first id in the whole corpus follows from the block totals (one row a
block, summed up by shard, and one row a shard over all).

Cases: null text counts as empty and has the end id only; special strings in a text are their
ids; rows of equal id stand next to each other in any order (a null id comes first); an empty
table gives no blocks and no rows; extra columns are ignored, whatever their names. A document is never split, so a block is as long as its
longest document at least.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsmetrics.llm import rans
from opsmetrics.llm.common import cut, stored
from opsmetrics.llm.library_words import words

BLOCK_TOKENS = 1 << 20


def encoded(docs: DataFrame, path: str, end_id: int | None, block_tokens: int = BLOCK_TOKENS,
            id_col: str = "doc_id") -> DataFrame:
    """Rows (shard, block, doc_ids, lengths, ids as 16-bit integers) in ascending id order."""
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType.simpleString()
    kind = pa.int32() if key == "int" else pa.int64() if key == "bigint" else pa.string()
    tail = b"" if end_id is None else int(end_id).to_bytes(2, "little")

    def run(it):
        from pyspark import TaskContext
        shard, block = TaskContext.get().partitionId(), 0
        table = words(path)
        names: list = []
        ids: list[bytes] = []
        held = 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([names], pa.list_(kind)),
                 pa.array([[len(x) // 2 for x in ids]], pa.list_(pa.int64())), pa.array([b"".join(ids)], pa.large_binary())],
                names=["shard", "block", "doc_ids", "lengths", "ids"])

        for b in cut(it):
            for d, x in zip(b.column("id").to_pylist(), table.texts(b.column("text"))):
                names.append(d)
                ids.append(x + tail)
                held += len(ids[-1]) // 2
                if held >= block_tokens:
                    yield row()
                    block, names, ids, held = block + 1, [], [], 0
        if names:
            yield row()

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
              .repartitionByRange(shards, "id").sortWithinPartitions("id"))
    return ranged.mapInArrow(run, f"shard int, block int, doc_ids array<{key}>, lengths array<bigint>, ids binary")


def token_counts(blocks: DataFrame) -> DataFrame:
    """How often each id occurs, over all blocks."""
    def run(it):
        total = np.zeros(65536, np.int64)
        for b in it:
            for x in b.column("ids"):
                total += np.bincount(np.frombuffer(x.as_py(), "<u2"), minlength=65536)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["token", "n"])

    return blocks.select("ids").mapInArrow(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def frequencies(blocks: DataFrame) -> np.ndarray:
    """The shared table; the driver gets one row for each id of the vocabulary at most."""
    rows = token_counts(blocks).collect()
    counts = np.zeros(65536, np.int64)
    for r in rows:
        counts[r.token] = r.n
    return rans.scaled(counts)


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int | None = None,
                 block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id") -> str:
    """Writes the documents' ids below ``out``: ``blocks`` and the ``table`` they share."""
    spark = docs.sparkSession
    blocks = stored(encoded(docs, path, end_id, block_tokens, id_col), "ids", compression="zstd")
    freq = frequencies(blocks)
    seen = np.flatnonzero(freq)
    spark.createDataFrame([(int(k), int(freq[k])) for k in seen], "token int, freq bigint").coalesce(1).write.parquet(f"{out}/table")
    shared = spark.sparkContext.broadcast(freq)
    key = blocks.schema["doc_ids"].dataType.simpleString()

    def run(it):
        t = rans.Tables(shared.value)
        for b in it:
            coded = [rans.encode(np.frombuffer(x.as_py(), "<u2"), t) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "block", "doc_ids", "lengths")), pa.array(coded, pa.large_binary())],
                                             names=["shard", "block", "doc_ids", "lengths", "data"])

    (blocks.mapInArrow(run, f"shard int, block int, doc_ids {key}, lengths array<bigint>, data binary")
     .write.option("compression", "none").parquet(f"{out}/blocks"))
    return out


def _tables(spark: SparkSession, out: str) -> np.ndarray:
    freq = np.zeros(65536, np.int64)
    for r in spark.read.schema("token int, freq bigint").parquet(f"{out}/table").collect():
        freq[r.token] = r.freq
    return freq


def _decoded(spark: SparkSession, out: str, per_doc, column: str, kind: str, arrow) -> DataFrame:
    """Rows (id, shard, block, place in the block, n_tokens, per_doc(ids))."""
    blocks = spark.read.parquet(f"{out}/blocks")
    key = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    shared = spark.sparkContext.broadcast(_tables(spark, out))

    def run(it):
        t = rans.Tables(shared.value)
        for b in it:
            for shard, block, names, lengths, data in zip(*(b.column(c) for c in ("shard", "block", "doc_ids", "lengths", "data"))):
                ids = rans.decode(data.as_py(), t)
                sizes = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(sizes)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array([shard.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()),
                     pa.array(np.arange(n), pa.int32()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array([per_doc(ids[e - s:e]) for s, e in zip(sizes, ends)], arrow)],
                    names=["id", "shard", "block", "place", "inner", "n_tokens", column])

    return blocks.mapInArrow(run, f"id {key}, shard int, block int, place int, inner bigint, n_tokens bigint, {column} {kind}")


def _bases(spark: SparkSession, out: str) -> DataFrame:
    """Ids before each block: sums over the blocks of a shard, and over the shards."""
    sums = (spark.read.parquet(f"{out}/blocks").select("shard", "block", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inner = sums.withColumn("within", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).drop("n")
    return inner.join(before, "shard").select("shard", "block", (F.col("within") + F.col("before")).alias("base"))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """id, start, n_tokens, ids array<int> of each document, from the files."""
    rows = _decoded(spark, out, lambda x: x.astype(np.int32), "ids", "array<int>", pa.list_(pa.int32()))
    return (rows.join(_bases(spark, out), ["shard", "block"])
            .select("id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids"))


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """id, start, n_tokens and the CRC-32 of the ids as 32-bit integers, from the files."""
    rows = _decoded(spark, out, lambda x: zlib.crc32(x.astype("<u4").tobytes()), "ids_crc32", "bigint", pa.int64())
    return (rows.join(_bases(spark, out), ["shard", "block"])
            .select("id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"))
