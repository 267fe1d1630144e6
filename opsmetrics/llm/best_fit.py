"""Best-fit packing of documents into sequences of bounded length (operator 1).

Documents are encoded with a tokenizer of the tokenizers library, an end id is added, and only
a document longer than the capacity is cut, into full pieces and a last shorter one. Packing is
bulk-synchronous best-fit:

1. *Range-sort.* Pieces and gaps are sorted by length. Pieces of equal length are
   interchangeable, and so are equal gaps, so both sorted lists are kept run-length coded: one
   run for each length, at most ``capacity`` runs however many documents there are. Spark counts
   the runs (a partial count in each task) and ranks the pieces inside a run: by a hash bucket
   and a place in it, with the bucket totals as offsets, so a length that a third of all
   documents share is ranked by many tasks.
2. *Successor sweep.* A round takes a band of lengths, the longest left down to 1 / ``BAND`` less, and all gaps.
   One ascending pass over both lists: each gap, the smallest first, takes the longest piece of the band that fits and is free.
3. *Conflicts by rank.* Where more pieces than gaps compete, or more gaps than pieces, the first
   ranks get the first gaps; the rest stay for the next gap or the next round.
4. *Update.* Taken gaps shrink and take part in the next round. Pieces longer than any gap open new
   sequences, as many as their volume needs. A band is swept until it is placed, then comes the next one.

The rounds yield placements of whole rank ranges (length, first rank, count, first sequence,
offset). Every piece finds its own by a join on its length and a block of ranks; the placements
of large ranges are cut into such blocks first, so no key of the join has more pieces than a block.

Cases: null text counts as empty, so the document is its end id alone (without an end id an
empty document has no piece); ties in length are broken by rank only; repeated rows are packed
each; an empty table gives no sequence; extra columns are ignored, whatever their names. ``doc_id`` is any type that can be hashed and sorted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.common import cut, short_batches, stored
from opsmetrics.llm.library_words import words

CAPACITY = 2048
#: A round's lengths differ by this part of the longest at most: of wider bands short pieces take gaps that longer ones would fill.
BAND = 32
#: Ranks in one block of the placement join.
RANK_BLOCK = 512
#: Bytes of text encoded at a time: workers that ran earlier steps have little room left.
BATCH_BYTES = 1_000_000
#: Rows that the Parquet reader decodes at a time: its arrays hold that many whole texts.
READ_ROWS = 512
#: Entries of a worker's table of words and pieces (about 130 bytes each).
TABLE_WORDS = 600_000


def token_pieces(docs: DataFrame, path: str, end_id: int | None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every piece."""
    key = docs.schema["doc_id"].dataType.simpleString()
    tail = b"" if end_id is None else int(end_id).to_bytes(2, "little")

    def run(it):
        for b in cut(it, size=BATCH_BYTES):
            table = words(path, limit=TABLE_WORDS, word_limit=TABLE_WORDS)
            names, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, x in enumerate(table.texts(b.column("text"))):
                ids = np.frombuffer(x + tail, "<u2").astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    names.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [b.column("doc_id").take(pa.array(names, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            titles = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                titles.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=titles)

    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .mapInArrow(run, f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids))


class Layout:
    """Placements so far: whole rank ranges of equal pieces in whole ranges of equal sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {size: n for size, n in counts.items() if n}
        if self.left and not (1 <= min(self.left) and max(self.left) <= capacity):
            raise ValueError("a length is outside 1..capacity")
        self.capacity = capacity
        self.rank = dict.fromkeys(self.left, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}       # free space -> [(first sequence, how many)]
        self.placed: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def put(self, size: int, n: int, first: int, space: int, to: dict) -> None:
        """The next ``n`` pieces of a size, one into each of the sequences from ``first`` that have ``space`` left."""
        self.placed.append((size, self.rank[size], n, first, self.capacity - space))
        self.rank[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
        if space > size:
            to.setdefault(space - size, []).append((first, n))

    def open_new(self, size: int, n: int) -> None:
        self.put(size, n, self.sequences, self.capacity, self.gaps)
        self.sequences += n


def sweep(x: Layout, low: int) -> None:
    """One pass upwards over the pieces and gaps from length ``low`` on: every gap takes at most one piece, the longest that fits and is free."""
    after = {space: ranges for space, ranges in x.gaps.items() if space < low}
    waiting: list[int] = []                                # the lengths passed and not used up
    for size in sorted(s for s in {*x.left, *x.gaps} if s >= low):
        if size in x.left:
            waiting.append(size)
        for first, n in x.gaps.get(size, ()):
            while n and waiting:
                k = min(n, x.left[waiting[-1]])
                x.put(waiting[-1], k, first, size, after)
                if waiting[-1] not in x.left:
                    waiting.pop()
                first, n = first + k, n - k
            if n:
                after.setdefault(size, []).append((first, n))
    x.gaps = after


def rounds(counts: dict[int, int], capacity: int, band: int = BAND) -> Layout:
    """All rounds: bands of lengths from the longest down, sweeps over each until it is placed."""
    x = Layout(counts, capacity)
    while x.left:
        low = max(x.left) - max(x.left) // band
        while x.left and max(x.left) >= low:
            sweep(x, low)
            # pieces longer than any gap open new sequences: each its own if no two fit together, else as many as their volume needs
            stuck = sorted((s for s in x.left if s >= low and s > max(x.gaps, default=0)), reverse=True)
            room = -(-sum(s * x.left[s] for s in stuck) // capacity)
            for s in stuck:
                n = x.left[s] if 2 * s > capacity else min(room, x.left[s])
                if n > 0:
                    x.open_new(s, n)
                    room -= n
    return x


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, first rank, count, first sequence, offset) and the number of sequences.

    ``counts``: pieces of each length from 1 to ``capacity``. Works on runs only: its cost depends
    on the number of different lengths, not on the number of pieces.
    """
    x = rounds(counts, capacity)
    return x.placed, x.sequences


def place(pieces: DataFrame, capacity: int = CAPACITY, block: int = RANK_BLOCK) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, length, ...); lengths 1..capacity.

    ``pieces`` is read several times: a stored table or something as cheap.
    """
    spark = pieces.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "_bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("_before"))
    counts = {int(r.length): int(r.n) for r in keyed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}   # at most capacity rows
    placed, _ = plan(counts, capacity)

    placements = spark.createDataFrame(placed or [(0, 0, 0, 0, 0)], "_length bigint, _first bigint, _count bigint, _sequence bigint, _offset bigint")
    placements = placements.filter("_count > 0").withColumn("_block", F.explode(F.sequence(
        F.floor(F.col("_first") / block), F.floor((F.col("_first") + F.col("_count") - 1) / block))))
    inner = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")).cast("bigint")
    ranked = (keyed.withColumn("_inner", inner).join(before, ["length", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_inner") - 1))
    found = ranked.join(placements, (F.col("length") == F.col("_length")) & (F.floor(F.col("_rank") / block) == F.col("_block"))
                        & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count")))
    return found.select(*pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"),
                        F.col("_offset").alias("offset"))


def pack(docs: DataFrame, path: str, end_id: int | None = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    with short_batches(docs.sparkSession, read_rows=READ_ROWS):
        pieces = stored(token_pieces(docs, path, end_id, capacity), "pieces")
    return place(pieces, capacity)


def sequences(docs: DataFrame, path: str, end_id: int | None = 0, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences: sequence_id, their ids, and the spans (doc_id, piece, offset, length) in them."""
    with short_batches(docs.sparkSession, read_rows=READ_ROWS):
        pieces = stored(token_pieces(docs, path, end_id, capacity, with_ids=True), "pieces")
    where = place(pieces.drop("ids"), capacity)
    spans = where.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    one = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return (spans.groupBy("sequence_id").agg(one.alias("s"))
            .select("sequence_id", F.flatten("s.ids").alias("ids"),
                    F.transform("s", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"),
                                                        x["offset"].alias("offset"), x["length"].alias("length"))).alias("spans")))
