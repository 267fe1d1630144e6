"""Ranked lexical search by per-term geometric blocking (operator 12).

*Scores.* All arithmetic is in 64-bit integers but for a term's weight w = floor(1000 ln((2N + 2) / (2df + 1))).
A term that occurs tf times in a document of n terms adds its impact
w * (10^9 tf div (1000 tf + 20 m)), m = 50 + (50 n N div L); N documents have terms, L in all.

*Vectors.* One pass over the whole texts keeps each document's terms that a query asks for, with
their counts, and n. Documents are then dealt into shards of similar ones: range-partitioned by the signs of
random projections of their impact vectors, with a hash of the row, so equal vectors are spread.

*Blocks.* In a shard each term's posting list is clustered by the similarity of its documents: representatives
from the list itself, every other document to the one with the largest inner product
(of projections). A block stores its documents and a summary, the coordinatewise maximum of their
vectors. Terms are ordered by falling weight (ties by the term); a query finds a document through
the first of its terms that the document holds. So the summary of a block of term t needs the
coordinates from t on, of the queries with t, only, and its sum over a query's terms bounds the score
of all documents that are found through it.

*Skipping.* A first pass scores, in each shard, the documents of each query's blocks with the largest
bounds, up to ``k`` documents or a little more; the k-th best of all of these is a lower limit for the query.
A second pass skips a block only if its bound is below the limit, which proves that none of its
documents is among the k best, and scores all others exactly. Each task keeps k per query; a
window over these ranks the rest.

Queries are taken in blocks of about ``TERMS`` terms, each a pass of its own over the documents, so the
vocabulary that is sent to the tasks is bounded. The driver sees one weight a term and one limit a query.

Cases: a null text has no terms, counts neither in N nor in L, and is never found; queries
without terms, and terms in no document, find nothing; rows with one item_id are one query with the terms of all
of them. Very long texts are one vector. Ties go to the smaller doc_id, null ids last;
repeated rows are ranked each. Empty tables give no rows; extra columns are ignored, whatever their names.
``doc_id`` is an integer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmetrics.llm.common import cut, stored
from opsmetrics.llm.dart_minhash import mix

#: Terms of the queries in one pass over the documents, about.
TERMS = 20_000
#: Postings of a representative's block, about.
BLOCK = 32
#: Documents x terms of a shard in memory.
CELLS = 8_000_000
SHARD = 2048
PROJECTIONS = 32

_U = np.uint64
_LAST = np.iinfo(np.int64).max


def _bytes_table() -> bytes:
    """Term bytes as they are, A-Z lower-cased, all other ASCII to blanks; bytes from 0x80 on belong to terms."""
    out = bytearray(range(256))
    for c in range(128):
        out[c] = ord(chr(c).lower()) if chr(c).isalnum() else 32
    return bytes(out)


_TERM_BYTES = _bytes_table()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order: maximal matches of [0-9A-Za-z] and all that isn't ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_TERM_BYTES).split()


class Questions:
    """A block of queries: their terms by falling weight, and the coordinates that each term's blocks need."""

    def __init__(self, items: dict, df: dict[bytes, int], n: int):
        known = sorted({t for terms in items.values() for t in terms if df.get(t)})
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in known}
        self.terms = sorted(known, key=lambda t: (-weight[t], t))
        self.weight = np.array([weight[t] for t in self.terms], np.int64)
        number = {t: k for k, t in enumerate(self.terms)}
        self.ids = list(items)
        self.asked = [np.array(sorted(number[t] for t in terms if t in number), np.int64) for terms in items.values()]
        coordinates: dict[int, set[int]] = {}
        for q in self.asked:
            for k, t in enumerate(q.tolist()):
                coordinates.setdefault(t, set()).update(q[k:].tolist())
        self.coordinates = {t: np.array(sorted(c), np.int64) for t, c in coordinates.items()}
        #: for each query, each of its terms with the places of the query's further terms in that term's summaries
        self.places = [[(t, np.searchsorted(self.coordinates[t], q[k:])) for k, t in enumerate(q.tolist())] for q in self.asked]


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = 50 + 50 * n * documents // total
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (all terms), and the numbers and counts of the terms of the vocabulary, for every row."""
    number = {t: k for k, t in enumerate(vocabulary)}

    def run(it):
        for b in cut(it, size=4_000_000):
            n, sizes, flat = [], [], []
            for text in b.column("text").to_pylist():
                words = terms_of(text)
                found = [k for w in words if (k := number.get(w)) is not None]
                n.append(len(words))
                sizes.append(len(found))
                flat.append(np.array(found, np.int64))
            row = np.repeat(np.arange(len(sizes)), sizes)
            both, tf = np.unique(row * max(1, len(number)) + np.concatenate(flat), return_counts=True)
            row, term = np.divmod(both, max(1, len(number)))
            ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=["doc_id", "n", "terms", "counts"])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>"))


def directions(terms: int) -> np.ndarray:
    """terms x PROJECTIONS of -1 and 1, the same in every process."""
    h = mix(np.arange(1, terms * PROJECTIONS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    return np.where(h >> _U(63), 1, -1).astype(np.float32).reshape(terms, PROJECTIONS)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each entry, and the entries."""
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def shards(vectors: DataFrame, asked: Questions, numbers: np.ndarray, documents: int, total: int, block: int = BLOCK) -> DataFrame:
    """The index: a row for each shard, with its documents, their vectors, and the blocks of each term.

    ``numbers``: for each term of the vectors its number in ``asked``, or -1.
    """
    n = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    v = len(asked.terms)
    size = max(1, min(SHARD, CELLS // max(1, v)))
    turn = directions(v)

    def sign(it):
        for b in it:
            row, term = _flat(b.column("terms"))
            _, tf = _flat(b.column("counts"))
            term, lengths = numbers[term], b.column("n").to_numpy()
            keep = term >= 0
            row, term, tf = row[keep], term[keep], tf[keep]
            order = np.lexsort((term, row))
            row, term, tf = row[order], term[order], tf[order]
            impact = impacts(asked.weight[term], tf, lengths[row], documents, total)
            sketch = np.zeros((b.num_rows, PROJECTIONS), np.float32)
            for k in range(PROJECTIONS):
                sketch[:, k] = np.bincount(row, impact * turn[term, k], b.num_rows)
            near = (sketch > 0) @ (1 << np.arange(PROJECTIONS - 1, -1, -1, dtype=np.int64))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            some = pa.array(np.diff(ends) > 0)
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(near, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(impact, pa.int64()))], names=["doc_id", "near", "terms", "impacts"])
            yield out.filter(some)

    signed = vectors.mapInArrow(sign, "doc_id bigint, near bigint, terms array<int>, impacts array<bigint>")
    order = ["near", F.xxhash64("doc_id", "near"), "doc_id"]
    dealt = signed.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def build(it):
        for b in it:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                yield pa.RecordBatch.from_pylist([blocked(part, asked, turn, block)], schema=_SHARD_ARROW)

    return dealt.select("doc_id", "terms", "impacts").mapInArrow(build, _SHARD)


_SHARD = ("doc_ids array<bigint>, sizes array<int>, terms array<int>, impacts array<bigint>, "
          "block_terms array<int>, block_sizes array<int>, members array<int>, summaries array<bigint>")
_SHARD_ARROW = pa.schema([(f.split()[0], pa.list_(pa.int64() if "bigint" in f else pa.int32())) for f in _SHARD.split(", ")])


def dense(rows: int, sizes: np.ndarray, terms: np.ndarray, impact: np.ndarray, v: int) -> np.ndarray:
    out = np.zeros((rows, v), np.int64)
    out[np.repeat(np.arange(rows), sizes), terms] = impact
    return out


def blocked(part: pa.RecordBatch, asked: Questions, turn: np.ndarray, block: int) -> dict:
    """One shard: its vectors, and for each term its posting list clustered into blocks with summaries."""
    row, term = _flat(part.column("terms"))
    _, impact = _flat(part.column("impacts"))
    sizes = np.bincount(row, minlength=part.num_rows)
    vector = dense(part.num_rows, sizes, term, impact, len(asked.terms))
    sketch = vector.astype(np.float32) @ turn
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    order = np.argsort(term, kind="stable")
    lists = np.split(row[order], np.flatnonzero(np.diff(term[order])) + 1) if len(term) else []
    block_terms, block_sizes, members, summaries = [], [], [], []
    for t, docs in zip(np.unique(term).tolist(), lists):
        if len(docs) > block:
            nearest = (sketch[docs] @ sketch[docs[::block]].T).argmax(1)
            by = np.argsort(nearest, kind="stable")
            docs, nearest = docs[by], nearest[by]
            starts = np.flatnonzero(np.r_[True, nearest[1:] != nearest[:-1]])
        else:
            starts = np.zeros(1, np.int64)
        summary = np.maximum.reduceat(vector[np.ix_(docs, asked.coordinates[t])], starts, axis=0)
        block_terms += [t] * len(starts)
        block_sizes += np.diff(np.r_[starts, len(docs)]).tolist()
        members.append(docs)
        summaries.append(summary.ravel())
    none = np.zeros(0, np.int64)
    return {"doc_ids": part.column("doc_id").to_pylist(), "sizes": sizes, "terms": term, "impacts": impact, "block_terms": block_terms,
            "block_sizes": block_sizes, "members": np.concatenate(members or [none]), "summaries": np.concatenate(summaries or [none])}


class Shard:
    """A shard read back from the index."""

    def __init__(self, row: int, batch: pa.RecordBatch, asked: Questions):
        def column(name):
            values = batch.column(name)[row].values
            return values.to_numpy(zero_copy_only=False) if name != "doc_ids" else values
        ids = column("doc_ids")
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        sizes = column("sizes")
        self.vector = dense(len(sizes), sizes, column("terms"), column("impacts"), len(asked.terms))
        terms, self.sizes = column("block_terms"), column("block_sizes")
        self.members, summaries = column("members"), column("summaries")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.of: dict[int, tuple[int, np.ndarray]] = {}          # term -> its first block, the summaries of its blocks
        at = 0
        firsts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else []
        for first, count in zip(firsts, np.diff(np.r_[firsts, len(terms)])):
            width = len(asked.coordinates[int(terms[first])])
            self.of[int(terms[first])] = int(first), summaries[at:at + count * width].reshape(count, width)
            at += count * width

    def bounds(self, places: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Blocks through which a query may find documents, and the largest score that each can hold."""
        blocks, bound = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t, place in places:
            if t in self.of:
                first, summary = self.of[t]
                blocks.append(np.arange(first, first + len(summary)))
                bound.append(summary[:, place].sum(axis=1))
        return np.concatenate(blocks), np.concatenate(bound)

    def documents(self, blocks: np.ndarray) -> np.ndarray:
        """The different documents of some blocks."""
        seen = np.zeros(len(self.ids), bool)
        for b in blocks.tolist():
            seen[self.members[self.starts[b]:self.starts[b] + self.sizes[b]]] = True
        return np.flatnonzero(seen)

    def scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        return self.vector[np.ix_(docs, terms)].sum(axis=1)


def pilot(index: DataFrame, asked: Questions, k: int) -> DataFrame:
    """(query, score): for each query some exact scores of different documents, the k best of each task."""
    def run(it):
        best: dict[int, np.ndarray] = {}
        for b in it:
            for row in range(b.num_rows):
                shard = Shard(row, b, asked)
                for q, places in enumerate(asked.places):
                    blocks, bound = shard.bounds(places)
                    if not len(blocks):
                        continue
                    order = np.argsort(-bound, kind="stable")
                    enough = int(np.searchsorted(np.cumsum(shard.sizes[blocks[order]]), k)) + 1
                    got = shard.scores(shard.documents(blocks[order[:enough]]), asked.asked[q])
                    best[q] = np.sort(np.concatenate([best.get(q, got[:0]), got]))[::-1][:k]
        for q, got in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), q), pa.int32()), pa.array(got, pa.int64())], names=["query", "score"])

    return index.mapInArrow(run, "query int, score bigint")


def candidates(index: DataFrame, asked: Questions, limits: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score): every document that may be among the k best of a query; of each task the k best."""
    def run(it):
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in it:
            for row in range(b.num_rows):
                shard = Shard(row, b, asked)
                for q, places in enumerate(asked.places):
                    blocks, bound = shard.bounds(places)
                    docs = shard.documents(blocks[bound >= limits[q]])      # a bound below the limit: proven too low
                    if not len(docs):
                        continue
                    score = shard.scores(docs, asked.asked[q])
                    docs, score = docs[score >= limits[q]], score[score >= limits[q]]
                    new = score, shard.ids[docs], shard.no_id[docs]
                    if q in best:
                        new = tuple(np.concatenate(x) for x in zip(best[q], new))
                    order = np.lexsort((new[1], new[2], -new[0]))[:k]
                    best[q] = tuple(x[order] for x in new)
        for q, (score, ids, no_id) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int32()), pa.array(ids, pa.int64(), mask=no_id), pa.array(score, pa.int64())],
                                             names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query int, doc_id bigint, score bigint")


def asked_terms(queries: DataFrame, id_col: str) -> DataFrame:
    """The id and the different terms of every query."""
    key = queries.schema[id_col].dataType.simpleString()

    def run(it):
        for b in cut(it):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([sorted(set(terms_of(t))) for t in b.column("text").to_pylist()], pa.list_(pa.binary()))],
                                             names=["id", "terms"])

    return (queries.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, f"id {key}, terms array<binary>"))


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "item_id", terms: int = TERMS, block: int = BLOCK) -> DataFrame:
    """id, rank (from 1), doc_id, score of each query's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    asked = stored(asked_terms(queries, id_col), "queries")
    passes = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // terms)
    found = []
    for number in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == number).collect()      # about ``terms`` terms
        items: dict = {}
        for r in rows:
            items.setdefault(r.id, set()).update(bytes(t) for t in r.terms)
        if got := best_of(docs, items, k, block):
            asked_ids, ranked = got
            names = spark.createDataFrame(list(enumerate(asked_ids)), T.StructType([
                T.StructField("query", T.IntegerType()), T.StructField(id_col, queries.schema[id_col].dataType)]))
            found.append(ranked.join(names, "query").select(id_col, "rank", "doc_id", "score"))
    if not found:
        key = queries.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"{id_col} {key}, rank int, doc_id bigint, score bigint")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def best_of(docs: DataFrame, items: dict, k: int, block: int = BLOCK) -> tuple[list, DataFrame] | None:
    """The ids of the queries, and (query, rank, doc_id, score); None if nothing can be found."""
    vocabulary = sorted(set().union(*items.values()))
    if not vocabulary:
        return None
    vector = stored(vectors(docs, vocabulary), "vectors")
    stats = vector.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    documents, total = stats[0], stats[1] or 0
    if not total:
        return None
    counts = vector.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()   # one row a term
    asked = Questions(items, {vocabulary[r.t]: r.df for r in counts}, documents)
    if not asked.terms:
        return None
    number = {t: j for j, t in enumerate(asked.terms)}
    numbers = np.array([number.get(t, -1) for t in vocabulary], np.int64)
    index = stored(shards(vector, asked, numbers, documents, total, block), "shards")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"))
    kth = (pilot(index, asked, k).withColumn("r", F.row_number().over(by_score)).filter(F.col("r") == k)
           .select("query", "score").collect())                                              # one row a query
    limits = np.ones(len(asked.ids), np.int64)
    for r in kth:
        limits[r.query] = max(1, r.score)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = (candidates(index, asked, limits, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
              .select("query", "rank", "doc_id", "score"))
    return asked.ids, ranked
