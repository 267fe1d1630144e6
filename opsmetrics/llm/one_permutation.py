"""Document fingerprints by one-permutation MinHash (operator 11).

*Bins.* A document is the set of its word shingles (``SHINGLE`` words in a row, split at ASCII white
space, lower case; a shorter text is one shingle). Each shingle is hashed once; the top bits of
the hash choose one of ``BINS`` bins, and a bin keeps its smallest hash.

*Optimal densification.* An empty bin borrows from the first filled bin in a probing order of its
own, a random permutation of all bins that is the same for all documents. So each filled bin
is as likely as any other, borrowers choose independently, and two documents agree on a bin with a
probability equal to the similarity of their shingle sets, filled or not.

*Packed bits.* ``BITS`` low-order bits of a remixed bin value are stored, ``8 / BITS`` bins a byte. Bins that
differ agree on them by chance with probability c = 2 ** -BITS, so a share s of agreeing
bins stands for a similarity of (s - c) / (1 - c), cut at 0 and 1. With 512 bins of 2 bits
the standard error is 0.03 at a similarity of 0.5 and 0.02 at 0.8.

*The edited copy.* ``edited`` gives each document and the next one in an order of the ids to a
function that makes a new text of the two, and fingerprints all three. Documents are
range-partitioned by id once (ties and null ids by a hash of the text, so that many rows of one
id are spread), and each task walks its sorted rows with one row held back. The last row of a range
waits for the first row of the next one that has any; those, at most two a range, are
joined afterwards. After the last document comes the first.

Cases: null text counts as empty. A text without words has the empty fingerprint; two of them
have a likeness of 1, one and any other text 0. Equal texts have equal fingerprints. Repeated rows give
a row each; rows of one id follow each other by a hash of their text, and null ids come
last. Very long texts take memory in proportion to their length, one Arrow batch at a time. An empty
table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.common import cut, held, stored
from opsmetrics.llm.dart_minhash import WordHashes, mix

SHINGLE = 5
BINS = 512
BITS = 2

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


class Fingerprinter:
    """Packs texts into fingerprints of ``bins`` bins with ``bits`` bits each."""

    def __init__(self, size: int = SHINGLE, bins: int = BINS, bits: int = BITS):
        if bins < 2 or bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8")
        self.size, self.bins, self.bits = size, bins, bits
        self.hashes = WordHashes()
        # the probing order of each bin; the same numbers in every process
        draw = mix(np.arange(1, bins * bins + 1, dtype=np.uint64) * _STEP).reshape(bins, bins)
        self.probe = np.argsort(draw, axis=1, kind="stable").astype(np.int32)

    def shingles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the text and 64-bit hash of every shingle, repeats included."""
        split = [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in texts]
        for w in split:
            if 0 < len(w) < self.size:
                w.extend([b""] * (self.size - len(w)))
        lengths = np.array([len(w) for w in split], np.int64)
        total = int(lengths.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(total + self.size, np.uint64)
        at = 0
        for w in split:
            h[at:at + len(w)] = np.fromiter(map(self.hashes.__getitem__, w), np.uint64, len(w))
            at += len(w)
        out = np.zeros(total, np.uint64)
        for k in range(self.size):
            out = mix((out ^ h[k:total + k]) * _STEP + _U(k))
        doc = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        inside = place <= lengths[doc] - self.size
        return doc[inside], out[inside]

    def minima(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Texts x bins: the smallest hash in each bin (all bits set where there is none), and which are filled."""
        doc, h = self.shingles(texts)
        least = np.full(len(texts) * self.bins, _EMPTY, np.uint64)
        shift = _U(64 - (self.bins.bit_length() - 1))
        np.minimum.at(least, doc * self.bins + (h >> shift).astype(np.int64), h)
        least = least.reshape(len(texts), self.bins)
        return least, least != _EMPTY

    def densified(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The bins with the empty ones filled, and which texts have words."""
        least, filled = self.minima(texts)
        some = filled.any(axis=1)
        row, bin_ = np.nonzero(~filled & some[:, None])
        for attempt in range(self.bins):
            if not len(row):
                break
            source = self.probe[bin_, attempt]
            found = filled[row, source]
            least[row[found], bin_[found]] = least[row[found], source[found]]
            row, bin_ = row[~found], bin_[~found]
        return least, some

    def pack(self, texts: list[str | None]) -> list[bytes]:
        """The fingerprint of each text; empty bytes for a text without words."""
        if not texts:
            return []
        least, some = self.densified(texts)
        # a borrowed value is remixed with the borrower's number, so equal hashes in two bins give unrelated bits
        code = (mix(least ^ (np.arange(self.bins, dtype=np.uint64) * _STEP)) & _U(2 ** self.bits - 1)).astype(np.uint8)
        each = 8 // self.bits
        packed = np.zeros((len(texts), self.bins // each), np.uint8)
        for k in range(each):
            packed |= code[:, k::each] << np.uint8(k * self.bits)
        return [p.tobytes() if s else b"" for p, s in zip(packed, some)]

    def likeness(self, a: bytes, b: bytes) -> float:
        """The similarity that two fingerprints stand for, 0 to 1."""
        if not a or not b:
            return float(a == b)
        differ = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        mask = np.uint8(2 ** self.bits - 1)
        unlike = sum(int(np.count_nonzero((differ >> np.uint8(k * self.bits)) & mask)) for k in range(8 // self.bits))
        chance = 2.0 ** -self.bits
        return min(1.0, max(0.0, (1 - unlike / self.bins - chance) / (1 - chance)))


def worker(size: int, bins: int, bits: int) -> Fingerprinter:
    return held(("one-permutation", size, bins, bits), lambda: Fingerprinter(size, bins, bits))


def fingerprints(docs: DataFrame, size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id and fingerprint (binary) of every row; no shuffle."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        f = worker(size, bins, bits)
        for b in cut(it, size=2_000_000):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f.pack(b.column("text").to_pylist()), pa.binary())],
                                             names=["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {key}, fingerprint binary")


def end_replaced(text: str, following: str) -> str:
    """The last third of the code points, rounded down, replaced by as many first ones of the next text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def edited(docs: DataFrame, edit: Callable[[str, str], str] = end_replaced, size: int = SHINGLE, bins: int = BINS,
           bits: int = BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256 (binary), both fingerprints (binary), near_edited, near_next.

    ``edit`` makes the edited text of a document's text and that of the next document, in descending
    order of the ids.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie")]
    ranged = (docs.select("doc_id", text.alias("text")).withColumn("_tie", F.xxhash64("text"))
              .repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text"))

    result = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    kinds = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
                       ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def judged(f: Fingerprinter, texts: list[str], prints: list[bytes], after: list[str], prints_after: list[bytes]):
        changed = [edit(t, x) for t, x in zip(texts, after)]
        packed = f.pack(changed)
        return [[len(t) for t in texts], [hashlib.sha256(c.encode()).digest() for c in changed], prints, packed,
                [f.likeness(p, e) for p, e in zip(prints, packed)], [f.likeness(p, e) for p, e in zip(prints, prints_after)]]

    def walk(it):
        """Rows with a following one are done; the first and the last of the range leave with their texts."""
        f = worker(size, bins, bits)
        place = TaskContext.get().partitionId()

        def batch(ids, columns, role, texts=None):
            rows = len(ids)
            plain = [pa.array(c, k.type) for c, k in zip(columns, kinds)] if columns else [pa.nulls(rows, k.type) for k in kinds]
            return pa.RecordBatch.from_arrays(
                [ids, *plain, pa.array([role] * rows, pa.string()), pa.array([place] * rows, pa.int32()),
                 pa.array(texts, pa.string()) if texts else pa.nulls(rows, pa.string())],
                names=["doc_id", *kinds.names, "role", "place", "text"])

        kept = None                       # the row held back: id, text, fingerprint
        for b in cut(it, size=2_000_000):
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            prints = f.pack(texts)
            if kept is None:
                yield batch(ids.slice(0, 1), None, "first", texts[:1])
            else:
                ids = pa.concat_arrays([kept[0], ids])
                texts, prints = [kept[1], *texts], [kept[2], *prints]
            kept = ids.slice(len(ids) - 1, 1), texts[-1], prints[-1]
            if len(ids) > 1:
                yield batch(ids.slice(0, len(ids) - 1), judged(f, texts[:-1], prints[:-1], texts[1:], prints[1:]), "done")
        if kept is not None:
            yield batch(kept[0], None, "last", [kept[1]])

    walked = stored(ranged.mapInArrow(walk, f"doc_id {key}, {result}, role string, place int, text string"), "fingerprints")

    def close(it):
        f = worker(size, bins, bits)
        for b in cut(it, size=2_000_000):
            texts, after = b.column("text").to_pylist(), b.column("after").to_pylist()
            columns = judged(f, texts, f.pack(texts), after, f.pack(after))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k.type) for c, k in zip(columns, kinds)]],
                                             names=["doc_id", *kinds.names])

    # one row a range: the range whose first row follows, the lowest one after the highest
    places = walked.filter("role = 'first'").select("place")
    whole = Window.orderBy("place")
    follows = places.select("place", F.coalesce(F.lead("place").over(whole), F.min("place").over(
        whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("follows"))
    first = walked.filter("role = 'first'").select(F.col("place").alias("follows"), F.col("text").alias("after"))
    last = (walked.filter("role = 'last'").select("doc_id", "text", "place").join(follows, "place").join(first, "follows")
            .select("doc_id", "text", "after").mapInArrow(close, f"doc_id {key}, {result}"))
    return walked.filter("role = 'done'").select("doc_id", *kinds.names).unionByName(last)


def edited_strings(docs: DataFrame) -> DataFrame:
    """``edited`` with the binary columns as lowercase hex strings."""
    out = edited(docs)
    for c in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        out = out.withColumn(c, F.lower(F.hex(c)))
    return out
