"""Runs of periodic words by descending-LCP Kruskal (operator 13).

A run is a stretch of words with smallest period q and at least max(``least``, 2q) words that no
neighbouring word extends with that period.

*Suffix classes.* The suffixes of a document that share a prefix of l words form a class; classes grow
as l falls. Suffixes next to each other in sorted order are edges, their common prefix (LCP) is
the edge's weight, and edges are taken from the longest LCP down, as Kruskal's algorithm does for
a spanning tree. A union-find holds the classes, each with its positions in ascending order; the
smaller set is put into the larger one.

*Seeds.* When a union at LCP l makes positions i < j neighbours in the united set and d = j - i <= l,
then the d + l words from i have period d. It is the smallest: one smaller, e, would have put i + e
into the class of i earlier, between i and j. They can't be extended to the right, since l is the whole
common prefix, and are a run unless the word before i equals the one before j; then the run is seeded
further left. Every run is seeded by its first position and the one a period later: nothing
lies between them in their class, by the theorem of Fine and Wilf.

*What needs no class.* A run of ``least`` words or more has l >= least / 2, so edges below that seed nothing, and only
positions whose next least / 2 words occur again in the document take part. They are found
by a hash of those words (a superset; sorting compares the words themselves). Sorting is prefix
doubling, for all documents of an Arrow batch at once, and LCPs come from the ranks of each doubling.

Cases: null and blank texts have no words and no runs. Words are what is left between ASCII white space,
compared as they stand. A text of one word repeated a million times is one class and takes
time n log n. Rows are independent (repeated rows and null ids give a row each); an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import cut
from opsmetrics.llm.dart_minhash import mix

LEAST = 12

Run = tuple[int, int, int]                    # start, length, period

_U = np.uint64


class WordNumbers(dict):
    """A number for each different word."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def repeated(ids: np.ndarray, doc: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """Positions whose next ``size`` words occur again in their document (by a hash: perhaps a few others too)."""
    inside = np.flatnonzero(left >= size)
    if not len(inside):
        return inside
    h = doc.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    padded = np.concatenate([ids, np.zeros(size, ids.dtype)]).astype(np.uint64)
    for k in range(size):
        h = (h ^ padded[k:len(ids) + k]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    h = mix(h)[inside]
    s = np.sort(h)
    again = s[1:][s[1:] == s[:-1]]
    return inside[np.isin(h, again)] if len(again) else inside[:0]


def sorted_suffixes(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all documents in sorted order, and the LCP of each with the one before it.

    ``ids``: words of documents one after the other; ``ends``: the end of the document of each position.
    A suffix stops at its document's end; suffixes of different documents have an LCP of 0.
    """
    n = len(ids)
    # rank 0 is behind the end of a document; words of different documents are different
    _, rank = np.unique(ends.astype(np.int64) * (int(ids.max()) + 1) + ids, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    here = np.arange(n)
    levels, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    longest = int(np.max(ends - here))
    while width < longest:
        ahead = here + width
        second = np.where(ahead < ends, rank[np.minimum(ahead, n - 1)], 0)
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[1, s[1:] != s[:-1]])
        rank, width = fresh, width * 2
        if rank[order[-1]] == n:              # all different: longer prefixes change nothing
            break
        levels.append(rank)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        # a rank stands for 2**t words or what is left of the document; only whole ones count
        fits = (x + 2 ** t <= ends[a]) & (y + 2 ** t <= ends[b])
        same = fits & (levels[t][np.minimum(x, n - 1)] == levels[t][np.minimum(y, n - 1)])
        lcp[same] += 2 ** t
    return order, np.r_[0, lcp]


def kruskal(order: np.ndarray, lcp: np.ndarray, ids: np.ndarray, starts: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Runs as (start, length, period) in positions of ``ids``, from sorted suffixes and their LCPs."""
    at = np.flatnonzero(lcp >= (least + 1) // 2)
    at = at[np.argsort(-lcp[at], kind="stable")]
    left, right, weight = order[at - 1].tolist(), order[at].tolist(), lcp[at].tolist()
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found = []

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def seed(i: int, j: int, common: int) -> None:
        d = j - i
        if d <= common and d + common >= least and (i == starts[i] or ids[i - 1] != ids[j - 1]):
            found.append((i, d + common, d))

    for x, y, common in zip(left, right, weight):
        x, y = root(x), root(y)
        small, large = members.pop(x, None) or [x], members.pop(y, None) or [y]
        if len(small) > len(large):
            x, y, small, large = y, x, large, small
        parent[x] = y
        if len(small) == 1:
            p = small[0]
            k = bisect.bisect(large, p)
            if k:
                seed(large[k - 1], p, common)
            if k < len(large):
                seed(p, large[k], common)
            large.insert(k, p)
        else:
            if 8 * len(small) < len(large):
                for p in small:
                    bisect.insort(large, p)
            else:
                large = sorted(small + large)          # two sorted stretches: merged in linear time
            own = set(small)
            for p in small:
                k = bisect.bisect_left(large, p)
                if k and large[k - 1] not in own:
                    seed(large[k - 1], p, common)
                if k + 1 < len(large) and large[k + 1] not in own:
                    seed(p, large[k + 1], common)
        members[y] = large
    return found


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """The runs of each list of words, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    lengths = np.array([len(w) for w in texts], np.int64)
    total = int(lengths.sum())
    if not total:
        return out
    numbers = WordNumbers()
    ids = np.empty(total, np.int64)
    at = 0
    for w in texts:
        ids[at:at + len(w)] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
        at += len(w)
    doc = np.repeat(np.arange(len(texts)), lengths)
    first = np.cumsum(lengths) - lengths
    left = lengths[doc] - (np.arange(total) - first[doc])
    some = np.unique(doc[repeated(ids, doc, left, (least + 1) // 2)])       # documents that can have a run
    if not len(some):
        return out
    inside = np.zeros(len(texts), bool)
    inside[some] = True
    chosen = np.flatnonzero(inside[doc])
    sub, sub_doc = ids[chosen], doc[chosen]
    sub_first = np.cumsum(lengths[some]) - lengths[some]
    starts = np.repeat(sub_first, lengths[some])
    ends = np.repeat(sub_first + lengths[some], lengths[some])
    order, lcp = sorted_suffixes(sub, ends)
    for start, length, period in kruskal(order, lcp, sub, starts, least):
        out[sub_doc[start]].append((int(start - starts[start]), int(length), int(period)))
    for r in out:
        r.sort(key=lambda x: (x[0], x[2]))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those of a run behind its first period."""
    if not runs:
        return words
    out, at = [], 0
    for start, stop in sorted((s + q, s + n) for s, n, q in runs):
        if start > at:
            out += words[at:start]
        at = max(at, stop)
    return out + words[at:]


def find_runs(docs: DataFrame, least: int = LEAST, change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (start, length and period in words) and collapsed_text of every row; no shuffle.

    ``change`` makes the words that are searched from a row's doc_id and the words of its text.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(it):
        for b in cut(it, size=3_000_000):
            words = [(t or "").encode().split() for t in b.column("text").to_pylist()]
            if change:
                words = [change(i, w) for i, w in zip(b.column("doc_id").to_pylist(), words)]
            found = runs_of(words, least)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            texts = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, found)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, run_type), pa.array(texts, pa.string())],
                                             names=["doc_id", "runs", "collapsed_text"])

    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .mapInArrow(run, f"doc_id {key}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string"))


def made_periodic(doc_id, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by a checksum of the id, goes on from one of its words in a period; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    tenth, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    n = len(words)
    a = tenth % n
    p = 1 + (n - a) // (3 + tenth % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and SHA-256 of all runs and of the collapsed text."""
    found = find_runs(docs, change=made_periodic)
    # the longest run; of equal ones the first, then that of the smallest period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("r"), F.sha2(lines, 256).alias("runs_sha256"),
                       F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    period = -F.col("r.shorter")
    return out.select("doc_id", "n_runs", (-F.col("r.before")).alias("start"), F.col("r.length").alias("length"), period.alias("period"),
                      F.expr("1000 * r.length div -r.shorter").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
