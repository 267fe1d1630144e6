"""Token counts with a whole-token shortcut (operator 3).

Offline, on the driver: every vocabulary string is merged from its byte symbols; the strings
that come back as one token *encode alone*. A pre-token that is such a string counts as one
token without merging; only the rest is merged. The proven set has at most as many entries as
the vocabulary and is shipped once.

Cases: null text counts as empty (0 bytes, 0 tokens); a special string inside a text is one
token, as in the library's default; texts with runs of white space are split by the pattern as
a whole; long texts are counted whole. Repeated rows each get their row; extra columns of the
input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.bpe_trie import Merges, Splitter
from opsmetrics.llm.common import KEPT_CHARS, cut, held


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (spelled in byte symbols) proven to encode alone as one token."""
    m = Merges(path)
    return frozenset(s for s in m.vocab if len(s) == 1 or m.merge(list(s)) == [s])


class PieceCounts(dict):
    """Tokens of each space-separated piece (with the space before it), found when first asked for.

    ``None`` marks a piece whose borders are not pre-token borders: empty, or with white space
    at an end. Starts again when it holds ``limit`` pieces.
    """

    def __init__(self, path: str, whole: frozenset[str], limit: int = 600_000):
        super().__init__()
        self.m = Merges(path)
        self.limit = limit
        self.split = Splitter(path)
        self.whole = whole
        self.special = regex.compile("|".join(map(regex.escape, self.m.special))) if self.m.special else None
        self.words: dict[str, int] = {}

    def word(self, w: str) -> int:
        s = self.m.spell(w)
        if s in self.whole:
            return 1
        n = self.words.get(s)
        if n is None:
            if len(self.words) > self.limit:
                self.words.clear()
            n = len(self.m.merge(list(s))) if len(s) < 200 else long_count(self.m, s)
            if len(s) <= KEPT_CHARS:
                self.words[s] = n
        return n

    def __missing__(self, piece: str):
        if not piece or piece[0].isspace() or piece[-1].isspace():
            n = None
        else:
            n = sum(map(self.word, self.split.piece(piece)))
        if len(piece) <= KEPT_CHARS:
            if len(self) > self.limit:
                self.clear()
            self[piece] = n
        return n

    def run(self, text: str) -> int:
        first, *rest = text.split(" ")
        try:
            if first and not first[0].isspace() and not first[-1].isspace():
                return sum(map(self.word, self.split(first))) + sum(map(self.__getitem__, rest))
        except TypeError:   # a None among the pieces
            pass
        return sum(map(self.word, self.split(text)))

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.run(text)
        n, at = 0, 0
        for m in self.special.finditer(text):
            n, at = n + self.run(text[at:m.start()]) + 1, m.end()
        return n + self.run(text[at:])


def long_count(m: Merges, spelled: str) -> int:
    """Tokens of a long pre-token: merges from a heap over a linked list, in n log n steps."""
    import heapq
    s, n = list(spelled), len(spelled)
    after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
    heap = [(r, k, s[k], s[k + 1]) for k in range(n - 1) if (r := m.rank.get((s[k], s[k + 1]))) is not None]
    heapq.heapify(heap)
    count = n
    while heap:
        _, k, a, b = heapq.heappop(heap)
        j = after[k] if alive[k] else n
        if j >= n or s[k] != a or s[j] != b:
            continue
        s[k] = a + b
        alive[j] = False
        after[k] = after[j]
        if after[j] < n:
            before[after[j]] = k
        count -= 1
        for x, y in ((before[k], k), (k, after[k])):
            if x >= 0 and y < n and (r := m.rank.get((s[x], s[y]))) is not None:
                heapq.heappush(heap, (r, x, s[x], s[y]))
    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        table = held(("counts", path), lambda: PieceCounts(path, whole.value))
        for b in cut(it):
            n = [table.text(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return (out.mapInArrow(run, f"doc_id {key}, n_bytes bigint, n_tokens bigint")
            .withColumn("over_limit", F.col("n_tokens") > limit))
