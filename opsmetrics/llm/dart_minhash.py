"""Near duplicates by DartMinHash (operator 4).

*Weighted sets.* A document is the multiset of its word shingles (``SHINGLE`` words in a row,
white-space separated, lower case; a shorter text is one shingle); a shingle weighs as often as it
occurs. The similarity of two documents is the weighted Jaccard similarity, the sum of the smaller
weights over the sum of the larger ones; for texts without repeated shingles that is the
similarity of their shingle sets.

*Signature.* Each element's weight axis is cut into regions [0,1), [1,2), [2,4), [4,8), ... that are
the same for all documents. Darts are thrown at a region by a Poisson process along the rank axis,
with the region's width as its rate; hashes of (element, region, number of the dart) fix each
dart's rank, its place on the weight axis and its coordinate. A document catches the darts that lie below
its weights, and each coordinate keeps the earliest one. Two documents agree on a coordinate
with a probability equal to their similarity. Only darts with a rank below t / (sum of
weights) are thrown, about k ln k + 3k for any document; where a coordinate is still empty, t is
doubled for that document.

*Banded joining.* Documents with equal multisets are one node. A signature of ``BANDS`` bands of
``ROWS`` coordinates puts a node into one bucket per band. In each bucket one member, picked by
a mask that differs from bucket to bucket, leads, and all others are paired with it: as many pairs
as members, never all pairs. A pair whose signatures agree too little to be similar is dropped.

*Verification.* Pairs are verified on the whole texts: first each node's best pair, then,
of the pairs left, those whose ends are not connected yet; none is skipped by a cap. Links are
pairs with a similarity of ``THRESHOLD`` or more. Classes are their connected components, found by
large-star and small-star steps.

*Exact step.* A link whose ends both differ from their leaders is lost so far. Its ends meet in about
eight of the twenty buckets, and these then hold members that are not connected. All nodes of such
buckets take part in an exact join, whose rows follow the classes rather than their members:

1. The members of a class with about the same total weight are a group; its union takes each shingle with its largest
   weight among them. What two texts share, their groups' unions share at least; so of a link between two groups, where t
   is the threshold, the unions share t / (1 + t) of the lightest members' summed weights or more. Unions are joined by
   prefixes: in an order of the shingles that is the same for all (those of the fewest groups first), a union keeps
   shingles until what follows weighs less than a link needs, and a pair of unions meets in a shingle only if what follows
   it in both weighs enough (the first shingle that they share passes).
2. Of each pair of groups that meets in a shingle one member with that shingle each is verified, and what is linked
   becomes one class.
3. For the pairs still apart that have more members the weight that a group shares with the union of the other's class is summed up; few share
   enough for a link.
4. The members of those are joined by prefixes in the same way: first ``FEW`` of a group for each shingle, which connect most of
   what can be connected, then all members of the groups still apart. All these pairs are verified.

Pairs within a class are never made, and a text outside a large class meets the unions of its groups, not its members.
Lost are only links whose ends share no bucket (3 in 100,000 at a similarity of 0.8, fewer above) or whose signatures
agree on less than ``LEAST_AGREEMENT``.

Hot buckets, sets and shingles are split: minima and counts over a key are taken per (key, salt), then over
the key, and brought back the same way. A text that many others are compared with is sent to ``SALTS`` tasks at most, once each.

Cases: null text counts as empty; texts without words are one class. Rows with equal text share
a class; ids must be unique integers and not null (a null id forms no link and is its own class,
null, and not kept). An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.common import KEPT_CHARS, cut, held, short_batches, stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 20
ROWS = 4
#: Pairs whose signatures agree on a smaller share than this are dropped: 4.5 standard deviations below the threshold.
LEAST_AGREEMENT = 0.6
SALTS = 64
#: Rows that the Parquet reader decodes at a time: its arrays hold that many whole texts.
READ_ROWS = 512
#: Shingles of more groups than this are dealt over ``SALTS`` tasks.
HOT_SHINGLE = 500
#: Members of a class whose total weights differ by this factor at most share a group.
GROUP = 1.02
#: Shingles of a union that as many groups have are cut into so many cells for the weight that follows them.
CELLS = 1024
#: Members of a group that stand for it at first, for each shingle.
FEW = 8

_U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit hashes."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0 ** -53


class WordHashes(dict):
    """64-bit hash of each word, kept in a bounded table."""

    limit = 250_000

    def __missing__(self, word: str) -> int:
        got = xxhash.xxh64_intdigest(word)
        if len(word) <= KEPT_CHARS:
            if len(self) > self.limit:
                self.clear()
            self[word] = got
        return got


def words() -> WordHashes:
    """The worker's table."""
    return held("shingles", WordHashes)


def elements(texts: list[str | None], table: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: number of the text, 64-bit shingle, weight; sorted by text and shingle."""
    split = [(t or "").lower().split() for t in texts]
    for w in split:
        if 0 < len(w) < size:
            w.extend([""] * (size - len(w)))
    lengths = np.array([len(w) for w in split], np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.empty(total + size, np.uint64)
    at = 0
    for w in split:
        h[at:at + len(w)] = np.fromiter(map(table.__getitem__, w), np.uint64, len(w))
        at += len(w)
    shingle = np.zeros(total, np.uint64)
    for k in range(size):
        shingle = mix(shingle + h[k:total + k] * _MULTIPLIERS[k % 5] + _U(k))
    doc = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place <= lengths[doc] - size
    doc, shingle = doc[inside], shingle[inside]
    ends = np.cumsum(np.maximum(lengths - (size - 1), 0)).tolist()
    for a, b in zip([0, *ends], ends):
        shingle[a:b].sort()
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])])
    return doc[first], shingle[first], np.diff(np.r_[first, len(doc)])


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k dart ids; weights may be any positive numbers. Rows of texts without elements are 0."""
    out = np.zeros((n, k), np.uint64)
    if not len(doc):
        return out
    # regions: 0 is [0, 1), region v is [2^(v-1), 2^v); each element has those that begin below its weight
    regions = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    entry = np.repeat(np.arange(len(doc)), regions)
    v = np.arange(len(entry)) - np.repeat(np.cumsum(regions) - regions, regions)
    low = np.where(v == 0, 0.0, 2.0 ** (v - 1.0))
    width = np.where(v == 0, 1.0, low)
    seed = mix(element[entry] ^ (v.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(0x1234567)))
    owner, reach = doc[entry], weight[entry].astype(float)
    sums = np.bincount(doc, weight, n)
    t = k * (math.log(k) + 3)
    todo = np.unique(doc)
    while len(todo):
        limit = np.zeros(n)
        limit[todo] = t / sums[todo]
        on = np.flatnonzero(limit[owner] > 0)
        rank = np.zeros(len(on))
        darts = []
        number = 0
        while len(on):
            number += 1
            h = mix(seed[on] + _U(number * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(unit(h)) / width[on]
            alive = rank < limit[owner[on]]
            on, rank, h = on[alive], rank[alive], h[alive]
            h2 = mix(h ^ _U(0xA0761D6478BD642F))
            hit = low[on] + width[on] * unit(h2) < reach[on] + 1e-12
            darts.append((owner[on[hit]], rank[hit], mix(h2[hit] + _U(0xE7037ED1A0B428DB))))
        o, r, h = (np.concatenate(x) for x in zip(*darts))
        slot = o * k + (h % _U(k)).astype(np.int64)
        least = np.full(n * k, np.inf)
        np.minimum.at(least, slot, r)
        early = np.flatnonzero(r == least[slot])      # one for each coordinate, but for equal ranks
        slot, h = slot[early], h[early]
        order = np.lexsort((h, slot))
        slot, h = slot[order], h[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        filled = np.bincount(slot[first] // k, minlength=n)
        done = filled == k
        take = first[done[slot[first] // k]]
        out.reshape(-1)[slot[take]] = mix(h[take] ^ _U(0x8BB84B93962EACC9))
        todo = todo[~done[todo]]
        t *= 2
    return out


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, two 64-bit hashes of its multiset, one byte of each coordinate, and a hash of each band."""
    k = bands * rows
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        table = words()
        for b in cut(it, size=1_500_000):
            doc, element, weight = elements(b.column("text").to_pylist(), table)
            n = b.num_rows
            sig = dart_signatures(doc, element, weight, n, k)
            pair = element * _U(2) + weight.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
            sums = []
            for c in (0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7):
                h = np.zeros(n, np.uint64)
                np.add.at(h, doc, mix(pair ^ _U(c)))
                sums.append(mix(h).view(np.int64))
            band = np.tile(np.arange(bands, dtype=np.uint64) + _U(1), (n, 1))
            for r in range(rows):
                band = mix(band * _MULTIPLIERS[r % 5] + sig[:, r::rows])
            some = np.bincount(doc, minlength=n) > 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sums[0]), pa.array(sums[1]),
                 pa.array([x.tobytes() if s else None for x, s in zip((sig & _U(255)).astype(np.uint8), some)], pa.binary()),
                 pa.array([x if s else [] for x, s in zip(band.view(np.int64), some)], pa.list_(pa.int64()))],
                names=["doc_id", "set1", "set2", "marks", "bands"])

    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .mapInArrow(run, f"doc_id {key}, set1 bigint, set2 bigint, marks binary, bands array<bigint>"))


def least_of_key(df: DataFrame, keys: list[str], values: dict[str, Column], of: str, least_rows: int = 1) -> DataFrame:
    """Adds the smallest of each value over each key, over keys with ``least_rows`` rows or more (others go).

    Minima are taken per key and salt, then per key, and go back to the rows by key and salt, so
    no task meets all rows of a hot key. ``of``: the column that salts.
    """
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")).repartition(*keys, "_salt")
    part = dealt.groupBy(*keys, "_salt").agg(*[F.min(v).alias(c) for c, v in values.items()], F.count(F.lit(1)).alias("_rows"))
    whole = (part.groupBy(*keys).agg(*[F.min(c).alias(c) for c in values], F.sum("_rows").alias("_all"))
             .filter(F.col("_all") >= least_rows).drop("_all"))
    back = part.select(*keys, "_salt").join(whole, keys)
    return dealt.join(back, [*keys, "_salt"]).drop("_salt")


def led_by(members: DataFrame) -> DataFrame:
    """(bucket, v, lead) of buckets with two members or more; the leader is the smallest id under a mask of the bucket's own."""
    mask = F.xxhash64("bucket", F.lit(0))
    led = least_of_key(members, ["bucket"], {"lead": F.col("v").bitwiseXOR(mask)}, "v", least_rows=2)
    return led.select("bucket", "v", F.col("lead").bitwiseXOR(mask).alias("lead"))


def agreeing(pairs: DataFrame, least: float = LEAST_AGREEMENT) -> DataFrame:
    """Pairs (a, b, marks of both) whose signatures agree enough, with the share of agreeing coordinates."""
    def run(it):
        for b in it:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("marks_a", "marks_b"))
            share = ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)      # bytes agree by chance once in 256
            keep = pa.array(share >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), pa.array(share).filter(keep)],
                                             names=["a", "b", "share"])

    return pairs.select("a", "b", "marks_a", "marks_b").mapInArrow(run, "a bigint, b bigint, share double")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar. ``texts``: (v, text), one row for each node.

    A task gets the text of an ``a`` once, before the texts of its ``b``.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("_salt"))
    others = dealt.join(texts.select(F.col("v").alias("b"), "text"), "b").select("a", "_salt", "b", "text")
    firsts = (dealt.select("a", "_salt").distinct().join(texts.select(F.col("v").alias("a"), "text"), "a")
              .select("a", "_salt", F.lit(None).cast("bigint").alias("b"), "text"))
    rows = (firsts.unionByName(others).repartition("a", "_salt")      # without a number: few texts make few tasks and files
            .sortWithinPartitions("a", "_salt", F.col("b").asc_nulls_first()))

    def run(it):
        table = words()
        first = np.zeros(0, np.uint64), np.zeros(0, np.int64)            # shingles and weights of the last text of an a
        for batch in cut(it, size=1_500_000):
            n = batch.num_rows
            doc, element, weight = elements(batch.column("text").to_pylist(), table)
            total = np.bincount(doc, weight, n)
            begin = np.searchsorted(doc, np.arange(n + 1))
            heads = np.flatnonzero(batch.column("b").is_null().to_numpy(zero_copy_only=False))
            keep = np.zeros(n, bool)
            for head, i, j in zip([-1, *heads.tolist()], [0, *(heads + 1).tolist()], [*heads.tolist(), n]):
                if head >= 0:
                    part = slice(begin[head], begin[head + 1])
                    first = element[part].copy(), weight[part].copy()
                if i < j:
                    part = slice(begin[i], begin[j])
                    both = shared(*first, doc[part] - i, element[part], weight[part], j - i)
                    union = first[1].sum() + total[i:j] - both
                    keep[i:j] = (both >= threshold * union) | (union == 0)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return rows.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint")


def shared(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, others: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """What a text (sorted shingles, weights) shares with each of ``n`` other texts (doc, others, weights)."""
    if not len(element):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(element, others), len(element) - 1)
    return np.bincount(doc, np.where(element[at] == others, np.minimum(weight[at], weights), 0), n)


def open_nodes(led: DataFrame, root: DataFrame) -> DataFrame:
    """(v) of the buckets whose members aren't all connected."""
    open_ = rooted(rooted(led, root, "v"), root, "lead").filter("root_v <> root_lead").select("bucket").distinct()
    return led.join(open_, "bucket", "left_semi").select("v").distinct()


def weighted_sets(texts: DataFrame) -> DataFrame:
    """(v, element, weight, total) of the shingles of texts (v, text)."""
    def run(it):
        table = words()
        for b in cut(it, size=1_000_000):
            doc, element, weight = elements(b.column("text").to_pylist(), table)
            total = np.bincount(doc, weight, b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("v").take(pa.array(doc)), pa.array(element.view(np.int64)), pa.array(weight.astype(np.int64)),
                                              pa.array(total[doc])], names=["v", "element", "weight", "total"])

    return texts.select("v", "text").mapInArrow(run, "v bigint, element bigint, weight bigint, total bigint")


def class_sets(texts: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members' sets (v, g, element, weight, total), and the unions of the groups.

    A group g is the members of a class with about the same total weight, named after its smallest member. Unions: (g, root,
    element, weight, v, groups, left, size, least, most, alone) for each shingle of two classes or more: its
    largest weight, a member that has it, the number of groups that have it, what the group's shingles from its cell on
    weigh, how many rows the group has here, the smallest and largest total weight of its members, and whether there is but one.
    """
    rows = rooted(weighted_sets(texts), root, "v").withColumnRenamed("root_v", "root")
    rows = stored(rows.withColumn("band", F.floor(F.log("total") / math.log(GROUP))), "weighted-sets")
    groups = stored(rows.groupBy("root", "band").agg(F.min("v").alias("g"), F.min("total").alias("least"), F.max("total").alias("most"),
                                                    (F.min("v") == F.max("v")).alias("alone")), "groups")
    members = rows.join(groups.select("root", "band", "g"), ["root", "band"]).select("v", "g", "root", "element", "weight", "total")
    some = F.min(F.struct(F.xxhash64("v", "element").alias("h"), F.col("v").alias("v")))["v"]
    unions = members.groupBy("g", "root", "element").agg(F.max("weight").alias("weight"), some.alias("v"))
    counts = (unions.groupBy("element").agg(F.count(F.lit(1)).alias("groups"), F.min("root").alias("low"), F.max("root").alias("high"))
              .filter("low < high").select("element", "groups"))
    common = unions.join(counts, "element").withColumn("cell", F.pmod(F.xxhash64("element"), F.lit(CELLS)).cast("int"))
    cells = common.groupBy("g", "groups", "cell").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    # one row for each cell that a group has, not for each shingle; from the last shingles of the order up
    after = Window.partitionBy("g").orderBy(F.desc("groups"), F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("g", "groups", "cell", F.sum("w").over(after).alias("left"), F.sum("n").over(Window.partitionBy("g")).alias("size"))
    cells = cells.join(groups.select("g", "least", "most", "alone"), "g")
    unions = common.join(cells, ["g", "groups", "cell"]).drop("cell")
    return members, stored(unions, "unions")


def class_pairs(unions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(small, large, class, need, alone, a, b): pairs of groups of two classes that meet in a shingle of their prefixes, and a member of each that has it.

    ``small`` has fewer shingles; ``class``: that of ``large``; ``need``: what the unions share at least if there is a link between the two;
    ``alone``: both have one member, a and b.
    """
    rows = unions.filter(F.col("left") >= threshold * F.col("least") - 1e-6)
    salts = F.when(F.col("groups") > HOT_SHINGLE, SALTS).otherwise(1)
    heavy = rows.withColumn("salt", F.pmod(F.xxhash64("g"), salts.cast("bigint")).cast("int"))
    light = (rows.filter(F.col("left") >= 2 * threshold / (1 + threshold) * F.col("least") - 1e-6)
             .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))))
    x, y = light.alias("x"), heavy.alias("y")
    need = threshold / (1 + threshold) * (F.col("x.least") + F.col("y.least")) - 1e-6
    on = ((F.col("x.element") == F.col("y.element")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.root") != F.col("y.root"))
          & (F.col("x.least") <= F.col("y.most")) & (F.col("x.most") >= threshold * F.col("y.least") - 1e-6)
          & (F.least("x.left", "y.left") >= need))
    first = F.struct(F.col("x.size"), F.col("x.g")) < F.struct(F.col("y.size"), F.col("y.g"))
    pick = lambda p, q, c: F.when(first, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}"))
    return stored(x.join(y, on).select(pick("x", "y", "g").alias("small"), pick("y", "x", "g").alias("large"), pick("y", "x", "root").alias("class"),
                                       need.alias("need"), (F.col("x.alone") & F.col("y.alone")).alias("alone"), F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct(), "class-pairs")


def sharing_groups(unions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(small, large) of the pairs of groups (small, large, class, need) that share enough for a link."""
    # what a group shares with the union of the other class bounds what it shares with each of that class's groups
    pairs = pairs.select("small", "large", "class", "need").distinct()
    met = pairs.select("small", "class").distinct()
    one = unions.select(F.col("g").alias("small"), "element", F.col("weight").alias("w_small"))
    two = (unions.join(met.select(F.col("class").alias("root")).distinct(), "root", "left_semi").groupBy(F.col("root").alias("class"), "element")
           .agg(F.max("weight").alias("w_large")))
    both = (met.join(one, "small").join(two, ["class", "element"]).groupBy("small", "class")
            .agg(F.sum(F.least("w_small", "w_large")).alias("both")))
    return stored(pairs.join(both, ["small", "class"]).filter("both >= need").select("small", "large"), "groups-left")


def member_prefixes(members: DataFrame, unions: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(v, g, element, total, left): the prefixes of the members of the groups in pairs (small, large)."""
    some = pairs.select(F.explode(F.array("small", "large")).alias("g")).distinct()
    rows = members.join(some, "g", "left_semi").join(unions.select("element", "groups").distinct(), "element")
    after = Window.partitionBy("v").orderBy(F.desc("groups"), F.desc("element")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("left", F.sum("weight").over(after)).filter(F.col("left") >= threshold * F.col("total") - 1e-6)
    return stored(rows.select("v", "g", "element", "total", "left"), "prefixes")


def member_pairs(rows: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, few: int | None = None) -> DataFrame:
    """(a, b) of the pairs of groups (small, large): all pairs of members of the threshold or more among them.

    ``few``: only so many members of a group for each shingle.
    """
    if few:
        one = Window.partitionBy("g", "element").orderBy(F.xxhash64("v", "element"), "v")
        rows = rows.withColumn("number", F.row_number().over(one)).filter(F.col("number") <= few)
    ways = pairs.select(F.col("small").alias("g"), F.col("large").alias("other")).unionByName(
        pairs.select(F.col("large").alias("g"), F.col("small").alias("other")))
    light = rows.filter(F.col("left") >= 2 * threshold / (1 + threshold) * F.col("total") - 1e-6).join(ways, "g")
    x, y = light.alias("x"), rows.alias("y")
    on = ((F.col("x.element") == F.col("y.element")) & (F.col("x.other") == F.col("y.g"))
          & (F.col("x.total") >= threshold * F.col("y.total") - 1e-6)
          & ((F.col("x.total") < F.col("y.total")) | ((F.col("x.total") == F.col("y.total")) & (F.col("x.v") < F.col("y.v"))))
          & (F.least("x.left", "y.left") >= threshold / (1 + threshold) * (F.col("x.total") + F.col("y.total")) - 1e-6))
    return x.join(y, on).select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct()


def prefix_pairs(texts: DataFrame, root: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of different classes: all pairs of texts (v, text) of the threshold or more among them."""
    members, unions = class_sets(texts, root)
    groups = class_pairs(unions, threshold)
    left = sharing_groups(unions, groups.filter("not alone"))
    return groups.select("a", "b").union(member_pairs(member_prefixes(members, unions, left, threshold), left, threshold)).distinct()


def unfinished(edges: DataFrame) -> bool:
    """Whether a node is the larger end of two edges (a, b), or the larger one of an edge and the smaller one of another."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every node in a link (a, b): root is the smallest node connected with v."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while unfinished(edges):
        # large star: every larger neighbour goes to the smallest node around; small star: smaller neighbours and the node itself do
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        edges = stored(small, "edges")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the smallest id of its class) and kept (whether it is that one) of every document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with short_batches(docs.sparkSession, read_rows=READ_ROWS):
        known, root = _classes(docs, threshold, bands, rows)
    out = rooted(known, root, "v").select("doc_id", F.col("root_v").alias("class_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
    blank = docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("class_id"), F.lit(False).alias("kept"))
    return out.unionByName(blank)


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, v) of every document with an id, v being its node, and (v, root) of the linked nodes."""
    sig = stored(signatures(docs, bands, rows), "signatures")
    known = stored(least_of_key(sig.filter("doc_id is not null").select("doc_id", "set1", "set2"), ["set1", "set2"], {"v": F.col("doc_id")}, "doc_id")
                   .select("doc_id", "v"), "nodes")
    nodes = known.filter("doc_id = v").select("v").distinct()
    sig = stored(sig.join(nodes, F.col("doc_id") == F.col("v"), "left_semi").select(F.col("doc_id").alias("v"), "marks", "bands"), "node-signatures")
    led = stored(led_by(sig.select("v", F.explode("bands").alias("bucket"))), "buckets")
    texts = stored(docs.join(led.select(F.col("v").alias("doc_id")).distinct(), "doc_id", "left_semi")
                   .select(F.col("doc_id").alias("v"), "text"), "texts")
    marks = sig.select("v", "marks").filter("marks is not null")
    root = docs.sparkSession.createDataFrame([], "v bigint, root bigint")

    def signed(fresh: DataFrame) -> DataFrame:
        """The pairs that may be similar by their signatures, with the share of agreeing coordinates."""
        return stored(agreeing(fresh.join(marks.select(F.col("v").alias("a"), F.col("marks").alias("marks_a")), "a")
                               .join(marks.select(F.col("v").alias("b"), F.col("marks").alias("marks_b")), "b")), "pairs")

    def apart(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        """The rows whose nodes ``a`` and ``b`` aren't connected yet."""
        return rooted(rooted(pairs, root, a), root, b).filter(F.col(f"root_{a}") != F.col(f"root_{b}")).select(*pairs.columns)

    def link(pairs: DataFrame) -> None:
        nonlocal root
        links = stored(verified(pairs.select("a", "b"), texts, threshold), "links")
        if not links.isEmpty():
            root = joined(root, links)

    first = signed(led.filter("v <> lead").select(F.least("v", "lead").alias("a"), F.greatest("v", "lead").alias("b")).distinct())
    # the best pair of each node, then of the others those that still would connect something
    ends = first.select("share", "a", "b", F.explode(F.array("a", "b")).alias("v"))
    best = ends.groupBy("v").agg(F.max(F.struct("share", F.col("a"), F.col("b"))).alias("p")).select("p.a", "p.b").distinct()
    link(stored(best, "best"))
    link(stored(apart(first), "rest"))

    # the exact step
    members, unions = class_sets(texts.join(open_nodes(led, root), "v", "left_semi"), root)
    groups = class_pairs(unions, threshold)
    link(signed(groups.select("a", "b").distinct()))
    left = sharing_groups(unions, apart(groups.filter("not alone"), "small", "large"))
    rows = member_prefixes(members, unions, left, threshold)
    link(signed(member_pairs(rows, left, threshold, FEW)))
    link(signed(member_pairs(rows, apart(left, "small", "large"), threshold)))
    return known, root


def rooted(df: DataFrame, root: DataFrame, column: str) -> DataFrame:
    """Adds root_<column>: the root of the node in the column, itself where it has no link."""
    r = root.select(F.col("v").alias(column), F.col("root").alias("_root"))
    return df.join(r, column, "left").withColumn(f"root_{column}", F.coalesce("_root", column)).drop("_root")


def joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after new links: components of the roots that the links connect, then one look-up."""
    ends = rooted(rooted(links, root, "a"), root, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    new = components(ends).select(F.col("v").alias("old"), F.col("root").alias("new"))
    moved = root.join(new, root["root"] == new["old"], "left").select("v", F.coalesce("new", "root").alias("root"))
    # roots so far have no row of their own, and new nodes have no old root
    first = new.select(F.col("old").alias("v"), F.col("new").alias("root"))
    return stored(moved.unionByName(first), "roots")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns it had; of rows without an id, one of each text."""
    stay = near_groups(docs).filter("kept").select("doc_id").distinct()
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    named = (docs.alias("d").join(stay.alias("s"), F.col("d.doc_id").cast("bigint") == F.col("s.doc_id"), "left_semi")
             .select(*columns).dropDuplicates(["doc_id"]))
    text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    unnamed = docs.filter("doc_id is null").withColumn("__text_digest", text).dropDuplicates(["__text_digest"]).drop("__text_digest")
    return named.unionByName(unnamed)
