"""Ranked search against a scorer over all documents."""

import math
import random
import re
from collections import Counter

import pytest

from opsmetrics.llm import geometric_search as G
from util import ODD, documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k=50):
    docs = [(i, Counter(split(t))) for i, t, *_ in rows]
    some = [(i, c, sum(c.values())) for i, c in docs if c]
    total, n_docs = sum(n for *_, n in some), len(some)
    df = Counter(t for _, c, _ in some for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in some:
            m = 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i))
        scored.sort(key=lambda x: (x[0], x[1] is None, x[1] or 0))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    return [(i, " ".join(words[min(399, int(r.paretovariate(0.7)))] for _ in range(r.randrange(0, 80))), "en") for i in range(n)]


@pytest.fixture(scope="module")
def items(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id bigint, text string").selectExpr("*", "'x' as query", "1 as score", "2 as doc_id")
    return make


def check(spark, items, rows, asked, k=50, **options):
    got = G.search(documents(spark, rows, clash=("n", "terms", "near", "query", "score")), items(asked), k, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, asked, k)


def test_matches_brute_force(spark, items):
    rows = corpus(1, 700)
    asked = [(i, rows[i * 7][1][:90] + " W3, w1") for i in range(40)]
    check(spark, items, rows, asked)
    check(spark, items, rows, asked, k=3, block=4)


def test_several_passes_and_small_shards(spark, items, monkeypatch):
    rows = corpus(2, 300)
    asked = [(i, rows[i * 3][1][:120]) for i in range(30)]
    monkeypatch.setattr(G, "SHARD", 40)
    check(spark, items, rows, asked, k=5, terms=50)


def test_a_third_equal_rows_and_ties(spark, items):
    rows = corpus(3, 200) + [(1000 + i, "w1 w2 w3 rare word", "en") for i in range(150)]
    check(spark, items, rows, [(1, "rare w2"), (2, "word"), (3, "w0 w1 w2 w3 w4")], k=50)


def test_odd_rows(spark, items):
    rows = ODD + [(None, "one two", "en"), (16, "Éa éa ÉA one", "en"), (17, "one", "en"), (17, "one", "en")]
    asked = [(1, "ONE <|endoftext|> 漢字"), (1, "éa"), (2, None), (3, ""), (4, "nothing of this kind"), (5, "x" * 30000), (6, "a_b1c"), (None, "word")]
    check(spark, items, rows, asked)
    check(spark, items, [], asked)
    check(spark, items, rows, [])
    check(spark, items, [(1, None, "en"), (2, " ", "en")], asked)


def test_blocks_are_skipped_and_bounds_hold(spark):
    """Summaries bound every score; most blocks of a selective query are skipped."""
    rows = corpus(4, 900)
    asked = [(0, "w350 w377 w1 w2"), (1, rows[11][1])]
    docs = documents(spark, rows)
    vocabulary = sorted({t for _, text in asked for t in G.terms_of(text)})
    vector = G.vectors(docs, vocabulary).persist()
    documents_, total = vector.filter("n > 0").count(), vector.agg({"n": "sum"}).first()[0]
    df = Counter(vocabulary[t] for r in vector.collect() for t in r.terms)
    q = G.Questions({i: set(G.terms_of(t)) for i, t in asked}, df, documents_)
    number = {t: j for j, t in enumerate(q.terms)}
    index = G.shards(vector, q, G.np.array([number.get(t, -1) for t in vocabulary]), documents_, total, 8).toArrow().combine_chunks()
    want = {(i, d): s for i, _, d, s in brute(rows, asked, 10 ** 6)}
    seen, blocks_all, blocks_kept = set(), 0, 0
    for b in index.to_batches():
        for row in range(b.num_rows):
            shard = G.Shard(row, b, q)
            for k, places in enumerate(q.places):
                blocks, bound = shard.bounds(places)
                blocks_all += len(blocks)
                blocks_kept += int((bound >= sorted((s for (i, _), s in want.items() if i == k), reverse=True)[4]).sum())
                for x, most in zip(blocks, bound):
                    found = shard.documents(G.np.array([x]))
                    scores = shard.scores(found, q.asked[k])
                    first = int(G.np.repeat(b.column("block_terms")[row].values.to_numpy(), 1)[x])
                    for d, s in zip(found, scores):
                        assert want[k, int(shard.ids[d])] == s
                        held = G.np.flatnonzero(shard.vector[d][q.asked[k]])
                        if q.asked[k][held[0]] == first:          # found through this block
                            assert s <= most
                            seen.add((k, int(shard.ids[d])))
    assert seen == set(want)
    assert blocks_kept < 0.5 * blocks_all
