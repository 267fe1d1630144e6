"""Runs of periodic words against brute force."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from opsmetrics.llm import kruskal_runs as K
from util import documents, prose


def brute_runs(w, least=12):
    """For each period the maximal stretches, without those of a smaller period."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                if length >= max(least, 2 * q):
                    found.setdefault((i, length), q)          # the same stretch with a multiple of its period: not smallest
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def smallest(w, run):
    s, n, q = run
    x = w[s:s + n]
    return all(any(x[k] != x[k + p] for k in range(n - p)) for p in range(1, q))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70), max_size=4), st.integers(2, 12))
def test_two_words(texts, least):
    texts = [[c.encode() for c in t] for t in texts]
    want = [[r for r in brute_runs(t, least) if smallest(t, r)] for t in texts]
    assert K.runs_of(texts, least) == want


def test_periodic_texts_of_many_shapes():
    r = random.Random(5)
    texts = []
    for _ in range(150):
        t = []
        for _ in range(r.randrange(1, 5)):
            piece = [str(r.randrange(r.choice((2, 3, 50)))).encode() for _ in range(r.randrange(1, 12))]
            t += piece * r.randrange(1, 7) + piece[:r.randrange(len(piece))]
        texts.append(t)
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 300:
        fib = fib[1], fib[1] + fib[0]
    texts += [fib[1], [b"a"] * 500, [], [b"x"], [b"a"] * 11, [b"a"] * 12, [str(i).encode() for i in range(200)] * 2]
    assert K.runs_of(texts) == [[x for x in brute_runs(t) if smallest(t, x)] for t in texts]


def brute_row(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and w:
        n = len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [x for x in brute_runs(w) if smallest(w, x)]
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    return (doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


def test_digests_match_brute_force(spark):
    r = random.Random(9)
    rows = [(i, prose(i, r.randrange(0, 120)), "en") for i in range(300)]
    rows += [(1000 + i, " ".join([prose(i, 4)] * r.randrange(1, 9)) + " \x0b\x1c  end", "en") for i in range(60)]
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, " \n\t", "en"), (2003, "x " * 400, "en"), (2003, "x " * 400, "en")]
    got = K.digests(documents(spark, rows, clash=("runs", "start", "length"))).collect()
    assert sorted(tuple(x) for x in got) == sorted(brute_row(i, t) for i, t, _ in rows)
    assert any(x.n_runs for x in got)
    assert K.digests(documents(spark, [])).collect() == []
    assert [x.n_runs for x in K.digests(documents(spark, [(None, "a " * 20, "en")])).collect()] == [1]


def test_real_outputs(spark):
    rows = [(1, "start " + "la di da " * 10 + "end", "en")]
    r = K.find_runs(documents(spark, rows)).first()
    assert [tuple(x) for x in r.runs] == [(1, 30, 3)] and r.collapsed_text == "start la di da end"


def test_very_long_texts_in_seconds():
    import time
    r = random.Random(2)
    block = [str(r.randrange(10 ** 6)).encode() for _ in range(1000)]
    texts = [[b"a"] * 200_000, block * 200, [r.choice((b"a", b"b")) for _ in range(100_000)]]
    at = time.time()
    runs = K.runs_of(texts)
    assert time.time() - at < 60
    assert runs[0] == [(0, 200_000, 1)] and runs[1] == [(0, 200_000, 1000)]
