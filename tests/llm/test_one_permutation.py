"""One-permutation fingerprints: likeness against exact similarities, edits across range edges, odd rows."""

import hashlib
import random

import pytest

from opsmetrics.llm import one_permutation as P
from util import documents, prose


def exact(a, b):
    def shingles(t):
        w = t.lower().encode().split()
        w += [b""] * (5 - len(w)) if w else []
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_estimates_the_similarity():
    r = random.Random(1)
    f = P.Fingerprinter()
    errors = []
    for n in (3, 8, 30, 200, 3000):
        for share in (0.0, 0.05, 0.3, 0.8):
            for _ in range(6):
                words = [str(r.randrange(10 ** 6)) for _ in range(n)]
                other = list(words)
                at = r.randrange(n)
                for k in range(int(n * share)):
                    other[(at + k) % n] = str(r.randrange(10 ** 6))
                a, b = " ".join(words), " ".join(other)
                errors.append(f.likeness(*f.pack([a, b])) - exact(a, b))
    assert max(map(abs, errors)) < 0.16                       # sets of a few shingles borrow most bins
    assert abs(sum(errors) / len(errors)) < 0.01              # no bias
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.045


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_brute_force_densification(bits):
    f = P.Fingerprinter(bins=16, bits=bits)
    texts = ["", "a b", "one two three four five six seven", prose(3, 40), None, prose(3, 40) + " tail"]
    least, filled = f.minima(texts)
    dense, some = f.densified(texts)
    for t in range(len(texts)):
        assert some[t] == bool(filled[t].any())
        for b in range(16):
            if some[t]:
                source = b if filled[t][b] else next(s for s in f.probe[b] if filled[t][s])
                assert dense[t][b] == least[t][source]
    for b in range(16):
        assert sorted(f.probe[b]) == list(range(16))
    p = f.pack(texts)
    assert p[0] == p[4] == b"" and len(p[1]) == 16 * bits // 8
    same = [sum(P.mix(dense[i] ^ P.np.arange(16, dtype=P.np.uint64) * P._STEP) & P._U(2 ** bits - 1) ==
                P.mix(dense[j] ^ P.np.arange(16, dtype=P.np.uint64) * P._STEP) & P._U(2 ** bits - 1)) for i, j in ((2, 3), (3, 5))]
    for n, (i, j) in zip(same, ((2, 3), (3, 5))):
        c = 2.0 ** -bits
        assert f.likeness(p[i], p[j]) == pytest.approx(min(1, max(0, (n / 16 - c) / (1 - c))))


def brute(rows):
    """{doc_id: (n_chars, sha, fingerprints, likenesses)}, the next document in descending order of unique ids."""
    f = P.Fingerprinter()
    rows = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        e = t[:len(t) - cut] + after[:cut]
        a, b, c = f.pack([t, e, after])
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), f.likeness(a, b), f.likeness(a, c))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_edits_match_brute_force_over_any_number_of_ranges(spark, partitions):
    rows = [(i, None if i % 17 == 0 else prose(i, (i * 37) % 90) + " é漢🙂" * (i % 3), "en") for i in range(2, 120)] + [(500, "x" * 20000, "en")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = P.edited_strings(documents(spark, rows, clash=("text2", "fingerprint", "role", "place"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len(rows)


def test_odd_tables(spark):
    assert P.edited_strings(documents(spark, [])).collect() == []
    one = P.edited_strings(documents(spark, [(7, prose(1, 30), "en")])).collect()
    assert [tuple(r) for r in one] == [(7, *brute([(7, prose(1, 30), "en")])[7])]
    rows = [(None, prose(1, 20), "en"), (None, None, "en"), (3, "same text", "en"), (3, "same text", "en"), (3, "", "en")]
    got = P.edited_strings(documents(spark, rows)).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got) == [0, 0, 9, 9, len(prose(1, 20))]
    assert {r.fingerprint for r in got if r.n_chars == 0} == {""}
    assert len({r.fingerprint for r in got if r.n_chars == 9}) == 1


def test_fingerprints_without_edits(spark):
    rows = [(i, prose(i % 5, 50), "en") for i in range(40)] + [(90, None, "en")]
    got = {r.doc_id: bytes(r.fingerprint) for r in P.fingerprints(documents(spark, rows, clash=("fingerprint",))).collect()}
    assert got[0] == got[5] != got[1] and got[90] == b"" and len(got) == 41
