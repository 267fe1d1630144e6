"""Exact and near duplicates against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
from util import ODD, documents, prose, rows_of

from opsmetrics.llm import dart_minhash, exact_dedup

CLASH = ("digest", "run", "keep_id", "v", "bands", "kept", "_salt", "root", "a")


def test_exact_groups(spark):
    rows = ODD + [(100 + k, "hot", "en") for k in range(500)]
    docs = documents(spark, rows, clash=CLASH)
    by = defaultdict(list)
    for i, t, _ in rows:
        by[t or ""].append(i)
    for keep, best in (("max", max), ("min", min)):
        got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, keep=keep, runs=20, fan_in=3).collect()}
        assert len(got) == len(rows)
        for t, ids in by.items():
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best(ids), len(ids), i == best(ids))
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


def test_runs_and_fan_in_do_not_matter(spark):
    docs = documents(spark)
    one = sorted(rows_of(exact_dedup.exact_groups(docs, runs=1), "doc_id", "keep_id", "group_size"))
    for runs, fan_in in ((2, 2), (7, 2), (9, 16)):
        assert sorted(rows_of(exact_dedup.exact_groups(docs, runs=runs, fan_in=fan_in), "doc_id", "keep_id", "group_size")) == one


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.exact_groups(documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "t", "en"), (None, "t", "en"), (3, "u", "en"), (3, "u", "en"), (None, "u", "en")]
    got = rows_of(exact_dedup.exact_groups(documents(spark, rows)), "doc_id", "keep_id", "group_size", "kept")
    assert Counter(got) == Counter([(None, None, 2, False)] * 2 + [(3, 3, 3, True)] * 2 + [(None, 3, 3, False)])
    kept = rows_of(exact_dedup.drop_copies(documents(spark, rows, clash=CLASH)), "doc_id", "text", "digest")
    assert Counter(kept) == Counter([(3, "u", "extra"), (None, "t", "extra")])      # a text without an id keeps one row


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    for change in (0.03, 0.2, 0.6):
        n = 300
        a = rng.integers(1, 7, n).astype(float) * rng.choice([0.5, 1.0], n)
        b = np.where(rng.random(n) < change, rng.integers(0, 9, n), a).astype(float)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        element = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        share = []
        for rep in range(40):
            e = dart_minhash.mix(element + np.uint64(rep))
            some = b > 0
            sig = dart_minhash.dart_signatures(np.r_[np.zeros(n, int), np.ones(some.sum(), int)], np.r_[e, e[some]], np.r_[a, b[some]], 2, 80)
            share.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(share) - true) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    t = [prose(k, 30 + 50 * k) for k in range(6)] + ["one two", ""]
    table = dart_minhash.WordHashes()
    whole = dart_minhash.dart_signatures(*dart_minhash.elements(t, table), len(t), 80)
    for k, x in enumerate(t):
        assert (dart_minhash.dart_signatures(*dart_minhash.elements([x], table), 1, 80)[0] == whole[k]).all()
    assert not whole[-1].any() and whole[:-1].all()


def shingles(text):
    w = (text or "").lower().split()
    w += [""] * (5 - len(w)) if w else []
    return Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def brute_classes(rows):
    sets = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            both = sum((x & y).values())
            total = sum((x | y).values())
            if x == y or (total and both >= 0.8 * total):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def near_rows():
    r = random.Random(8)
    rows = list(ODD)
    for family in range(8):
        base = prose(100 + family, 150).split()
        for k in range(r.choice((2, 5, 30))):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"edit{r.randrange(50)}"
            rows.append((1000 + 100 * family + k, " ".join(w), "en"))
    passage = prose(77, 60)
    rows += [(3000 + k, prose(500 + k, 90) + " " + passage, "en") for k in range(40)]     # share a passage, are not alike
    rows += [(4000 + k, "the same words again and again", "en") for k in range(60)]
    return rows


def test_near_groups(spark):
    rows = near_rows()
    got = {r.doc_id: r for r in dart_minhash.near_groups(documents(spark, rows, clash=CLASH)).collect()}
    expected = brute_classes(rows)
    assert {i: r.class_id for i, r in got.items()} == expected
    assert all(r.kept == (i == r.class_id) for i, r in got.items())


def test_small_tables_take_few_files_and_texts_are_read_in_short_batches(spark, monkeypatch):
    name, plain = "spark.sql.parquet.columnarReaderBatchSize", dart_minhash.stored
    before, read, files = spark.conf.get(name), set(), defaultdict(int)

    def seen(df, title, **options):
        out = plain(df, title, **options)
        read.add(spark.conf.get(name))
        files[title] = max(files[title], len(out.inputFiles()))
        return out

    monkeypatch.setattr(dart_minhash, "stored", seen)
    assert dart_minhash.near_groups(documents(spark, near_rows())).count() == len(near_rows())
    assert read == {str(dart_minhash.READ_ROWS)} and spark.conf.get(name) == before
    assert max(files["nodes"], files["buckets"], files["links"]) < int(spark.conf.get("spark.sql.shuffle.partitions"))


def family_rows(size=1500, planted=100):
    """A template family: any two texts are at 0.76 (no link), planted pairs at 0.84."""
    r = random.Random(3)
    template = [f"t{k}" for k in range(256)]
    rows = []
    for k in range(size):
        w = template + [f"own{k}x{j}" for j in range(40)]
        if k < 2 * planted and k % 2:
            w = template + [f"own{k - 1}x{j}" for j in range(14)] + [f"own{k}x{j}" for j in range(14, 40)]
        rows.append((k, " ".join(w), "en"))
    r.shuffle(rows)
    return rows


def test_links_inside_a_template_family(spark):
    rows = family_rows()
    sets = {i: shingles(t) for i, t, _ in rows}
    similarity = lambda a, b: sum((sets[a] & sets[b]).values()) / sum((sets[a] | sets[b]).values())
    assert similarity(0, 1) >= 0.8 > similarity(0, 2) > 0.7
    got = dict(rows_of(dart_minhash.near_groups(documents(spark, rows)), "doc_id", "class_id"))
    assert got == {i: i - i % 2 if i < 200 else i for i in got}


def test_prefixes_find_all_pairs(spark):
    rows = [(i, t, x) for i, t, x in near_rows() if t and t.split()]
    sets = {i: shingles(t) for i, t, _ in rows}
    texts = documents(spark, rows).selectExpr("doc_id as v", "text")
    root = spark.createDataFrame([(i, i - i % 3) for i in sets], "v bigint, root bigint")
    found = set(rows_of(dart_minhash.prefix_pairs(texts, root), "a", "b"))
    for a in sets:
        for b in sets:
            if a < b and a - a % 3 != b - b % 3 and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                assert (a, b) in found


def test_near_edge_cases(spark):
    assert dart_minhash.near_groups(documents(spark, [])).count() == 0
    rows = [(None, "a b c d e f", "en"), (2, "a b c d e f", "en"), (1, None, "en"), (3, " ", "en")]
    got = rows_of(dart_minhash.near_groups(documents(spark, rows)), "doc_id", "class_id", "kept")
    assert Counter(got) == Counter([(None, None, False), (2, 2, True), (1, 1, True), (3, 1, False)])


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(201, 200)]
    got = dict(rows_of(dart_minhash.components(spark.createDataFrame(links, "a bigint, b bigint")), "v", "root"))
    assert got == {**{k: 1 for k in range(2, 41)}, **{k: 100 for k in range(101, 140)}, 201: 200}
