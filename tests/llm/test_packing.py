"""Best-fit packing: every piece placed once, gapless, and close to the least number of sequences."""

import bisect
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from util import ODD, documents

from opsmetrics.llm import best_fit
from opsmetrics.llm.common import BATCH_ROWS, cut, stored

WORD = P.path("word_bpe_49k.json")


def fill(counts, capacity):
    """The sequences that a plan fills, checked piece by piece."""
    placed, n = best_fit.plan(counts, capacity)
    seen = defaultdict(list)
    for size, first, count, sequence, offset in placed:
        for k in range(count):
            seen[sequence + k].append((offset, size))
    ranks = defaultdict(list)
    for size, first, count, *_ in placed:
        ranks[size] += range(first, first + count)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(c)) for s, c in counts.items() if c}
    for spans in seen.values():
        end = 0
        for offset, size in sorted(spans):
            assert offset == end
            end += size
        assert end <= capacity
    assert sorted(seen) == list(range(n))
    return n


def first_fit_decreasing(counts, capacity):
    free = []
    for size in sorted((s for s, c in counts.items() for _ in range(c)), reverse=True):
        for k, x in enumerate(free):
            if x >= size:
                free[k] -= size
                break
        else:
            free.append(capacity - size)
    return len(free)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=40))
def test_plans_are_valid_and_tight(counts):
    n = fill(counts, 64)
    volume = sum(s * c for s, c in counts.items())
    assert n >= -(-volume // 64)
    assert n <= first_fit_decreasing(counts, 64) + 1 + n // 20


def best_fit_decreasing(counts, capacity):
    """One piece after the other, the longest first, into the smallest gap that takes it."""
    free, n = [], 0
    for size in sorted((s for s, c in counts.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(free, size)
        n += at == len(free)
        space = (free.pop(at) if at < len(free) else capacity) - size
        bisect.insort(free, space)
    return n


def test_rounds_pack_as_well_as_one_piece_after_the_other():
    rng = np.random.default_rng(2)
    for mean, n in ((6.3, 4000), (5.0, 8000), (7.0, 2000)):
        sizes, c = np.unique(np.clip(np.exp(rng.normal(mean, 0.8, n)).astype(int), 1, 2048), return_counts=True)
        counts = dict(zip(sizes.tolist(), c.tolist()))
        assert fill(counts, 2048) <= 1.001 * best_fit_decreasing(counts, 2048) + 1


def test_plan_size_does_not_grow_with_the_counts():
    rng = np.random.default_rng(1)
    sizes, n = np.unique(np.clip(np.exp(rng.normal(6.3, 1.0, 5000)).astype(int), 1, 2048), return_counts=True)
    small = best_fit.plan(dict(zip(sizes.tolist(), n.tolist())), 2048)
    large = best_fit.plan({s: c * 10 ** 6 + 17 for s, c in zip(sizes.tolist(), n.tolist())}, 2048)
    assert len(large[0]) < 3 * len(small[0])
    volume = sum(s * (c * 10 ** 6 + 17) for s, c in zip(sizes.tolist(), n.tolist()))
    assert large[1] < 1.01 * volume / 2048


def test_pack(spark):
    rows = ODD + [(100 + k, "same text here", "en") for k in range(700)]      # one length that most rows share
    docs = documents(spark, rows, clash=("length", "piece", "sequence_id", "_rank", "_bucket", "n", "offset"))
    got = best_fit.pack(docs, WORD, end_id=0, capacity=64).collect()
    tok = Tokenizer.from_file(WORD)
    pieces = defaultdict(dict)
    for r in got:
        assert r.piece not in pieces[r.doc_id]
        pieces[r.doc_id][r.piece] = r
    assert len(pieces) == len(rows)
    for i, t, _ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(-(-len(ids) // 64)):
            part, r = ids[k * 64:(k + 1) * 64], pieces[i].pop(k)
            assert (r.start, r.length, r.ids_crc32) == (k * 64, len(part), zlib.crc32(part.tobytes()))
        assert not pieces[i]
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        assert [o for o, _ in sorted(s)] == list(np.cumsum([0] + [n for _, n in sorted(s)])[:-1])
        assert sum(n for _, n in s) <= 64
    assert len(spans) <= 1.02 * sum(r.length for r in got) / 64 + 1
    assert best_fit.pack(documents(spark, []), WORD).count() == 0


def test_texts_are_encoded_in_short_batches(spark, monkeypatch):
    def short(it, most=BATCH_ROWS, **size):
        for b in it:
            if b.num_rows > most:
                raise ValueError(f"a batch of {b.num_rows} rows")
            yield from cut([b], **size)

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before, meanwhile = [spark.conf.get(x) for x in names], []

    def seen(df, name):
        meanwhile.append([spark.conf.get(x) for x in names])
        return stored(df, name)

    monkeypatch.setattr(best_fit, "cut", short)
    monkeypatch.setattr(best_fit, "stored", seen)
    docs = documents(spark, [(k, f"text {k}", "en") for k in range(2 * BATCH_ROWS + 100)]).coalesce(1)
    assert best_fit.pack(docs, WORD).count() == best_fit.sequences(docs, WORD).selectExpr("explode(spans)").count() == 2 * BATCH_ROWS + 100
    assert meanwhile == [[str(BATCH_ROWS), str(best_fit.READ_ROWS)]] * 2
    assert [spark.conf.get(x) for x in names] == before


def test_sequences_hold_the_ids(spark):
    tok = Tokenizer.from_file(WORD)
    texts = {i: t for i, t, _ in ODD}
    got = best_fit.sequences(documents(spark), WORD, end_id=0, capacity=256).collect()
    back = defaultdict(dict)
    for r in got:
        for s in r.spans:
            back[s.doc_id][s.piece] = r.ids[s.offset:s.offset + s.length]
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in back.items()} == {
        i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
