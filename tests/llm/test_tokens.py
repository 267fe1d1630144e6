"""Token counts, trie coding, token files: against the tokenizers library and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from util import ODD, documents, prose, rows_of

from opsmetrics.llm import bpe_trie, library_words, rans, token_counts, token_files

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
CLASH = ("id", "n_tokens", "ids", "shard", "block", "n_bytes", "start", "row")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(BYTE)


def texts(n=3000):
    r = random.Random(4)
    some = list("ab cdé 's ’1 2\n\t  ßÄ漢字🙂'll<|endoftext|>.,!́\x85\x1c\u2003\u3000İſŉΣς")
    for k in range(n):
        t = "".join(r.choices(some, k=r.randint(0, 40)))
        if k % 3 == 0:
            t = prose(k, 5) + t
        if k % 5 == 0:
            t += "".join(chr(r.choice([r.randint(1, 0x3000), r.randint(0xE000, 0x10FFFF)])) for _ in range(4))
        if k % 7 == 0:
            t += "<|endoftext|>" + t[:5]
        yield t


def test_all_coders_agree_with_the_library(tok):
    word = Tokenizer.from_file(WORD)
    trie, counts = bpe_trie.WordCoder(BYTE), token_counts.PieceCounts(BYTE, token_counts.whole_tokens(BYTE))
    lib, low = library_words.LibraryWords(BYTE), library_words.LibraryWords(WORD)
    for t in texts():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(trie.batch([t])[0], trie.width).tolist() == ids
        assert counts.text(t) == len(ids)
        assert np.frombuffer(lib.text(t), "<u2").tolist() == ids
        assert np.frombuffer(low.text(t), "<u2").tolist() == word.encode(t, add_special_tokens=False).ids


def test_settled_characters_split_as_in_the_library(tok):
    split = bpe_trie.Splitter(BYTE)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if bpe_trie.SETTLED.fullmatch(c):
            x = f"a{c}1{c}!{c} {c}"
            assert split(x) == [x[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(x)], hex(cp)


def test_a_lower_case_word_is_kept_once():
    low = library_words.LibraryWords(WORD, limit=100, word_limit=100)
    tok = Tokenizer.from_file(WORD)

    def entries():
        return sum({id(t): len(t) for t in (low, low.words)}.values())

    low.text("some lower words")
    assert entries() == 3
    for k in range(40):
        t = prose(k, 40) + " " + " ".join(f"X{k}y{n}-{'ab' * k}" for n in range(9))
        assert np.frombuffer(low.text(t), "<u2").tolist() == tok.encode(t).ids
        assert entries() <= 102


def test_words_stand_for_equal_pieces():
    low = library_words.LibraryWords(WORD)
    tok = Tokenizer.from_file(WORD)
    marks = [c for c in map(chr, range(0x21, 0x1c4)) if library_words._PLAIN.fullmatch(c) and not c.isspace()]
    for c in marks:
        low.text(f"{c}A {c}{c} a{c}9 {c}'S '{c}.")          # its words first
        for t in (f"{c}A {c}{c} a{c}9 {c}'S '{c}.", f"{c}a {c} a{c} 9 's {c}'s ' '{c} . ,".lower()):
            assert np.frombuffer(low.text(t), "<u2").tolist() == tok.encode(t).ids, c


def test_small_tables_start_again():
    coder = bpe_trie.WordCoder(BYTE, cache_words=10)
    lib = library_words.LibraryWords(BYTE, limit=5, word_limit=5)
    tok = Tokenizer.from_file(BYTE)
    for k in range(30):
        t = prose(k, 40)
        ids = tok.encode(t).ids
        assert np.frombuffer(coder.batch([t, t])[1], "<u2").tolist() == ids == np.frombuffer(lib.text(t), "<u2").tolist()


def test_new_pieces_of_a_batch_are_learned_in_one_loop(tok, monkeypatch):
    def alone(self, piece):
        raise AssertionError(f"a call for {piece!r} alone")

    monkeypatch.setattr(library_words.LibraryWords, "__missing__", alone)
    some = [prose(k, 60) + f" Ünique{k}, x{k}-y a\nb{'long' * 20}{k}." for k in range(40)]
    ids = [tok.encode(t, add_special_tokens=False).ids for t in some]
    for limits in ({}, {"limit": 5, "word_limit": 5}):
        lib = library_words.LibraryWords(BYTE, **limits)
        for batch in (slice(0, 25), slice(25, 40)):
            got = lib.texts(pa.array(some[batch]))
            assert [np.frombuffer(x, "<u2").tolist() for x in got] == ids[batch]
        assert max(map(len, lib)) <= library_words.KEPT_CHARS


def test_shared_prefixes_are_computed_once():
    m = bpe_trie.Merges(BYTE)
    e = bpe_trie.TrieEncoder(m)
    words = sorted({"inter" + s for s in ("national", "nationally", "net", "nets", "rupt", "")})
    assert [list(x) for x in e.encode_sorted(words)] == [[m.vocab[s] for s in m.merge(list(w))] for w in words]


def test_long_words_count_like_plain_merging():
    m = bpe_trie.Merges(BYTE)
    for s in ("ab" * 150, "the" * 100, "x" * 301, prose(3, 60).replace(" ", "")):
        assert token_counts.long_count(m, s) == len(m.merge(list(s)))


def test_token_counts(spark, tok):
    got = {r.doc_id: r for r in token_counts.count_tokens(documents(spark, clash=CLASH), BYTE, limit=1024).collect()}
    assert len(got) == len(ODD)
    for i, t, _ in ODD:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert token_counts.count_tokens(documents(spark, []), BYTE).count() == 0


def test_trie_digests_and_round_trip(spark, tok):
    docs = documents(spark, clash=CLASH)
    for r in bpe_trie.digests(docs, BYTE).collect():
        t = dict((i, x) for i, x, _ in ODD)[r.doc_id] or ""
        ids = tok.encode(t, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = dict(rows_of(bpe_trie.decode(bpe_trie.encode(docs, BYTE), BYTE), "doc_id", "text"))
    assert back == {i: t or "" for i, t, _ in ODD}
    assert bpe_trie.digests(documents(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 65, 5000, 600_001])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.uint16)
    t = rans.Tables(rans.scaled(np.bincount(ids, minlength=65536)))
    block = rans.encode(ids, t)
    assert (rans.decode(block, t) == ids).all()
    each = 2048 * 256
    for s in range(rans.segments(block)):
        assert (rans.decode(block, t, s) == ids[s * each:(s + 1) * each]).all()
    if n:
        broken = bytearray(block)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(broken), t)


def test_scaled_frequencies():
    for counts in ([1], [1, 1, 1], [10 ** 12, 1, 1], [0, 5, 0, 7], np.ones(60000, int), np.r_[10 ** 9, np.ones(60000, int)]):
        f = rans.scaled(np.array(counts))
        assert f.sum() == 1 << rans.BITS and ((f > 0) == (np.array(counts) > 0)).all()


def test_token_files(spark, tok, tmp_path):
    rows = ODD + [(20, prose(9, 30), "en"), (20, prose(9, 30), "en")]
    docs = documents(spark, rows, clash=CLASH)
    out = token_files.write_tokens(docs, BYTE, str(tmp_path / "t"), end_id=2, block_tokens=500)
    at = 0
    expected = []
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(rows_of(token_files.read_digests(spark, out), "id", "start", "n_tokens", "ids_crc32")) == sorted(expected)
    first = {r.id: r.ids for r in token_files.read_tokens(spark, out).collect()}
    assert first[6] == tok.encode(ODD[5][1], add_special_tokens=False).ids + [2]


def test_token_files_of_an_empty_table(spark, tmp_path):
    out = token_files.write_tokens(documents(spark, []), BYTE, str(tmp_path / "t"), end_id=2)
    assert token_files.read_digests(spark, out).count() == 0
