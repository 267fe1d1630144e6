"""Very long texts without ordinary breaks: every operator takes them in seconds and keeps no long words."""

import random
import time

import public_tokenizers
import pytest

from opsmetrics.llm import bpe_trie, dart_minhash, exact_dedup, fertility, html_crf, library_words, token_counts, toxicity
from opsmetrics.llm.common import KEPT_CHARS
from opsmetrics.llm.queries import BYTE_BPE, PIECE_BPE, WORD_BPE
from util import documents

PAGES = ["<a" * 500_000, "<a " * 333_333, "if a <b then it's " * 55_000, "if a <b then it's " * 55_000 + ">", "<a '<a \"" * 120_000 + ">",
         "<div>" * 100_000 + "x", "<div>" * 50_000 + "</span>" * 100_000, "</script " * 100_000, "<script " * 100_000, "<!--" * 250_000,
         '<a href="' * 110_000, "&" * 1_000_000]


@pytest.fixture(scope="module")
def extractor():
    return html_crf.Extractor(html_crf.train(html_crf.training_pages()))


@pytest.mark.parametrize("page", PAGES, ids=lambda p: p[:18])
def test_a_page_of_a_million_characters(extractor, page):
    at = time.time()
    extractor.text(page)
    assert time.time() - at < 10


def test_plain_articles_hidden_elements_and_buttons(extractor):
    menu, foot = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>", "<footer>&copy; somebody</footer>"
    plain = "<div><div>First long paragraph with a good many words in it.<br><br>Second one, which goes on. And on.</div></div>"
    assert extractor.text(menu + plain + foot) == "First long paragraph with a good many words in it. Second one, which goes on. And on."
    page = ("<article><p>The first words of it are here.</p><button>Share</button><p hidden>not this</p><p style='display:none'>nor this</p>"
            "<p>The last <span hidden>x</span>words of it.</p></article>")
    assert extractor.text(menu + page + foot) == "The first words of it are here.\n\nThe last words of it."
    assert [b.text for b in html_crf.blocks("<p title='a hidden thing'>seen</p><p data-hidden=1>seen too</p><p HIDDEN>not</p>")] == ["seen", "seen too"]


TOKENS = ["a" + "-" * 1_000_000 + "b", "-" * 1_000_000, "a" * 1_000_000, "_a-" * 300_000]


@pytest.mark.parametrize("text", TOKENS, ids=lambda t: t[:6])
def test_one_token_of_a_million_characters(text):
    import numpy as np
    s = toxicity.Scorer(np.ones(toxicity.DIMENSIONS, np.float32), -3.0)
    at = time.time()
    s.document(text)
    assert time.time() - at < 20 and not [t for t in s if len(t) > KEPT_CHARS]


def test_token_ends():
    assert [toxicity.bare(x) for x in ("", "--", "(it's)", "_a_b_", "é!", "x")] == ["", "", "it's", "a_b", "é", "x"]


def test_tables_hold_no_long_words():
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdefgh0123+/") for _ in range(r.randrange(80, 200))) for _ in range(100)) + " a word" for _ in range(100)]
    at = time.time()
    words = library_words.LibraryWords(public_tokenizers.path(WORD_BPE))
    for t in texts:
        words.text(t)
    counts = token_counts.PieceCounts(public_tokenizers.path(BYTE_BPE), token_counts.whole_tokens(public_tokenizers.path(BYTE_BPE)))
    for t in texts:
        counts.text(t)
    coder = bpe_trie.WordCoder(public_tokenizers.path(BYTE_BPE))
    coder.batch(texts)
    vocabulary = fertility.Vocabulary(public_tokenizers.path(PIECE_BPE))
    vocabulary.measure(" ".join(texts).encode().split())
    hashes = dart_minhash.WordHashes()
    dart_minhash.elements(texts, hashes)
    assert time.time() - at < 120
    for table in (words, words.words, counts, counts.words, coder.words, coder.pieces, hashes):
        assert not [x for x in table if len(x) > KEPT_CHARS]
    for table in (words, words.words, counts, coder.words, coder.pieces, hashes):       # counts.words has no words that are one token
        assert "word" in " ".join(map(str, table))
    assert not [x for x in vocabulary if len(x) > 4 * KEPT_CHARS]


def test_rows_without_ids_stay(spark):
    rows = [(None, "lonely", "en"), (None, "twice", "en"), (None, "twice", "en"), (None, "also named", "en"), (5, "also named", "en"), (6, "other", "en")]
    got = exact_dedup.drop_copies(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "lonely"), (0, "twice"), (5, "also named"), (6, "other")]
    got = dart_minhash.keep_one(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "also named"), (0, "lonely"), (0, "twice"), (5, "also named"), (6, "other")]


def test_one_labelled_id_repeated(spark):
    rows = [(1, "vile words here", "en")] * 3000 + [(2, "kind words there", "en")]
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    seen = []
    before, toxicity.train = toxicity.train, lambda texts, y, **k: seen.extend(texts) or before(texts, y, **k)
    try:
        toxicity.fit(documents(spark, rows), labels)
    finally:
        toxicity.train = before
    assert sorted(seen) in (["kind words there", "vile words here"], ["vile words here"], ["kind words there"], [])
