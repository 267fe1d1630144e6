"""Quality rules, toxicity, URLs and main texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from util import ODD, documents, prose, rows_of

from opsmetrics.llm import fertility, html_crf, toxicity, url_filter
from opsmetrics.llm.common import BATCH_ROWS, cut

PIECE = P.path("piece_bpe_32k.model")
CLASH = ("row", "octave", "kept", "score", "band_group", "n_words", "toxic", "held_out")


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {k + j for k, x in enumerate(zip(words, words[1:], words[2:])) if windows[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked),
            len(words) < 50 or 100 * len(marked) > 50 * len(words))


def test_base_measures_against_brute_force(spark):
    rows = ODD + [(50, "x y z\nx y z\n\nq x y z # |", "en"), (51, "same line\n" * 40, "en"), (52, "a\u00a0b\x85c \x1f d", None)]
    got = fertility.judge(documents(spark, rows, clash=CLASH), PIECE).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
    assert fertility.judge(documents(spark, []), PIECE).count() == 0


def test_repeat_words_of_very_long_texts():
    words = [b"a", b"b", b"c", b"d"] + [str(k).encode() for k in range((1 << 20) + 5)] + [b"a", b"b", b"c", b"e"]
    assert fertility.repeat_words(words) == 6


def test_bands_reject_junk_and_keep_the_rest(spark):
    rows = [(k, prose(k, 150 + k % 50), "en") for k in range(200)]
    rows += [(1000 + k, " ".join(w + "&%$" for w in prose(900 + k, 150).split()), "en") for k in range(8)]
    rows += [(2000, prose(5, 170), "en")] * 100                               # copies must not move the bands
    got = dict(rows_of(fertility.judge(documents(spark, rows), PIECE).distinct(), "doc_id", "kept"))
    assert not any(got[k] for k in got if 1000 <= k < 2000)
    assert sum(got[k] for k in got if k < 1000) >= 198


def varied(seed, n, words):
    """n words out of so many different ones."""
    r, own = random.Random(seed), random.Random(words)
    table = ["".join(own.choice("ka lo mi ren ta su vel dor an es ti ou".split()) for _ in range(3)) for _ in range(words)]
    return " ".join(r.choice(table) for _ in range(n))


def test_entropy_counts_where_a_length_class_is_nearly_empty(spark):
    rows = [(k, varied(k, 120 + k, 1500), "en") for k in range(300)]
    rows += [(1000, varied(1, 2500, 60), "en")] + [(1001 + k, varied(2000 + k, 2500, 1500), "en") for k in range(5)]
    got = dict(rows_of(fertility.judge(documents(spark, rows), PIECE), "doc_id", "kept"))
    assert not got[1000] and all(got[1001 + k] for k in range(5))


def test_rare_languages_are_judged_by_their_script(spark):
    rows = [(k, prose(k, 150 + k % 50), "en") for k in range(200)]
    rows += [(1000 + k, prose(700 + k, 160), "xx") for k in range(5)]
    rows += [(2000 + k, " ".join(w + "&%$" for w in prose(900 + k, 150).split()), "xx") for k in range(5)]
    han = [chr(0x4E00 + 37 * k) for k in range(300)]
    rows += [(3000 + k, " ".join("".join(random.Random(k * 100 + j).choices(han, k=3)) for j in range(90)), "zh") for k in range(3)]
    got = dict(rows_of(fertility.judge(documents(spark, rows), PIECE), "doc_id", "kept"))
    assert all(got[k] for k in range(1000, 1005)) and not any(got[k] for k in range(2000, 2005))
    assert all(got[k] for k in range(3000, 3003))                              # not held against bands of Latin letters


def test_script_of_texts_without_language():
    assert fertility.main_script("привет мир abc") == "Cyrillic"
    assert fertility.main_script("123 !!") == "none"


def toxic_rows(n, seed):
    rows, labels = [], []
    for k in range(n):
        t = [prose(seed + 31 * k + j, 9) + "." for j in range(6)]
        bad = k % 5 == 0
        if bad:
            t[k % 6] = prose(k, 4) + f" grobfug{'abcdefgh'[k % 8]}ton " + prose(k + 1, 3) + "!"
        rows.append((seed + k, " ".join(t), "en"))
        labels.append((seed + k, int(bad)))
    return rows, labels


def test_toxicity_learns_from_document_labels(spark):
    rows, labels = toxic_rows(600, 10_000)
    rows += ODD
    lab = spark.createDataFrame([(i, 1, t) for i, t in labels] + [(1, 1, None), (999_999, 0, 1), (labels[0][0], 0, labels[0][1])],
                                "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(documents(spark, rows, clash=CLASH), lab).collect()}
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert len(held) > 60 and np.mean([p == t for p, t in held]) > 0.98
    for i, t in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if t and got[i].predicted:
            assert any("grobfug" in texts[i][s.start:s.end] for s in got[i].sentences)
    assert got[1].score == got[2].score == got[3].score == 0.0
    kept = toxicity.keep_harmless(documents(spark, rows, clash=CLASH), lab)
    assert kept.columns == documents(spark, rows, clash=CLASH).columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r.predicted}


def test_document_score_is_the_noisy_or_of_its_sentences():
    w = np.zeros(toxicity.DIMENSIONS, np.float32)
    for word, x in (("bad", 2.0), ("worse", 3.0)):
        w[toxicity.features(word)[0]] += x
    s = toxicity.Scorer(w, -2.5)
    text = "Bad day. worse, bad! Fine\nworse"
    p = 1.0
    for sentence in ("bad day", "worse bad", "worse"):
        z = -2.5 + sum(float(w[toxicity.features(x)].sum()) for x in sentence.split())
        p *= 1 - 1 / (1 + math.exp(-z))
    assert abs(s.document(text) - (1 - p)) < 1e-6
    assert s.document(None) == s.document("") == 0.0


def test_toxicity_without_examples(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in toxicity.judge(documents(spark), labels).collect()} == {0}
    assert toxicity.judge(documents(spark, []), labels).count() == 0


def test_carried_rows_go_in_short_batches_with_one_text(spark, monkeypatch):
    def short(it, **size):
        for b in it:
            if b.num_rows > BATCH_ROWS:
                raise ValueError(f"a batch of {b.num_rows} rows")
            if b.column("text").buffers()[-1].address != b.column("row").field(1).buffers()[-1].address:
                raise ValueError("the text was sent twice")
            yield from cut([b], **size)

    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.parquet.columnarReaderBatchSize": "4096"}
    before = {name: spark.conf.get(name) for name in settings}
    rows, labels = toxic_rows(600, 10_000)
    rows = rows + [(50_000 + k, f"text {k}", "en") for k in range(2 * BATCH_ROWS)] + ODD + [(None, None, None), (6, prose(1, 70), "en")]
    docs = documents(spark, rows, clash=("Row", "kept", "score", "sentences")).coalesce(1)
    lab = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(fertility, "cut", short)
    monkeypatch.setattr(toxicity, "cut", short)
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        good = sorted(map(tuple, fertility.keep_good(docs, PIECE).collect()), key=str)
        assert {name: spark.conf.get(name) for name in settings} == settings
        harmless = sorted(map(tuple, toxicity.keep_harmless(docs, lab).collect()), key=str)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")        # smaller ones stay
        toxicity.keep_harmless(docs, lab)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    monkeypatch.undo()
    whole = [tuple(r) for r in docs.collect()]
    kept = Counter(rows_of(fertility.judge(docs, PIECE).filter("kept"), "doc_id"))
    assert good == sorted((r for r in whole if kept[r[:1]] and not base(r[1])[-1]), key=str) and len(good) > 500
    toxic = {r.doc_id for r in toxicity.judge(docs, lab).filter("predicted = 1").collect()}
    assert harmless == sorted((r for r in whole if r[0] not in toxic), key=str) and len(toxic) > 100
    # a text of another type is sent beside its row
    bytes_ = docs.withColumn("text", F.col("text").cast("binary"))
    assert sorted((r.doc_id for r in toxicity.score(bytes_, toxicity.fit(docs, lab), carry=True).filter("score < 0.5").collect()), key=str) == sorted((r[0] for r in harmless), key=str)
    assert fertility.keep_good(bytes_, PIECE).count() == len(good)


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, says in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return host, path, best


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?q=/x#y", "http://a.net", "http://a.net/", "x://net/", "http://example.net/en",
            "http://b.example.com/de/x", "http://example.com/DE/", "http://org/fr/", "http://notorg/fr/1", "http://q.org/fr/2://z", "ftp://ÄB.net?x",
            "http://evilexample.net/en/", "http://u:p@Host.org:80/a b\n?c", "http://casino-pills.example.org/en/3", "http://x.org#/fr/", "http://" + "a" * 5000 + ".org/" + "p" * 20000] * 2
    pages = spark.createDataFrame([(k, u, None, "extra") for k, u in enumerate(urls)], "page_id bigint, url string, html string, host string")
    for r in url_filter.judge(pages, RULES).collect():
        host, path, best = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None), urls[r.page_id]
        assert r.verdict == (best[1] if best else "block" if r.score >= 0.5 else "allow")
    assert url_filter.judge(pages.filter("false"), RULES).count() == 0


def test_url_model_on_left_out_rows():
    rows = url_filter.labelled()
    right = 0
    for fold in range(5):
        w, b = url_filter.train([r for k, r in enumerate(rows) if k % 5 != fold])
        for host, path, y in rows[fold::5]:
            z = b + sum(float(w[g].sum()) / max(1, len(g)) ** 0.5 for g in (url_filter.grams("h", host), url_filter.grams("p", path)))
            right += (z > 0) == bool(y)
    assert right / len(rows) > 0.75


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies to improve this site.</p></div><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- x --><div class="ad">Buy this now, it is cheap.</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>word,
 caf&eacute; &lt;b&gt;.</p><p><b>Open<br>tag.<p>Third one.</p><ul><li>item one here<li>item two here</ul>
<div class="ads"><p>An advert in between, with a sentence.</p></div><p>Last.</p></article>
<section class="comments"><div class="comment"><p>I do not agree with this at all.</p></div></section>
<aside><p>Read also this other story of ours.</p></aside><form><p>Your mail please.</p><input></form>
<footer>&copy; 2020 all rights reserved.</footer></body></html>"""
MAIN = "Title & more\n\nFirst boldword, café <b>.\n\nOpen tag.\n\nThird one.\n\nitem one here\n\nitem two here\n\nLast."


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", PAGE), (5, "u", "<nav><a href=/>x</a></nav>"), (6, "u", "</p></div><"),
            (7, "u", "<html><body><article><p>" + prose(1, 20000) + "</p>")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_crf.extract(pages).collect()}
    assert got[1].text == got[4].text == MAIN and got[1].n_chars == len(MAIN) and got[2].url is None
    assert got[2].text == got[3].text == got[5].text == "" and got[2].n_chars == 0
    assert got[7].text == prose(1, 20000)
    assert html_crf.extract(pages.filter("false")).count() == 0


def shown(page):
    return [b.text for b in html_crf.blocks(page)]


def test_what_is_not_shown_ends():
    for tag in ("svg viewBox='0 0 1 1'", "math", "object data='x'", "canvas", "video", "audio", "noscript", "select", "template"):
        assert shown(f"<body><p>one <{tag}/> two</p><p>three</p>") == ["one two", "three"], tag
    for name in "object canvas video audio noscript select template svg".split():
        assert shown(f"<body><div><p>one</p><{name} id=a>x<b>y</b></div><p>two</p>") == ["one", "two"], name
        assert shown(f"<body><p>one <{name}>x<g>y</g><i>z</i></{name}>two</p><p>three</p>") == ["one two", "three"], name
        assert shown(f"<body><p>one <{name}>x</p><p>two</p>") == ["one", "two"], name
    assert shown("<p>a <svg><title/><style/><path d='x'/></svg>b</p>") == ["a b"]
    assert shown("<p>a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> b</p>") == ["a x=12 b"]
    assert shown("<p>a</p><script src=/x/>var t = 1;</script><p>b</p>") == ["a", "b"]


def test_head_without_end_tag():
    assert shown("<html><head><title>T</title><p>Article</p><p>more") == ["Article", "more"]
    assert shown("<html><head><meta charset=x><title>T</title>\n text <b>here</b><p>more") == ["text here", "more"]
    assert shown("<head><noscript><img src=x><p>no</p></noscript><link href=x></head><p>yes") == ["yes"]
    assert shown("<head><title>T</title><span>a</span> b</head><p>c") == ["a b", "c"]


def test_crf_on_fresh_pages():
    x = html_crf.Extractor(html_crf.train(html_crf.training_pages(250, seed=3)))
    right = total = 0
    for p in html_crf.training_pages(100, seed=1234):
        seq = html_crf.blocks(p)
        right += sum(b.label == y for b, y in zip(seq, x.labels(seq)))
        total += len(seq)
    assert right / total > 0.98


def test_viterbi_is_the_best_labelling():
    import itertools
    model = {"weights": {"tag p": 0.4, "tag li": -0.7, "size 0": -0.2}, "step": [[0.5, -1.0], [-0.3, 0.8]], "start": [0.1, -0.2]}
    x = html_crf.Extractor(model)
    seq = html_crf.blocks("<p>one</p><li>two</li><p>" + "three " * 9 + "</p><li>f</li><p>g</p>")

    def value(y):
        return model["start"][y[0]] + sum(x.emission(b) * v for b, v in zip(seq, y)) + sum(model["step"][a][b] for a, b in zip(y, y[1:]))

    best = max(itertools.product((0, 1), repeat=len(seq)), key=value)
    assert abs(value(x.labels(seq)) - value(best)) < 1e-9
