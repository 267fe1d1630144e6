"""Toxicity by multiple-instance learning (operator 2).

Only documents are labelled; what offends are sentences. Each sentence has a score, a logistic
function of the hashed features of its distinct words (the whole word and its character 4- and
5-grams with marks at both ends); a sentence without any evidence scores 0. A document's score is
the noisy-or of its sentences,

    p(document) = 1 - product over sentences of (1 - p(sentence)),

so one clear sentence is enough and many harmless ones add next to nothing. The weights are
trained from document labels alone, by gradient steps on the likelihood of the noisy-or with an L1
penalty. They are not negative, and only features that stand in clearly more toxic than clean
training documents have one, so most words weigh nothing. Afterwards the sentences with a score of a
half or more are the offending ones.

Training takes a bounded sample: at most ``max_toxic`` and ``max_clean`` labelled documents of at
most ``max_chars`` characters, those with the smallest hash of their id. Only rows whose
crc32(doc_id as text) mod 5 is not 0 lend their labels. Scoring reads every whole text. Neither
labels nor lang, source or doc_id are inputs of a score.

Cases: null, empty and blank texts have no sentence and score 0. Words are white-space
separated, lower-cased, and stripped of marks at their ends. Documents without a label are scored
like all others; labels of unknown documents and null labels are ignored; a document with
several label rows counts as toxic if one of them says so. Without a toxic and a clean example
every score is 0. Of rows with one id the sample takes the smallest text. An empty table gives no
rows; repeated rows are scored each. Very long texts and tokens are scored whole, in time and memory in proportion
to their length. Extra columns are ignored, and kept where rows are carried, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import KEPT_CHARS, cut, held, keep_batches_short, text_at, with_text

DIMENSIONS = 1 << 18
MAX_TOXIC = 1500
MAX_CLEAN = 3500
MAX_CHARS = 20_000

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def bare(token: str) -> str:
    """The token without marks at its ends."""
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while i < j and not token[j - 1].isalnum():
        j -= 1
    return token[i:j]


def features(token: str) -> np.ndarray:
    """Hashed features of a white-space separated token in lower case."""
    word = bare(token)
    if not word:
        return np.zeros(0, np.int32)
    s = f"^{word}$"
    found = {s} | {s[k:k + n] for n in (4, 5) for k in range(len(s) - n + 1)}
    return np.array([zlib.crc32(x.encode("utf-8", "replace")) % DIMENSIONS for x in found], np.int32)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def train(texts: list[str], labels: list[int], steps: int = 120, rate: float = 0.1, penalty: float = 1e-4,
          least: int = 3, apart: float = 4.0) -> tuple[np.ndarray, float]:
    """Sentence weights and intercept from document labels."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(DIMENSIONS, np.float32), -math.inf
    vocab: dict[str, int] = {}
    words, ends, doc = [], [], []
    total = 0
    for k, t in enumerate(texts):
        for s in _SENTENCE.findall(t.lower()):
            w = set(s.split())
            if w:
                words.append(np.fromiter((vocab.setdefault(x, len(vocab)) for x in w), np.int32, len(w)))
                total += len(w)
                ends.append(total)
                doc.append(k)
    if not words:
        return np.zeros(DIMENSIONS, np.float32), -math.inf
    words, doc, ends = np.concatenate(words), np.array(doc, np.int32), np.array(ends)
    sentence = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    each = [features(x) for x in vocab]
    sizes = np.array([len(x) for x in each])
    at, owner = np.concatenate(each), np.repeat(np.arange(len(each), dtype=np.int32), sizes)
    del each, vocab
    n_docs, n_words, n_sent = len(y), len(sizes), len(ends)
    # only features that stand in clearly more toxic than clean documents can be evidence
    starts = np.concatenate([[0], np.cumsum(sizes)])
    seen = np.zeros((2, DIMENSIONS))
    for k, own in enumerate(np.split(words, np.searchsorted(doc[sentence], np.arange(1, n_docs)))):
        u = np.unique(own)
        if len(u):
            seen[int(y[k]), np.unique(np.concatenate([at[starts[x]:starts[x + 1]] for x in u]))] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    p0, p1 = seen[0] / n0, seen[1] / n1
    pool = np.clip(seen.sum(0) / n_docs, 1e-9, 1 - 1e-9)
    evident = (seen.sum(0) >= least) & (p1 - p0 > apart * np.sqrt(pool * (1 - pool) * (1 / n0 + 1 / n1)))
    used = evident[at]
    at, owner = at[used], owner[used]
    w, b = np.zeros(DIMENSIONS), math.log(max(1.0, y.sum()) / n_sent)
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for step in range(1, steps + 1):
        word = np.bincount(owner, w[at], n_words)
        z = np.bincount(sentence, word[words], n_sent)
        some = z > 0 if step > 1 else np.ones(n_sent, bool)
        z += b
        a = np.bincount(doc, softplus(z) * some, n_docs)       # -log of what no sentence gives
        slope = np.where(y == 1, -1 / np.expm1(np.clip(a, 1e-6, 500)), 1.0) / n_docs
        g_sent = slope[doc] * some / (1 + np.exp(-np.clip(z, -500, 500)))
        g_word = np.bincount(words, g_sent[sentence], n_words)
        g = np.append(np.bincount(at, g_word[owner], DIMENSIONS) + penalty * (w > 0), g_sent.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w = np.maximum(0, w - move[:-1])                       # a word can only add evidence
        b -= move[-1]
    return w.astype(np.float32), float(b)


class Scorer(dict):
    """Logit share of each token, kept in a bounded table."""

    def __init__(self, w: np.ndarray, b: float, limit: int = 600_000):
        super().__init__()
        self.w, self.b, self.limit = w, b, limit

    def __missing__(self, token: str) -> float:
        got = float(self.w[features(token)].sum())
        if len(token) <= KEPT_CHARS:
            if len(self) > self.limit:
                self.clear()
            self[token] = got
        return got

    def document(self, text: str | None) -> float:
        a, b, get, exp, log1p = 0.0, self.b, self.__getitem__, math.exp, math.log1p
        for s in _SENTENCE.findall((text or "").lower()):
            e = sum(map(get, set(s.split())))
            if e > 0:
                z = b + e
                a += log1p(exp(z)) if z < 30 else z
        return -math.expm1(-a)

    def sentences(self, text: str | None) -> list[dict]:
        """Place and score of the sentences with a score of a half or more."""
        out = []
        for m in _SENTENCE.finditer(text or ""):
            z = self.b + sum(map(self.__getitem__, set(m[0].lower().split())))
            if z >= 0:
                out.append({"start": m.start(), "end": m.end(), "score": 1 / (1 + math.exp(-z))})
        return out


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN,
        max_chars: int = MAX_CHARS) -> tuple[np.ndarray, float]:
    """Trains from the bounded sample; the driver gets at most (max_toxic + max_clean) * max_chars characters."""
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    short = docs.filter(F.length("text") <= max_chars).select("doc_id", "text")
    order = F.xxhash64("doc_id")
    here = known.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = [here.filter(F.col("toxic") == v).orderBy(order, "doc_id").limit(n) for v, n in ((1, max_toxic), (0, max_clean))]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))         # at most max_toxic + max_clean rows
    # one row an id, however often it is repeated
    rows = short.join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (str(r.doc_id), r.text))
    return train([r.text for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], carry: bool = False) -> DataFrame:
    """doc_id, score and offending sentences of every whole text; with ``carry`` also the row itself, as a struct.

    The session's batches are kept short from here on: the caller writes the rows.
    """
    keep_batches_short(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    at = text_at(docs) if carry else None        # the text goes to the workers once

    def run(it):
        held("scorer", dict).clear()                 # other operators' tables go
        s = Scorer(*shared.value)
        for b in cut(it if at is None else with_text(it, at)):
            texts = b.column("text").to_pylist()
            p = [s.document(t) for t in texts]
            found = [s.sentences(t) if x >= 0.3 else [] for x, t in zip(p, texts)]
            rest = [b.column("row")] if carry else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array(found, spans), *rest],
                                             names=["doc_id", "score", "sentences", *["row"] * carry])

    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry
    out = docs.select("doc_id", *[F.col("text").cast("string").alias("text")] * (at is None), *row)
    kind = f"doc_id {key}, score double, sentences array<struct<start:bigint,end:bigint,score:double>>"
    return out.mapInArrow(run, kind + (f", row {out.schema['row'].dataType.simpleString()}" if carry else ""))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted 0, with the columns they had."""
    return score(docs, fit(docs, labels), carry=True).filter(F.col("score") < 0.5).select("row.*")
