"""Quality rules by tokenizer fertility (operator 8).

Each whole text is measured with a public vocabulary, word by word: characters per token, share
of byte-fallback tokens, and entropy of its token distribution. Rejection bands come from the
corpus itself: per language (per script where no language is given) and per length class, the
quartiles of each measure over all distinct measured texts that pass the base rules. Entropy grows
with length, so it counts as what it lies above or below a curve, fitted per language to all
lengths (least squares; a parabola in the logarithm of the characters), and has one scale for all
of them. A text is rejected when

* characters per token and entropy together lie more than ``width`` spreads below the medians
  (root of the sum of squares of what each lacks),
* characters per token lie more than ``high`` spreads above the median, or
* the byte-fallback share lies more than ``high`` spreads and ``BYTE_MARGIN`` above the median,

where a spread is the distance of the quartiles over 1.349 (a standard deviation, for normal
values). Length classes are half octaves of the characters in words (tokens would gather the junk in
the longer classes, since it takes more of them a word); a class with fewer than ``least`` texts takes
the bands of its two octaves, and where those have too few as well the bands of all lengths. A
language with fewer than ``least`` texts takes the bands of all texts of the text's script, and where
those are too few as well the curve of the whole corpus: by entropy alone, since characters per
token and bytes tell scripts apart, not junk from text. Only a corpus of fewer than ``least`` distinct texts
has no bands. Copies count once in the bands, so a text that a third of the corpus repeats doesn't
move them.

Base rules: fewer than 50 words, or more than half of the words in 3-word windows that occur
twice or more in the text.

Cases: null text counts as empty (no words, base rules fail). A null or empty ``lang`` takes
the script of most letters. Words are runs of other than ASCII white space. An empty table gives
no rows. Rows are measured each on its own; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import KEPT_CHARS, READ_ROWS, cut, held, short_batches, stored, text_at, with_text

MIN_WORDS = 50
WIDTH = 5.0
HIGH = 8.0
BYTE_MARGIN = 0.05
LEAST = 30
#: The length class of all lengths, and the group of all texts.
ALL = -1000
ANY = "any"
#: More bands than this (languages times length classes) are joined, not broadcast.
BROADCAST_ROWS = 20_000

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")


@cache
def _script_of() -> np.ndarray:
    """For each code point the number of its script in SCRIPTS, len(SCRIPTS) for those of none."""
    out = np.full(0x110000, len(SCRIPTS), np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for k, s in enumerate(SCRIPTS):
        for m in regex.finditer(rf"\p{{{s}}}+", every):
            out[m.start():m.end()] = k
    return out


def main_script(text: str) -> str:
    """The script of most letters; "none" without letters of a listed script."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_script_of()[codes], minlength=len(SCRIPTS))[:len(SCRIPTS)]
    return SCRIPTS[int(n.argmax())] if n.any() else "none"


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids = np.fromiter(map({}.setdefault, words, count()), np.int64, n)
    if n < 1 << 20:
        key = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        key = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1] * n + ids[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k:n - 2 + k] |= twice
    return int(mark.sum())


def base_measures(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(bytes([c])) for c in SPACE)
    return (len(words), chars, sum(text.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words))


class Vocabulary(dict):
    """Ids of each word by a sentencepiece model, as 16-bit integers; starts again when full."""

    def __init__(self, path: str, limit: int = 500_000):
        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.fallback = np.array([self.sp.is_byte(i) for i in range(n)])
        self.kind = np.uint16 if n <= 65536 else np.uint32
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        got = np.array(self.sp.encode(word.decode("utf-8", "replace")), self.kind).tobytes()
        if len(word) <= 4 * KEPT_CHARS:            # bytes
            if len(self) > self.limit:
                self.clear()
            self[word] = got
        return got

    def measure(self, words: list[bytes]) -> tuple[int, int, float]:
        """Tokens, byte-fallback tokens, and entropy in bits."""
        ids = np.frombuffer(b"".join(map(self.__getitem__, words)), self.kind)
        n = len(ids)
        if not n:
            return 0, 0, 0.0
        share = np.unique(ids, return_counts=True)[1] / n
        return n, int(self.fallback[ids].sum()), max(0.0, float(-(share * np.log2(share)).sum()))


_MEASURES = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
             "n_tokens bigint, n_fallback bigint, entropy double, band_group string, script_group string")


def measures(docs: DataFrame, path: str, carry: bool = False) -> DataFrame:
    """doc_id and the measures of every whole text; with ``carry`` also the row itself, as a struct."""
    key = docs.schema["doc_id"].dataType.simpleString()
    at = text_at(docs) if carry else None        # the text goes to the workers once

    def run(it):
        v = held(("vocabulary", path), lambda: Vocabulary(path))
        for b in cut(it if at is None else with_text(it, at)):
            rows = []
            for text, lang in zip(b.column("text").cast(pa.binary()).fill_null(b"").to_pylist(), b.column("lang").to_pylist()):
                words = text.split()
                script = main_script(text.decode("utf-8", "replace"))
                group = f"language {lang}" if lang else f"no language, {script}"
                rows.append((*base_measures(text, words), *v.measure(words), group, f"script {script}"))
            columns = [pa.array(x, pa.float64() if k == 7 else pa.string() if k >= 8 else pa.int64())
                       for k, x in enumerate(zip(*rows))]
            names = ["doc_id", *(x.split()[0] for x in _MEASURES.split(", "))]
            if carry:
                columns.append(b.column("row"))
                names.append("row")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=names)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry
    out = docs.select("doc_id", *[text.alias("text")] * (at is None), lang.alias("lang"), *row)
    return out.mapInArrow(run, f"doc_id {key}, {_MEASURES}" + (f", row {out.schema['row'].dataType.simpleString()}" if carry else ""))


def curves(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """Per group of ``least`` texts or more: entropy over length as a parabola, by least squares."""
    x, y = F.col("length"), F.col("entropy")
    means = {"x": x, "q": x * x, "y": y, "xq": x * x * x, "qq": x * x * x * x, "xy": x * y, "qy": x * x * y}
    out = texts.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(k) for k, v in means.items()]).filter(F.col("n") >= least)
    c = {"xx": F.expr("q - x * x"), "xq": F.expr("xq - x * q"), "qq": F.expr("qq - q * q"), "xy": F.expr("xy - x * y"), "qy": F.expr("qy - q * y")}
    det = c["xx"] * c["qq"] - c["xq"] * c["xq"]
    one, three = c["xx"] > 1e-9, det > 1e-6 * c["xx"] * c["qq"]           # more than one length, and more than two
    slope = F.when(one & three, (c["qq"] * c["xy"] - c["xq"] * c["qy"]) / det).when(one, c["xy"] / c["xx"]).otherwise(0.0)
    bend = F.when(one & three, (c["xx"] * c["qy"] - c["xq"] * c["xy"]) / det).otherwise(0.0)
    return (out.select("group", slope.alias("slope"), bend.alias("bend"), "x", "q", "y")
            .select("group", "slope", "bend", F.expr("y - slope * x - bend * q").alias("base")))


def above_curve(length, entropy):
    """What the entropy has above the curve of its group."""
    return entropy - (F.col("base") + F.col("slope") * length + F.col("bend") * length * length)


def bands(texts: DataFrame, known: DataFrame, least: int = LEAST) -> DataFrame:
    """Quartiles per group and length class (and per two octaves, for classes with few texts, and over all lengths)."""
    fit = texts.join(known, "group").withColumn("entropy", above_curve(F.col("length"), F.col("entropy")))
    classes = F.array("octave", -F.floor(F.col("octave") / 4) - 1, F.lit(ALL).cast("bigint"))      # of two octaves: -1, -2, ...
    quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in ("per_token", "fallback", "entropy")]
    return (fit.withColumn("octave", F.explode(classes)).groupBy("group", "octave")
            .agg(F.count(F.lit(1)).alias("n"), *quartiles).filter(F.col("n") >= least))


def judge(docs: DataFrame, path: str, width: float = WIDTH, high: float = HIGH, least: int = LEAST, carry: bool = False) -> DataFrame:
    """The measures of every document, base_failed, the fertility measures and kept (and the row, with ``carry``)."""
    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    m = measures(docs, path, carry)
    m = (m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
         .withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("word_chars") / F.col("n_tokens")))
         .withColumn("fallback", F.when(F.col("n_tokens") > 0, F.col("n_fallback") / F.col("n_tokens")))
         .withColumn("octave", F.floor(2 * F.log2(F.greatest(F.col("word_chars"), F.lit(1)).cast("double"))))
         .withColumn("length", F.log(F.greatest(F.col("word_chars"), F.lit(1)).cast("double")) - 7))
    with short_batches(docs.sparkSession, read_rows=READ_ROWS):
        m = stored(m, "measures")
    texts = (m.filter(~F.col("base_failed") & (F.col("n_tokens") > 0))
             .select("band_group", "script_group", "octave", "length", "per_token", "fallback", "entropy").distinct()
             .withColumn("group", F.explode(F.array("band_group", "script_group", F.lit(ANY)))).drop("band_group", "script_group"))
    texts = stored(texts, "texts")
    known = small(stored(curves(texts, least), "curves"))
    b = small(stored(bands(texts, known, least), "bands"))
    own, script = known.select(F.col("group").alias("own")), known.select(F.col("group").alias("script"))
    m = (m.join(own, F.col("band_group") == F.col("own"), "left").join(script, F.col("script_group") == F.col("script"), "left")
         .withColumn("group", F.coalesce("own", "script", F.lit(ANY))).join(known, "group", "left")
         .withColumn("above", above_curve(F.col("length"), F.col("entropy"))))
    fine, wide, every = b.alias("f"), b.alias("w"), b.filter(F.col("octave") == ALL).alias("a")
    x = (m.alias("m")
         .join(fine, (F.col("m.group") == F.col("f.group")) & (F.col("m.octave") == F.col("f.octave")), "left")
         .join(wide, (F.col("m.group") == F.col("w.group")) & (-F.floor(F.col("m.octave") / 4) - 1 == F.col("w.octave")), "left")
         .join(every, F.col("m.group") == F.col("a.group"), "left"))

    def spreads(value: str, q):
        spread = F.greatest((q[2] - q[0]) / 1.349, F.lit(1e-6))
        return (F.col(f"m.{value}") - q[1]) / spread, F.col(f"m.{value}") - q[1]

    def by_length(c: str):
        q = F.when(F.col("f.n").isNotNull(), F.col(f"f.{c}")).when(F.col("w.n").isNotNull(), F.col(f"w.{c}")).otherwise(F.col(f"a.{c}"))
        return spreads(c, F.when(F.col("m.group") != ANY, q))

    per_token, entropy = F.coalesce(by_length("per_token")[0], F.lit(0.0)), F.coalesce(spreads("above", F.col("a.entropy"))[0], F.lit(0.0))
    fallback, margin = by_length("fallback")
    below = F.sqrt(F.pow(F.least(per_token, F.lit(0.0)), F.lit(2.0)) + F.pow(F.least(entropy, F.lit(0.0)), F.lit(2.0)))
    rejected = F.coalesce((below > width) | (per_token > high) | ((fallback > high) & (margin > BYTE_MARGIN)), F.lit(False))
    return x.select("m.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "m.base_failed",
                    (~F.col("m.base_failed") & ~rejected).alias("kept"), "m.n_tokens",
                    F.col("m.per_token").alias("chars_per_token"), F.col("m.fallback").alias("fallback_share"), F.col("m.entropy").alias("token_entropy"),
                    *[F.col("m.row")] * carry)


def keep_good(docs: DataFrame, path: str) -> DataFrame:
    """The documents that the rules keep, with the columns they had."""
    return judge(docs, path, carry=True).filter("kept").select("row.*")
