"""Rows with everything that an operator must take: nulls, blanks, long texts, copies, clashing columns."""

from pyspark.sql import functions as F

WORDS = "the of and river stone house quiet garden morning light winter paper letter train".split()


def prose(seed, n):
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice((".", ",", "")) if r.random() < 0.2 else "") for _ in range(n))


ODD = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, "one", ""), (5, "a b c d", "de"),
    (6, prose(1, 60), "en"), (7, prose(1, 60), "en"), (8, prose(1, 60), None), (9, prose(2, 4000), "fr"),
    (10, "x" * 30000, "en"), (11, "it's  we'll\n\n<|endoftext|> 漢字 🙂 naïve £5\u00a0\x85", "en"),
    (12, "ab" * 4000 + " tail", "es"), (13, "\x00\x1c odd", "en"), (14, "word " * 300, "en"), (15, "<|startoftext|>", "en"),
]


def documents(spark, rows=None, clash=()):
    """Documents from (doc_id, text, lang); ``clash``: extra columns of these names."""
    rows = ODD if rows is None else rows
    df = spark.createDataFrame([(i, t, x, "src", None if t is None else len(t)) for i, t, x in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in clash:
        df = df.withColumn(c, F.lit("extra"))
    return df


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
