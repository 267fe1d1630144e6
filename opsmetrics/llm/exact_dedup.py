"""Exact duplicates by a tree-merge of sorted digest runs (operator 10); DataFrame functions only.

Every row belongs to one of ``runs`` runs, by a hash of its id. A run is the list of its
distinct texts, one row each: SHA-256 digest, byte length and a second hash (the verification),
the identifier that stays, and the number of copies. In each round ``fan_in`` neighbouring runs
exchange their rows and merge into one: equal digests whose length and second hash agree too
become one row that retains the identifier to keep and the sum of the counts. After the last
round one run is left, spread over all tasks by digest. Each row then learns its result down
the same tree: a run's rows look theirs up in the run that they were merged into, so at most
``fan_in`` rows meet on a key at any level, whatever the size of the group of copies. A row of
the table meets its own run only, so a group with a third of all rows is spread over all runs.

Cases: null text counts as the empty text; no normalisation, so texts are equal when their
bytes are. ``keep`` = "max" keeps the largest id, "min" the smallest; ids must be unique and
not null (a row with a null id is never kept unless its whole group has null ids, and then all
rows of the group report a null ``keep_id`` and ``kept`` = false). An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.common import stored

#: Runs that merge into one in a round.
FAN_IN = 16

_TEXT = ["digest", "n_bytes", "check"]


def digests(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, length, second hash and run of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).cast("int").alias("run"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                 runs: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    runs = runs or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    best = F.max if keep == "max" else F.min
    rows = stored(digests(docs, runs, id_col, text_col), "digests")

    level = rows.groupBy("run", *_TEXT).agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    levels, width = [level], runs
    while width > 1:
        level = (level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
                 .groupBy("run", *_TEXT).agg(best("keep_id").alias("keep_id"), F.sum("copies").alias("copies")))
        levels.append(level)
        width = -(-width // fan_in)

    result = levels[-1]
    for lower in reversed(levels[:-1]):
        up = result.withColumnRenamed("run", "above")
        own = lower.select("run", *_TEXT, F.floor(F.col("run") / fan_in).cast("int").alias("above"))
        result = own.join(up, ["above", *_TEXT]).drop("above")
    out = rows.join(result, ["run", *_TEXT])
    return out.select(
        F.col("id").alias(id_col), "keep_id", F.col("copies").cast("bigint").alias("group_size"),
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they had; of rows equal in id and text one stays.

    A text whose rows all have a null id keeps one of them.
    """
    groups = exact_groups(docs, keep=keep)
    stay = groups.filter("kept").select("doc_id").distinct()
    unnamed = groups.filter("keep_id is null").select(F.col("text_sha256").alias("__text_digest")).distinct()
    text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    dealt = docs.withColumn("__text_digest", text)
    named = dealt.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "__text_digest"])
    lone = dealt.filter("doc_id is null").dropDuplicates(["__text_digest"]).join(unnamed, "__text_digest", "left_semi")
    return named.select(*docs.columns).unionByName(lone.select(*docs.columns))
