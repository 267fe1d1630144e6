"""A training corpus from ``documents``: filters, duplicates, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and reread as the next one's docs. All but the last return
the columns of ``documents``, for the documents that stay.

1. quality: documents that fail the base rules or the fertility bands go.
2. toxicity: documents predicted toxic go; the model learns from the labels of those that came this far.
3. exact: of documents with equal text the one with the largest doc_id stays.
4. near: of documents linked by a similarity of 0.8 or more the one with the smallest doc_id stays.
5. packing: what is left is packed into sequences of at most 2048 tokens.

Cases: each stage takes what its operator takes (see its docstring): null and empty texts fail
the base rules of the first stage; a document without a doc_id can't be told apart from others
like it and leaves at the exact stage; an empty table gives an empty result; extra columns
are carried through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opsmetrics.llm import best_fit, dart_minhash, exact_dedup, fertility, toxicity
from opsmetrics.llm.common import stored, table
from opsmetrics.llm.queries import PIECE_BPE, WORD_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fertility.keep_good(docs, public_tokenizers.path(PIECE_BPE))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.pack(docs, public_tokenizers.path(WORD_BPE), end_id=0, capacity=2048)


STAGES = [("quality", quality), ("toxicity", harmless), ("exact", exact), ("near", near), ("packing", packing)]

#: The first, second and fourth stage can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
