"""The registered queries of the operators, at production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opsmetrics.llm import (best_fit, bpe_trie, dart_minhash, exact_dedup, fertility, geometric_search, html_crf, kruskal_runs,
                            one_permutation, token_counts, token_files, toxicity, url_filter)
from opsmetrics.llm.common import folder, table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=0, capacity=2048)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_groups(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE),
                                   folder(spark, "token-files"), end_id=2)
    return token_files.read_digests(spark, out).withColumnRenamed("id", "doc_id")


def op6_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op11_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_permutation.edited_strings(table(spark, sf_dir, "documents"))


def op12_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_kruskal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kruskal_runs.digests(table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_best_fit, op2_toxicity, op3_token_counts, op4_dart_minhash, op5_token_files, op6_html_crf, op7_bpe_trie,
        op8_fertility, op9_url_filter, op10_exact_dedup, op11_one_permutation, op12_geometric_blocks, op13_kruskal_runs)}


def all_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL, "op12_geometric_blocks": OP12_SQL}


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(body) AS text_sha256
FROM d WINDOW same AS (PARTITION BY body)
"""

#: The pattern of a term, its lower-casing and the two bounds of the score are fixed values of the contract.
OP12_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
size AS (SELECT count(*) AS docs, cast(sum(len(terms)) AS bigint) AS total FROM words WHERE len(terms) > 0),
posting AS (
    SELECT row_id, doc_id, n, term, cast(count(*) AS bigint) AS tf
    FROM (SELECT row_id, doc_id, cast(len(terms) AS bigint) AS n, unnest(terms) AS term FROM words)
    GROUP BY ALL),
weight AS (
    SELECT term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double)) AS bigint) AS w
    FROM posting, size GROUP BY term, docs),
asked AS (
    SELECT DISTINCT item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
scored AS (
    SELECT item_id, row_id, doc_id,
           cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS bigint) AS score
    FROM asked JOIN posting USING (term) JOIN weight USING (term), size
    GROUP BY item_id, row_id, doc_id),
ranked AS (
    SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS integer) AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
