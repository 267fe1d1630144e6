"""The pipeline: each stage's decision takes effect, and its rows are whole."""

import public_tokenizers as P
from test_duplicates import brute_classes
from test_filters import base, toxic_rows
from util import ODD, documents

import corpus_pipeline
from opsmetrics.llm import best_fit

CLASH = ("row", "kept", "v", "digest", "score")


def test_stages(spark, tmp_path):
    rows, labels = toxic_rows(300, 10_000)
    rows = rows + ODD + [(50_000 + k, rows[7][1], "en") for k in range(5)] + [(60_000, rows[8][1] + " added", "en"), (None, rows[9][1], "en")]
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    documents(spark, rows, clash=CLASH).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    left, toxic = list(rows), {i for i, t in labels if t}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == columns
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        if name == "quality":
            left = [r for r in left if not base(r[1])[-1]]
        elif name == "toxicity":
            left = [r for r in left if r[0] not in toxic]
        elif name == "exact":
            last = {}
            for r in left:
                if r[0] is not None:
                    last[r[1]] = max(last.get(r[1], (-1,)), r)
            left = [r for r in last.values()]
        else:
            classes = brute_classes(left)
            left = [r for r in left if classes[r[0]] == r[0]]
        assert got == sorted(((i, t) for i, t, _ in left), key=str), name
    assert {r.doc_id for r in docs.collect()} == {r[0] for r in left}
    whole = sum(r.length for r in docs.collect())
    alone = best_fit.token_pieces(documents(spark, left), P.path("word_bpe_49k.json"), 0).groupBy().sum("length").first()[0]
    assert whole == alone


def test_run_equals_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
