"""The pipeline's stages one after another, each held against its own input."""

from collections import Counter

import corpus_pipeline
from textloom.llm import packing
from textloom.llm.common import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = materialize(stage(spark, docs, sf), "stage")
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == names
    assert before.count() > 0 and seen[1] < seen[0]
    tokens = packing.token_counts(before, "text", "n", keep=["doc_id"])
    want = Counter()
    for r in tokens.collect():
        want[r.doc_id] += r.n
    got = Counter()
    for r in docs.collect():
        got[r.doc_id] += r.n_tokens
    assert got == +want


def test_run_equals_stages_and_takes_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "a text of few words", None, None, None), (3, "a text of few words", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.pack_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [(3, 0)]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
