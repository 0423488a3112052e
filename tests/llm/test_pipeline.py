"""The pipeline stage by stage."""

import corpus_pipeline


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, small), "test")
        assert docs.columns == columns
        assert 0 < docs.count() <= before, name
        before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["decoded"] for r in out} == texts
