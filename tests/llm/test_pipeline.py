"""The stages one after the other."""

import corpus_pipeline
from visloom.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    before = {r["doc_id"] for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out = corpus_pipeline.Scratch(spark, "t").put(out, "out")
        after = {r["doc_id"] for r in out.collect()}
        assert after and after <= before
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs, before = out, after
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect()} == {
        tuple(r) for r in docs.select("doc_id", "piece", "ids_crc32").collect()
    }
