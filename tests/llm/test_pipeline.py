"""The stages one by one on awkward documents, and the whole on the smallest tables."""

import corpus_pipeline
from tests.llm.conftest import SF


def test_stages(spark, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for (name, stage), _ in zip(corpus_pipeline.STAGES[:-1], range(4), strict=True):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        keys = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "line_dedup":
            assert len(keys) == docs.count()
        if name == "near_dedup":
            assert not {20, 21, 23, 24, 26} & set(keys) and {0, 22, 25} <= set(keys)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < 200
    assert corpus_pipeline.ORACLE_SQL is None
