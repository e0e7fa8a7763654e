"""The pipeline on the smallest tables, stage by stage."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SF = os.environ.get("QUILLMATCH_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_pipeline(spark):
    import corpus_pipeline

    from quillmatch.llm import common, decontaminate, mixing, quality, simhash, tokens

    docs = common.table(spark, SF, "documents")
    n = docs.count()
    out = docs
    kept = {r["doc_id"] for r in quality.profile(docs).where("kept").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in out.select("doc_id").collect()}
        ids = None
        if stage is corpus_pipeline.near_dedup:
            ids = {r["doc_id"] for r in simhash.clusters(out).where("doc_id = component_id").collect()}
        elif stage is corpus_pipeline.decontamination:
            ids = before - {r["doc_id"] for r in decontaminate.leaks(out, common.table(spark, SF, "benchmark")).collect()}
        elif stage is corpus_pipeline.mixing_to_weights:
            ids = {r["doc_id"] for r in mixing.rates(out, common.table(spark, SF, "labels")).where("copies > 0").collect()}
        else:
            ids = kept
        out = common.materialize(stage(spark, out, SF), "test")
        assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == ids
    final = corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()
    assert len(final) == out.count() < n
    assert sorted(map(tuple, final)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert sorted(map(tuple, final)) == sorted(map(tuple, tokens.round_trip(out).collect()))
