"""The pipeline on the smallest given tables: every stage alone against what it says."""

import os

import pytest

import corpus_pipeline
from maskmill.llm import near_dedup, pii

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = [n for n, _ in corpus_pipeline.STAGES], {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        assert docs.count() <= before.count() and docs.join(before, "doc_id", "left_anti").count() == 0
        if name != names[-1]:
            assert docs.columns == before.columns
    assert len(names) == 5
    assert near_dedup.near_duplicates(seen["near_duplicates"]).where("NOT kept").count() == 0
    assert seen["personal_data"].count() == seen["decontamination"].count() == seen["mixture"].count()
    assert not [r for r in seen["personal_data"].collect() if pii.base_spans(r["text"] or "")]
    assert seen["mixture"].select("mix_position").distinct().count() == seen["mixture"].count()
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in docs.collect())
