import os

import pytest

import corpus_pipeline
from recordloom.llm import decontaminate, registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], DATA).cache())
    counts = [d.count() for d in seen]
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 0
    assert all(d.columns == docs.columns for d in seen[:5])
    assert seen[3].exceptAll(seen[2]).count() > 0
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.contamination(seen[4], bench).where("n_hit > 0").count() == 0
    assert {r.doc_id for r in seen[5].select("doc_id").distinct().collect()} == {r.doc_id for r in seen[4].select("doc_id").collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = labels.where("quality = 1").join(docs, "doc_id")
    assert good.join(seen[1], "doc_id", "left_anti").count() <= 0.02 * good.count()


def test_registry_names():
    names = ["op1_minhash_dedup", "op2_sharding", "op3_ogg_media", "op4_quality", "op5_preference_format", "op6_substring_dedup", "op7_decontamination", "op8_url_filter", "op9_packing", "op10_suffix_dedup", "op11_personal_data", "op12_lexical_search", "op13_conversation_repair"]
    assert sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == names
    assert set(registry.ORACLES) <= set(registry.QUERIES)
