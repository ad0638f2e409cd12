import inspect

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from quillmark.llm.decontamination import contaminated
from quillmark.llm.privacy import find_private

TABLES = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "private_data", "packing"]
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{TABLES}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/t"
        stage(spark, docs, TABLES).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_each_stage_keeps_clean_documents_and_acts(spark, stages):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    for name in ("language_id", "near_dedup", "decontamination", "private_data"):
        assert stages[name].columns == docs.columns
    counts = {n: d.count() for n, d in stages.items()}
    assert 0.98 * docs.count() <= counts["language_id"] <= docs.count()
    assert counts["near_dedup"] < counts["language_id"] and stages["near_dedup"].select("text").distinct().count() == counts["near_dedup"]
    bench = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    leaked = contaminated(stages["near_dedup"], bench).select("doc_id").distinct()
    assert leaked.count() > 0 and counts["decontamination"] == counts["near_dedup"] - leaked.count()
    assert counts["private_data"] == counts["decontamination"]
    before = find_private(stages["decontamination"]).where("n_found > 0").select("doc_id")
    changed = stages["private_data"].join(stages["decontamination"], ["doc_id", "text"], "left_anti").select("doc_id")
    assert before.count() > 0 and sorted(before.collect()) == sorted(changed.collect())
    packed = stages["packing"]
    assert packed.select("doc_id").distinct().count() == counts["private_data"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, TABLES)
    assert sorted(got.drop("sequence_id", "offset").collect()) == sorted(stages["packing"].drop("sequence_id", "offset").collect())
