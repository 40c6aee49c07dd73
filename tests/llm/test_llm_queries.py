"""The registered queries against their SQL, and the pipeline stage by stage."""

import os
from collections import Counter

import pytest
from conftest import SF, compare

import corpus_pipeline
from veilsight.llm import queries, stages

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, name, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = stages.toxicity(spark, docs, SF).cache()
    assert clean.columns == docs.columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic - {r["doc_id"] for r in clean.collect()} - (toxic - rows.keys())) <= 0.02 * len(toxic)
    lines = stages.line_dedup(spark, clean, SF).cache()
    assert lines.columns == docs.columns and lines.count() == clean.count()
    near = stages.near_dedup(spark, lines, SF).cache()
    assert near.columns == docs.columns and 0 < near.count() <= lines.count()
    mixed = stages.mixing(spark, near, SF).cache()
    assert mixed.columns == docs.columns
    packed = stages.packing(spark, mixed, SF)
    assert packed.where("piece = 0").count() == mixed.count()
    for x in (clean, lines, near, mixed):
        x.unpersist()


def test_the_pipeline_runs_its_stages_one_after_another(spark, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    facts = ("doc_id", "piece", "start", "length", "ids_crc32")
    want = Counter(tuple(r) for r in docs.select(*facts).collect())
    assert Counter(tuple(r) for r in got.select(*facts).collect()) == want and want
    # sequences hold 2048 tokens at most, laid end to end
    ends = {}
    for r in got.orderBy("sequence_id", "offset").collect():
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
