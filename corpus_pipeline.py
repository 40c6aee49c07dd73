"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing to target weights, packing.

Each stage reads what the one before has written, as Parquet in the shared
folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veilsight.llm import stages
from veilsight.llm.common import ensure_checkpoint_dir, remove

STAGES = [
    ("toxicity", stages.toxicity),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: The classifier and the packing are not SQL.  Tests compare line dedup, near-dedup, mixing and packing with brute-force versions,
#: and the decoder and classifier of toxicity with all readings of short words and with held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
