"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(app: str = "veilsight", **conf: str) -> SparkSession:
    """A session with the settings this library relies on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:
    """df, and the counters that fill while it is computed: rows, and further aggregates by name."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()]), seen


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names (a temporary one only where it is unset and all tasks run in this process)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilsight-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a folder of its own in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read back: for wide rows that several steps read in part."""
    at = new_folder(df.sparkSession, "written")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def checkpoint(df: DataFrame) -> DataFrame:
    """df read back from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
