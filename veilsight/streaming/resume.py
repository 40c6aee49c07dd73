"""Resumable labelling: each micro-batch labels what no batch before has, and writes it once.

Which keys are done is state of the stream, kept by key and read by key, so a
batch costs what it holds, however many came before it.  A batch goes to a
folder of its own number, overwritten if the batch runs again, so that a lost
executor or driver leaves no half-written or repeated rows.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from veilsight.operators.annotation import not_done

#: Keys' state lies on disk, and a batch writes what it has changed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
PROGRESS = "query string, batch long, at string, rows_read long, rows_fresh long, state_rows long, seconds double"


class Progress(StreamingQueryListener):
    """A row for each batch of its queries that has ended: rows read, rows that no batch had before, keys done so far and seconds."""

    def __init__(self) -> None:
        self.queries: set[str] = set()
        self.seen: dict[tuple[str, int], tuple] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        if not p.get("numInputRows"):
            return
        seen = p.get("observedMetrics", {}).get("fresh", {})
        state = sum(x["numRowsTotal"] for x in p.get("stateOperators", []))
        # a batch that runs again, or is told of twice, has one row
        self.seen[p["id"], p["batchId"]] = (p["id"], p["batchId"], p["timestamp"], p["numInputRows"], seen.get("rows"), state, p["durationMs"].get("triggerExecution", 0) / 1000)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r for (query, _), r in self.seen.items() if query in self.queries], PROGRESS)


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_name(checkpoint: str) -> str:
    """What the rows of a run are kept under; a run is what one checkpoint folder knows of."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def earlier(spark: SparkSession, out: str, run: str) -> DataFrame | None:
    """What other runs have left in out, of which this one's state knows nothing; None if there is nothing."""
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    names = [s.getPath().getName() for s in files.listStatus(root)]
    if not any(n.startswith("run=") and n != f"run={run}" for n in names):
        return None
    rows = spark.read.parquet(out)
    return rows.where(rows["run"] != run)


def label_stream(
    spark: SparkSession, source: str, schema: str, key: list[str], step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_a_batch: int = 16, progress: Progress | None = None
) -> StreamingQuery:
    """Starts a query over the Parquet files that are in source and ends when they are done; step labels rows.

    Of rows with one key, one is labelled.  Rows go to out/run=.../batch=...;
    what other runs have written there counts as done and is read once a batch.
    progress, if given, gets a row a batch.
    """
    run = run_name(checkpoint)
    done = earlier(spark, out, run)
    done = None if done is None else done.select(*key)

    def batch(rows: DataFrame, number: int) -> None:
        fresh = rows if done is None else not_done(rows, done, key)
        step(fresh).write.mode("overwrite").parquet(f"{out}/run={run}/batch={number}")

    if progress is not None:
        spark.streams.addListener(progress)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    fresh = stream.dropDuplicates(key).observe("fresh", F.count(F.lit(1)).alias("rows"))
    with _settings(spark, STATE):
        query = fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if progress is not None:
        progress.queries.add(str(query.id))
    return query
