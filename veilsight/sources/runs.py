"""Runs of equal keys in the order in which files hold their rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilsight.session import checkpoint

#: Blocks of files are narrow rows; so many at most are broadcast.
BROADCAST_BLOCKS = 200_000


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows of a file source with _file and _block, the file and the byte at which the block that holds them begins.

    Readers give the rows of a block in the file's order, and a block to one task.
    """
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _number(width: int):
    """Adds to each row its number in its block and the number of the run there; the last columns are key, file and block.

    Only the last row seen is kept from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, row, at = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, file, block = (batch.column(width + i) for i in range(3))
            # one code a distinct value, so that neighbours are compared as numbers, nulls together
            code = [pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in (key, file, block)]
            here = tuple(c[0].as_py() for c in (key, file, block))
            steps = [np.append(last is None or x != y, c[1:] != c[:-1]) for x, y, c in zip(here, last or here, code, strict=True)]
            fresh = steps[1] | steps[2]
            # runs begun and rows seen since the block began, or since the last batch
            begun, place = np.cumsum(steps[0] & ~fresh), np.arange(batch.num_rows)
            since = np.maximum.accumulate(np.where(fresh, place, -1))
            local = np.where(since >= 0, begun - begun[since], at + begun)
            place = np.where(since >= 0, place - since, row + 1 + place)
            last, row, at = tuple(c[-1].as_py() for c in (key, file, block)), int(place[-1]), int(local[-1])
            columns = [*batch.columns[:width], key, file, block, pa.array(place, pa.int64()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_row", "_local"])

    return run


def runs_of(rows: DataFrame, key: str) -> DataFrame:
    """rows of a file source with run, the number of the run of equal keys that they are in, from 0 in file order; nulls are equal.

    A key that comes back later begins another run.  Files count in the order
    of their paths.  Each block numbers its own runs as it is read; then a row a
    block (first key, last key, runs) tells where the next block goes on, so that
    a run may cross any number of blocks and files, and rows themselves never
    move.
    """
    whole = in_file_order(rows)
    given = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("_key", rows.schema[key].dataType), T.StructField("_file", T.StringType()), T.StructField("_block", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("_local", T.LongType())])
    numbered = checkpoint(whole.select(*given, F.col(key).alias("_key"), "_file", "_block").mapInArrow(_number(len(given)), schema))
    ends = numbered.groupBy("_file", "_block").agg(F.min_by(F.struct("_key"), "_row").alias("first"), F.max_by(F.struct("_key"), "_row").alias("last"), F.max("_local").alias("more"))
    order = Window.orderBy("_file", "_block")  # a row a block
    joins = F.coalesce(F.lag("last").over(order)["_key"].eqNullSafe(F.col("first._key")) & F.lag("last").over(order).isNotNull(), F.lit(False))
    ends = ends.withColumn("joins", joins.cast("long"))
    # a block's runs begin where those before it ended, one earlier if the first goes on with the last of them
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("more") + 1).over(before), F.lit(0)) - F.sum("joins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    starts = checkpoint(ends.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), start.alias("_start")))
    near = F.broadcast(starts) if starts.count() <= BROADCAST_BLOCKS else starts
    placed = numbered.join(near, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return placed.select(*given, (F.col("_start") + F.col("_local")).alias("run"), "_file", "_block", "_row")


def grouped_runs(rows: DataFrame, key: str, items: list[str]) -> DataFrame:
    """run, key and items: one row a run, its items in file order as structs of the named columns."""
    item = F.struct("_file", "_block", "_row", *items)
    out = runs_of(rows, key).groupBy("run").agg(F.first(key).alias(key), F.array_sort(F.collect_list(item)).alias("items"))
    return out.withColumn("items", F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in items])))
