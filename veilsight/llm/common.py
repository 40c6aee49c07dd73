"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Space and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Narrow rows that a file of a scratch table holds at least, and the files that small tables have.
FILE_ROWS, FEWEST_FILES = 20_000, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is much faster than ``translate``, and the same where only A-Z
    are upper-case.
    """
    plain = (F.octet_length(c) == F.char_length(c)) | ~F.rlike(c, F.lit(r"[\x{80}-\x{10FFFF}&&[\p{IsUppercase}\p{Lt}]]"))
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a temporary one only where none is named and all tasks run in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilsight-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def record_of(df: DataFrame) -> Column:
    """All columns of df as a struct, in which no name can clash with an operator's own."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def hashes_of(df: DataFrame, seed: int) -> list[Column]:
    """128 bits of a row: two seeds of a 64-bit hash of all columns that can be hashed, as h1 and h2."""
    columns = [df[f"`{c}`"] for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return [F.xxhash64(F.lit(seed), *columns).alias("h1"), F.xxhash64(F.lit(seed + 1), *columns).alias("h2")]


def number_copies(rows: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """rows with column copy, numbering from 1 rows that are alike in h1 and h2, the hashes of all that they hold.

    Alike rows are counted before they move, so however many there are of a
    kind, one of them goes to a task and is unfolded there.  Where all rows
    differ, only hashes move.
    """
    repeated = checkpoint(rows.groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1"))
    n = repeated.count()
    if not n:
        return rows.withColumn("copy", F.lit(1).cast("long"))
    near = F.broadcast(repeated) if n <= broadcast_rows else repeated
    # the optimizer may not know that a sum of copies replaces them, so both parts read rows
    single = rows.join(near, ["h1", "h2"], "left_anti").withColumn("copy", F.lit(1).cast("long"))
    others = [c for c in rows.columns if c not in ("h1", "h2")]
    alike = rows.join(near, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first(F.struct(*others)).alias("_r"), F.count("*").alias("_n"))
    unfolded = alike.select("h1", "h2", F.col("_r.*"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("copy"))
    return single.unionByName(unfolded)


#: How to drop what operators remember in a worker from task to task, by the operator.
FORGET: dict[str, Callable[[], None]] = {}


def give_back(own: str | None = None) -> None:
    """In a worker: drops what operators other than own remember, and returns to the system what earlier tasks have left unused.

    Workers serve stage after stage, and their allocators keep what they have freed.
    """
    import gc

    for name, forget in FORGET.items():
        if name != own:
            forget()
    gc.collect()
    trim()


def trim() -> None:
    """Returns to the system what the allocators hold unused."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's own
        ctypes.CDLL(None).malloc_trim(0)


def returning(own: str | None = None, first: bool = True) -> Callable:
    """Makes a task's function return what it leaves when it ends, and with first what earlier ones left when it begins.

    A worker may lie idle through stages without Python, beside a JVM that needs the room.
    """

    def around(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        @functools.wraps(run)
        def task(batches: Iterator) -> Iterator:
            if first:
                give_back(own)
            try:
                yield from run(batches)
            finally:  # what run held is gone by now
                trim()

        return task

    return around


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written to the shared checkpoint folder, for loops.

    A written table has the size it has, where a checkpoint keeps the estimate
    of its plan: estimates multiply at each join, and after some rounds of
    joins they alone take the driver minutes.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder, self.n = spark, f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df as a written table; rows, about how many it has if known, keeps small ones in few files."""
        self.n += 1
        at = f"{self.folder}/{self.n}"
        (df if rows is None else df.coalesce(max(FEWEST_FILES, rows // FILE_ROWS))).write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def clear(self) -> None:
        """Removes the tables; only once all that was made of them is written elsewhere."""
        remove(self.spark, self.folder)
