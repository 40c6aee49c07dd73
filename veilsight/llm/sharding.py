"""Sharding by a two-pass external shuffle.

Pass one scatters records by seeded hashes: first to a shard, then to one of
the shard's buckets, of which there are so many that a bucket fits in memory.
Pass two permutes each bucket by Fisher-Yates, in a task of its own, and lays
the buckets of a shard end to end, which gives every record its slot.

The shard follows from the key and the number of shards alone.  Growing from
k to k+1 shards moves a record with chance 1/(k+1), and only into the new one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilsight.llm.common import hashes_of, number_copies, record_of

#: Starts of so many buckets at most are broadcast.
BROADCAST_BUCKETS = 1_000_000


def shard_of(key: Column, n_shards: int, seed: int = 17) -> Column:
    """Shard 0..n_shards-1 of a key: the last k whose draw moves the key into shard k when it is added."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    if n_shards == 1:
        return F.lit(0)
    drawn = F.filter(
        F.sequence(F.lit(1), F.lit(n_shards - 1)),
        lambda k: F.pmod(F.xxhash64(F.lit(seed), k, key), (k + 1).cast("long")) == 0,
    )
    return F.coalesce(F.array_max(drawn), F.lit(0))


def external_shuffle(
    df: DataFrame,
    n_shards: int = 40,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 17,
    bucket_bytes: int = 64 << 20,
) -> DataFrame:
    """Records of df with their place: columns record (struct of all columns), size, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 16.  slot is gapless from
    0 in each shard.  grown_shard is the shard there would be with one more.
    A null key is a key like any other.  Records with equal keys share a
    shard, but not a bucket; repeated rows are scattered one by one.  An empty
    table gives an empty result.  Columns of df keep their names inside
    record, so none can clash.

    Every bucket is a task's own, of about bucket_bytes of text, whatever the
    session's shuffle partitions are: so tasks fit in memory, and a bucket's
    permutation follows from the seed, its number and its records alone.  Runs
    agree on all slots, also those of a task that runs again.
    """
    sized = df.select(
        record_of(df).alias("record"),
        (F.coalesce(F.octet_length(df[text]), F.lit(0)) + 16).cast("long").alias("size"),
        shard_of(df[key], n_shards, seed).alias("shard"),
        *hashes_of(df, seed + 1),
    )
    largest = sized.groupBy("shard").agg(F.sum("size").alias("b")).agg(F.max("b")).first()[0] or 0
    n_buckets = max(1, math.ceil(largest / bucket_bytes))
    drawn = number_copies(sized).withColumn("draw", F.xxhash64("h1", "h2", "copy"))
    placed = drawn.withColumn("place", F.col("shard") * n_buckets + F.pmod("draw", F.lit(n_buckets)).cast("int"))
    order = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # a row a bucket
    starts = placed.groupBy("shard", "place").agg(F.count("*").alias("n")).select("place", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    held = placed.repartitionById(n_shards * n_buckets, F.col("place")).groupBy("place").agg(F.collect_list(F.struct("draw", "h1", "h2", "copy", "size", "shard", "record")).alias("held"))
    # one order to start from, whatever order the rows arrived in
    fields = ("draw", "h1", "h2", "copy")

    def before(a: Column, b: Column) -> Column:
        rule = F.lit(0)
        for f in reversed(fields):
            rule = F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(rule)
        return rule

    # shuffle() is the engine's inside-out Fisher-Yates, seeded by the seed and the partition's number, which is the bucket's
    dealt = held.select("place", F.posexplode(F.shuffle(F.array_sort("held", before), F.lit(seed))).alias("pos", "held"))
    starts = F.broadcast(starts) if n_shards * n_buckets <= BROADCAST_BUCKETS else starts
    return dealt.join(starts, "place").select(
        "held.record",
        "held.size",
        "held.shard",
        (F.col("start") + F.col("pos")).alias("slot"),
        shard_of(F.col("held.record").getField(key), n_shards + 1, seed).alias("grown_shard"),
    )
