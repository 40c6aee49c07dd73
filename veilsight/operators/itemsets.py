"""Frequent combinations of attributes, grown by the prefixes that their sets have."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsight.operators.ranking import running
from veilsight.session import checkpoint

#: Items and combinations are broadcast up to so many, which are counted first.
BROADCAST_COMBOS = 100_000


def weighted_sets(sets: DataFrame) -> DataFrame:
    """Distinct non-empty sets (terms) with cnt, the records that have them."""
    return sets.where(F.size("terms") > 0).groupBy("terms").agg(F.count("*").alias("cnt"))


def minimum_count(total: int, min_support: float) -> int:
    """Below 1 a share of the records, else a count."""
    return max(1, math.ceil(min_support * total) if min_support < 1 else int(min_support))


def item_support(weighted: DataFrame) -> DataFrame:
    return weighted.select(F.explode("terms").alias("term"), "cnt").groupBy("term").agg(F.sum("cnt").alias("support_count"))


def frequent_itemsets(weighted: DataFrame, min_count: int, max_size: int = 0) -> DataFrame:
    """combo, size, support_count of every combination in min_count records at least, up to max_size terms (0: any).

    Terms are numbered from the most frequent one on, and each set becomes the
    numbers of its frequent terms, in that order.  A combination owns the
    prefixes that its sets have before its first term, equal ones together with
    the sum of their records; putting a term of a prefix in front makes the
    combinations of the next size, whose prefixes are what stands before that term.
    So the more sets a term is in, the shorter and the more alike its prefixes
    are, no candidate is made that no set has, and equal prefixes fall
    together before they move.
    """
    weighted = checkpoint(weighted.groupBy("terms").agg(F.sum("cnt").alias("cnt")))
    items = item_support(weighted).where(F.col("support_count") >= min_count)
    items = checkpoint(running(items, [F.desc("support_count"), F.col("term").asc()], {"at": F.lit(1)}))
    n_items = items.count()
    near = F.broadcast(items) if n_items <= BROADCAST_COMBOS else items
    flat = weighted.withColumn("set", F.xxhash64("terms")).select("set", "terms", "cnt", F.explode("terms").alias("term")).join(near.select("term", "at"), "term")
    sets = flat.groupBy("set", "terms").agg(F.first("cnt").alias("cnt"), F.array_sort(F.collect_list("at")).alias("numbers"))
    sets = sets.groupBy("numbers").agg(F.sum("cnt").alias("cnt"))
    # combinations stand as numbers, the last term first, with the prefix before it
    grown = sets.select(F.array().cast("array<bigint>").alias("combo"), F.col("numbers").alias("prefix"), "cnt")
    found, size = None, 0
    while True:
        size += 1
        step = grown.select("combo", F.posexplode("prefix").alias("i", "x"), "prefix", "cnt")
        step = step.select(F.concat(F.array("x"), "combo").alias("combo"), F.slice("prefix", F.lit(1), F.col("i")).alias("prefix"), "cnt")
        step = checkpoint(step.groupBy("combo", "prefix").agg(F.sum("cnt").alias("cnt")))
        level = checkpoint(step.groupBy("combo").agg(F.sum("cnt").alias("support_count")).where(F.col("support_count") >= min_count))
        n_level = level.count()
        if not n_level:
            break
        one = level.select("combo", F.lit(size).alias("size"), "support_count")
        found = one if found is None else found.unionByName(one)
        if size == max_size:
            break
        kept = level.select("combo")
        grown = step.where(F.size("prefix") > 0).join(F.broadcast(kept) if n_level <= BROADCAST_COMBOS else kept, "combo", "left_semi")
    if found is None:
        return weighted.limit(0).select(F.col("terms").alias("combo"), F.lit(0).alias("size"), F.col("cnt").alias("support_count"))
    named = found.withColumn("id", F.xxhash64("combo")).select("id", "combo", "size", "support_count", F.explode("combo").alias("at"))
    named = named.join(near.select("at", "term"), "at").groupBy("id", "combo", "size", "support_count").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return named.select(F.col("terms").alias("combo"), "size", "support_count")


def combinations(weighted: DataFrame, min_size: int = 3, max_size: int = 0, min_support: float = 0.001) -> DataFrame:
    """Frequent combinations of min_size terms or more with support_pct of the records, the most frequent first."""
    total = weighted.agg(F.sum("cnt")).first()[0] or 0
    found = frequent_itemsets(weighted, minimum_count(total, min_support), max_size).where(F.col("size") >= min_size)
    share = F.col("support_count") * 100.0 / F.lit(float(total)) if total else F.lit(0.0)
    return found.withColumn("support_pct", share).orderBy(F.desc("support_count"), "size", F.array_join("combo", ","))
