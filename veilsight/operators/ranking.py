"""Orders over a whole table without a task that sees all of it."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilsight.session import checkpoint

#: Tables of so many rows at most are ordered in one task.
ONE_TASK_ROWS = 200_000
#: Rows that a bin of random draws holds, about, and strata whose facts are broadcast at most.
BIN_ROWS, BROADCAST_STRATA = 4096, 100_000


def _beside(df: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """df with the facts of its group, nulls together; facts are counted, and broadcast within the bound."""
    named = facts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[c for c in facts.columns if c not in by])
    near = F.broadcast(named) if named.count() <= BROADCAST_STRATA else named
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    return df.join(near, functools.reduce(lambda x, y: x & y, same)).drop(*[f"_by{i}" for i in range(len(by))])


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], mins: dict[str, Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """df with running sums and minima over an order that leaves no ties, in each group of the columns by.

    Larger tables are range-partitioned by group and order; each part runs by
    itself and starts from what the parts before it came to in the group, a row
    a part and group.  So all groups take one pass, however many and however
    large they are.
    """
    mins, by = mins or {}, by or []
    df = df.select("*", *[v.alias(f"_{k}") for k, v in {**sums, **mins}.items()])
    small = df.limit(ONE_TASK_ROWS + 1).count() <= ONE_TASK_ROWS
    if small:
        df = df.withColumn("_part", F.lit(0))
    else:
        df = checkpoint(df.repartitionByRange(*[F.col(c).asc() for c in by], *order).withColumn("_part", F.spark_partition_id()))
    groups = by if small else ["_part", *by]
    upto = (Window.partitionBy(*groups) if groups else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.select(
        *[c for c in df.columns if not c.startswith("_") or c == "_part"],
        *[F.sum(f"_{k}").over(upto).alias(k) for k in sums],
        *[F.min(f"_{k}").over(upto).alias(k) for k in mins],
    )
    if small:
        return out.drop("_part")
    before = (Window.partitionBy(*by) if by else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("_part", *by).agg(*[F.sum(f"_{k}").alias(k) for k in sums], *[F.min(f"_{k}").alias(k) for k in mins])
    parts = checkpoint(parts.select("_part", *by, *[F.sum(k).over(before).alias(f"_{k}") for k in sums], *[F.min(k).over(before).alias(f"_{k}") for k in mins]))
    out = _beside(out, parts, groups)
    for k in sums:
        out = out.withColumn(k, F.col(k) + F.coalesce(F.col(f"_{k}"), F.lit(0)))
    for k in mins:
        out = out.withColumn(k, F.least(k, f"_{k}"))
    return out.drop("_part", *[f"_{k}" for k in {**sums, **mins}])


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the average rank of each value; only distinct values are ordered."""
    values = df.groupBy(column).agg(F.count("*").alias("_n"))
    ranked = running(values.withColumnRenamed("_n", "n"), [F.col(column).asc()], {"upto": F.col("n")})
    ranked = ranked.select(F.col(column).alias("_v"), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(out))
    return df.join(ranked, df[column].eqNullSafe(ranked["_v"])).drop("_v")


def bh(df: DataFrame, p: str = "p_value", out: str = "q_value", by: list[str] | None = None) -> DataFrame:
    """df with Benjamini-Hochberg q of column p over all its rows, or over those of each group of the columns by (null p: null q, and not counted).

    q depends on group and p alone, so only distinct ones are ordered: first
    upwards to count, then downwards for the least.  All groups are ordered
    together.  df is computed once.
    """
    by = by or []
    df = checkpoint(df)
    values = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("n"))
    counted = running(values, [F.col(p).asc()], {"upto": F.col("n")}, by=by)
    total = values.groupBy(*by).agg(F.sum("n").alias("m"))
    if by:
        raw = _beside(counted, checkpoint(total), by)
    else:
        raw = counted.crossJoin(F.broadcast(total))  # one row
    best = running(raw.withColumn("raw", F.col(p) * F.col("m") / F.col("upto")), [F.col(p).desc()], {}, {"least": F.col("raw")}, by)
    best = best.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(p).alias("_p"), F.least(F.lit(1.0), "least").alias(out))
    same = [F.col(p) == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]]
    return df.join(best, functools.reduce(lambda x, y: x & y, same), "left").drop("_p", *[f"_by{i}" for i in range(len(by))])


def take_lowest(df: DataFrame, rank: str, caps: DataFrame | int, stratum: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """The rows of the lowest rank, as many as the cap of their stratum.

    rank is a number above 0, best a random one; caps is a number for all or a
    table (stratum, cap), a null cap keeping all.  Ranks fall into bins by
    their size, of which there are more for more rows; bins' counts find each
    stratum's last bin, and only its rows are sorted.  tie names columns that
    settle equal ranks.
    """
    s = F.lit("") if stratum is None else stratum.cast("string")
    # a bin is a 256th of a factor of two or less, so that about BIN_ROWS fall into the last one of random ranks
    per = 256 << max(0, math.ceil(math.log2(max(1, df.count() / (256 * BIN_ROWS)))))
    rows = df.withColumn("_s", s).withColumn("_bin", F.floor(F.log2(F.col(rank)) * per))
    bins = rows.groupBy("_s", "_bin").agg(F.count("*").alias("n"))
    caps = bins.select("_s").distinct().withColumn("cap", F.lit(caps).cast("long")) if isinstance(caps, int) else caps.select(F.col(caps.columns[0]).cast("string").alias("_s"), F.col(caps.columns[1]).cast("long").alias("cap"))
    upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("_s").orderBy("_bin")))
    cut = upto.join(caps, "_s").where((F.col("upto") > F.col("cap")))
    cut = cut.groupBy("_s").agg(F.min(F.struct("_bin", "upto", "n", "cap")).alias("c"))
    cut = cut.select("_s", F.col("c._bin").alias("_last"), (F.col("c.cap") - F.col("c.upto") + F.col("c.n")).alias("_room"))
    cut = checkpoint(cut)
    # a row a stratum: counted, and broadcast within the bound, so that rows do not move for it
    joined = rows.join(F.broadcast(cut) if cut.count() <= BROADCAST_STRATA else cut, "_s", "left")
    inside = joined.where(F.col("_last").isNull() | (F.col("_bin") < F.col("_last")))
    edge = joined.where(F.col("_bin") == F.col("_last"))
    by = Window.partitionBy("_s").orderBy(rank, *(tie or []))
    edge = edge.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= F.col("_room")).drop("_rn")
    return inside.unionByName(edge).drop("_s", "_bin", "_last", "_room")


def quantile_bins(df: DataFrame, order: list[Column], n_bins: int, out: str = "bin") -> DataFrame:
    """df cut into n_bins runs of an order without ties, 1 to n_bins, the earlier ones a row larger where rows don't divide."""
    n = df.count()
    placed = running(df, order, {"at": F.lit(1)})
    size, rest = divmod(n, n_bins)
    big = rest * (size + 1)
    at = F.col("at") - 1
    late = F.floor((at - big) / size) + rest if size else F.lit(0)
    return placed.withColumn(out, (F.when(at < big, F.floor(at / (size + 1))).otherwise(late) + 1).cast("int")).drop("at")

