"""Distributions behind thresholds: histograms, percentiles, support-1 spans, frequency grids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsight.config import FREQ_EDGES, FREQ_GRID, PREPOSITIONS, RARE_EDGES, RATE_EDGES, SUPPORT1_GRID


def value_shares(df: DataFrame, by: str) -> DataFrame:
    """Values with n and percent, the most frequent first."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("_all"))
    return n.crossJoin(F.broadcast(whole)).select(by, "n", (F.col("n") * 100.0 / F.col("_all")).alias("percent")).orderBy(F.desc("n"), by)  # one row


def rate_by(df: DataFrame, by: str, what: Column) -> DataFrame:
    return df.groupBy(by).agg(F.avg(what.cast("int")).alias("rate"), F.count("*").alias("n"))


def percentiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """share and value, interpolated between the two nearest rows."""
    found = df.agg(F.percentile(column, [float(s) for s in shares]).alias("v"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("v").alias("value"))
    return found.select(F.explode(pairs).alias("p")).select(F.col("p.share").alias("share"), F.col("p.value").alias("value"))


def target_bins(df: DataFrame, column: str = "y_combined") -> DataFrame:
    """lo, hi, n: half steps below 6, steps of two from there, the last closed at both ends; empty bins left out."""
    top = df.agg(F.greatest(F.lit(6.0), F.ceil(F.max(column) / 2) * 2.0).alias("_end"))
    y = F.col(column)
    wide = F.floor((y - 6) / 2) * 2 + 6
    # the edges end at the first even number that no value is above
    lo = F.when(y < 6, F.floor(y * 2) / 2).when((wide >= F.col("_end")) & (F.col("_end") > 6), F.col("_end") - 2).otherwise(wide)
    rows = df.crossJoin(F.broadcast(top)).select(lo.cast("double").alias("lo"))  # one row
    return rows.groupBy("lo").agg(F.count("*").alias("n")).select("lo", (F.col("lo") + F.when(F.col("lo") < 6, 0.5).otherwise(2.0)).alias("hi"), "n").orderBy("lo")


def weighted_bins(df: DataFrame, column: str = "y_risk", weight: str = "lds_weight") -> DataFrame:
    """hi, n, n_percent, weight_percent of half steps closed above, the first one closed below too."""
    hi = F.greatest(F.lit(0.5), F.ceil(F.col(column) * 2) / 2)
    g = df.groupBy(hi.alias("hi")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    whole = g.agg(F.sum("n").alias("_n"), F.sum("w").alias("_w"))
    return g.crossJoin(F.broadcast(whole)).select("hi", "n", (F.col("n") * 100.0 / F.col("_n")).alias("n_percent"), (F.col("w") * 100.0 / F.greatest(F.lit(1e-9), F.col("_w"))).alias("weight_percent")).orderBy("hi")  # one row


def frequency_bins(phrases: DataFrame, edges: tuple[int, ...] = FREQ_EDGES) -> DataFrame:
    """lo, n, percent of every bin closed below; what is outside goes to the end bins."""
    out = F.lit(edges[0])
    for e in edges[1:-1]:
        out = F.when(F.col("freq") >= e, F.lit(e)).otherwise(out)
    n = phrases.groupBy(out.cast("long").alias("lo")).agg(F.count("*").alias("n"))
    grid = phrases.sparkSession.createDataFrame([(int(e),) for e in edges[:-1]], "lo long")
    whole = n.agg(F.sum("n").alias("_all"))
    return grid.join(n, "lo", "left").crossJoin(whole).select("lo", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) * 100.0 / F.col("_all")).alias("percent")).orderBy("lo")  # one row


def _nearest_above(grid: tuple[int, ...], nearest: int):
    """Of each part of the rows: how many are above each k, and the nearest of them in a heap of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, above, heaps = 0, dict.fromkeys(grid, 0), {k: pa.table({"freq": pa.array([], pa.int64()), "phrase": pa.array([], pa.string())}) for k in grid}
        for batch in batches:
            rows = pa.table({"freq": batch.column(1), "phrase": batch.column(0)})
            every += rows.num_rows
            for k in grid:
                over = rows.filter(pc.greater(rows["freq"], k))
                above[k] += over.num_rows
                held = pa.concat_tables([heaps[k], over])
                heaps[k] = held.take(pc.select_k_unstable(held, nearest, sort_keys=[("freq", "ascending"), ("phrase", "descending")])) if held.num_rows > nearest else held
        for k in grid:
            near = pa.array([heaps[k].to_pylist()], pa.list_(pa.struct([("freq", pa.int64()), ("phrase", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([every], pa.int64()), pa.array([above[k]], pa.int64()), near], ["k", "every", "dropped", "near"])

    return run


def frequency_grid(phrases: DataFrame, grid: tuple[int, ...] = FREQ_GRID, nearest: int = 6) -> DataFrame:
    """k, dropped (phrases of a frequency above k), percent, and the dropped ones nearest to k, largest first.

    Phrases are read once: each part counts and keeps its nearest few for every
    k, and a few rows a part are put together.  Of equal frequencies the last
    by name is the nearest, and named first.
    """
    kept = "k long, every long, dropped long, near array<struct<freq:long,phrase:string>>"
    parts = phrases.select(F.col("phrase").cast("string"), F.col("freq").cast("long")).mapInArrow(_nearest_above(tuple(int(k) for k in grid), nearest), kept)
    sums = parts.groupBy("k").agg(F.sum("every").alias("every"), F.sum("dropped").alias("dropped"), F.flatten(F.collect_list("near")).alias("near"))

    def order(a: Column, b: Column) -> Column:
        low = (a["freq"] < b["freq"]) | ((a["freq"] == b["freq"]) & (a["phrase"] > b["phrase"]))
        return F.when(low, -1).when((a["freq"] == b["freq"]) & (a["phrase"] == b["phrase"]), 0).otherwise(1)

    first = F.sort_array(F.slice(F.array_sort("near", order), 1, nearest), asc=False)
    named = F.array_join(F.transform(first, lambda p: F.concat(p["phrase"], F.lit("("), p["freq"].cast("string"), F.lit(")"))), ", ")
    return sums.select("k", "dropped", (F.col("dropped") * 100.0 / F.greatest(F.lit(1), "every")).alias("percent"), named.alias("nearest")).orderBy(F.desc("k"))


def with_record_rate(phrases: DataFrame, terms: DataFrame, n: DataFrame) -> DataFrame:
    """Phrases with the records that have them and their percentage; null where terms don't know them."""
    joined = phrases.join(terms.select(F.col("term").alias("phrase"), "record_count"), "phrase", "left").crossJoin(F.broadcast(n))  # one row
    return joined.withColumn("record_percent", F.col("record_count") * 100.0 / F.col("N")).drop("N")


def rate_buckets(terms: DataFrame, n: DataFrame, edges: tuple[tuple[int, int], ...] = RATE_EDGES) -> DataFrame:
    """lo, n, percent of terms by the percentage of records that have them; every bucket, the highest first."""
    rate = F.col("record_count") * 100.0 / F.col("N")
    bucket = F.lit(None).cast("int")
    for lo, hi in edges:
        bucket = F.when((rate >= lo) & (rate < hi), F.lit(lo)).otherwise(bucket)
    counted = terms.crossJoin(F.broadcast(n)).groupBy(bucket.alias("lo")).agg(F.count("*").alias("n"))  # one row
    grid = terms.sparkSession.createDataFrame([(lo,) for lo, _ in edges], "lo int")
    whole = terms.agg(F.count("*").alias("_all"))
    return grid.join(counted, "lo", "left").crossJoin(whole).select("lo", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) * 100.0 / F.col("_all")).alias("percent")).orderBy(F.desc("lo"))  # one row


def support_sizes(scored: DataFrame) -> DataFrame:
    """part (all, support1, support2), size, n, percent of PROFILE spans."""
    rows = scored.where("provenance = 'PROFILE'")
    parts = F.array_compact(F.array(F.lit("all"), F.when(F.col("support") == 1, F.lit("support1")), F.when(F.col("support") >= 2, F.lit("support2"))))
    n = rows.select("size", F.explode(parts).alias("part")).groupBy("part", "size").agg(F.count("*").alias("n"))
    whole = n.groupBy("part").agg(F.sum("n").alias("_all"))
    return n.join(F.broadcast(whole), "part").select("part", "size", "n", (F.col("n") * 100.0 / F.col("_all")).alias("percent")).orderBy("part", "size")  # three rows


def support1_wording(scored: DataFrame) -> DataFrame:
    """One row over PROFILE spans of support 1: spans, those with a phrase of several words, and with a preposition in one."""
    words = lambda p: F.split(F.trim(p), r"\s+")
    several = F.exists("qi", lambda p: F.size(words(p)) >= 2)
    prep = F.exists("qi", lambda p: F.exists(words(p), lambda w: w.isin(*PREPOSITIONS)))
    return scored.where("provenance = 'PROFILE' AND support = 1 AND size > 0").agg(F.count("*").alias("spans"), F.count_if(several).alias("several_words"), F.count_if(prep).alias("preposition"))


def support1_words(scored: DataFrame) -> DataFrame:
    """words and n: the phrases of PROFILE spans of support 1 by their number of words."""
    flat = scored.where("provenance = 'PROFILE' AND support = 1").select(F.explode("qi").alias("p"))
    return flat.groupBy(F.size(F.split(F.trim("p"), r"\s+")).alias("words")).agg(F.count("*").alias("n")).orderBy("words")


def support1_rarest(scored: DataFrame, terms: DataFrame) -> DataFrame:
    """uses and n: distinct support-1 spans by the records of their rarest term (0 if unknown)."""
    flat = scored.where("provenance = 'PROFILE' AND support = 1 AND size > 0").select("text", "qi", F.explode("qi").alias("term"))
    rare = flat.join(terms.select("term", "record_count"), "term", "left").groupBy("text").agg(F.min(F.coalesce("record_count", F.lit(0))).alias("rarest"))
    return rare.groupBy("rarest").agg(F.count("*").alias("n"))


def support1_grid(rarest: DataFrame, grid: tuple[int, ...] = SUPPORT1_GRID) -> DataFrame:
    """k, affected, percent: support-1 spans whose rarest term is in fewer than k records."""
    one = rarest.agg(F.sum("n").alias("_all"), *[F.sum(F.when(F.col("rarest") < k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in grid])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("affected")) for k in grid])
    return one.select("_all", F.explode(rows).alias("r")).select("r.k", F.coalesce("r.affected", F.lit(0)).alias("affected"), (F.coalesce("r.affected", F.lit(0)) * 100.0 / F.greatest(F.lit(1), F.coalesce("_all", F.lit(0)))).alias("percent")).orderBy("k")


def support1_rare_bins(rarest: DataFrame, edges: tuple[tuple[int, int], ...] = RARE_EDGES) -> DataFrame:
    """lo, n: support-1 spans by ranges of their rarest term's records."""
    one = rarest.agg(*[F.sum(F.when(F.col("rarest").between(lo, hi), F.col("n")).otherwise(0)).alias(f"n{lo}") for lo, hi in edges])
    rows = F.array(*[F.struct(F.lit(lo).alias("lo"), F.col(f"n{lo}").alias("n")) for lo, _ in edges])
    return one.select(F.explode(rows).alias("r")).select("r.lo", F.coalesce("r.n", F.lit(0)).alias("n")).orderBy("lo")
