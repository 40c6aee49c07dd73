"""Mixing sources to target weights by Pareto order sampling.

A source's target in words follows from its weight.  A document's inclusion is
its expected number of copies, in proportion to the document's own weight, which
grows with its length or comes with it, and at most the cap: whole copies are
certain, and the rest is an inclusion chance p.  Documents rank by random odds over inclusion odds,
u/(1-u) / (p/(1-p)), and each source takes a prefix of the ranking, of the size
that comes nearest to what the whole copies leave of its target.

No source is ranked in one task: the ranks fall into equal bins, the bins'
sums find each source's last bin, and only that bin's rows are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilsight.llm.common import checkpoint, hashes_of, n_words, number_copies, record_of

#: Rows that the sorted bin of a source holds at most, about.
BIN_ROWS = 4096
#: Facts of so many sources at most are broadcast; beyond, joins shuffle them.
BROADCAST_SOURCES = 50_000


def uniform(seed: int, *keys: Column) -> Column:
    """A draw in (0, 1) from 52 bits of an md5; SQL engines agree on it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float = 1.5, weights: Sequence[int] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """Target words of each source.

    sizes has a row a source: source, source_size.  Sources in code point
    order, null last, weigh weights[0], weights[1], ... in turn and share
    share * all words.  A target stops at cap * source_size; the excess goes
    to the others by weight until none is above.

    That is water filling: the sources that stop are those with the least
    room a weight, so one ordered pass finds the level.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    ahead = by_room.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.col("all_words") - F.coalesce(F.col("stopped"), F.lit(0.0))) / F.col("weights_left")
    filled = (
        sizes.withColumn("weight", weight.cast("double"))
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("stopped", F.sum("most").over(ahead))
        .withColumn("weights_left", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        # the level is the first that does not exceed its source's room
        .withColumn("fits", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "level"))).over(Window.partitionBy())["level"])
    )
    return filled.select(
        "source",
        "source_size",
        F.least("most", F.coalesce(F.col("fits") * F.col("weight"), F.col("most"))).alias("target"),
    )


def _levels(classes: DataFrame, cap: float) -> DataFrame:
    """source and level: what a weight of 1 is included with, so that a source's classes, none above cap, make up its target.

    classes has a row a source and weight: source, like, words, target.  The
    heaviest reach the cap first, so one ordered pass finds the level, as for
    targets; it is null where all reach the cap.
    """
    heaviest = Window.partitionBy("source").orderBy(F.desc("like"))
    left = F.col("target") - F.lit(float(cap)) * F.coalesce(F.sum("words").over(heaviest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    liked = F.sum(F.col("like") * F.col("words")).over(heaviest.rowsBetween(0, Window.unboundedFollowing))
    found = classes.select("source", "like", (left / liked).alias("level"))
    return found.groupBy("source").agg(F.max_by("level", F.when(F.col("level") * F.col("like") <= cap, F.col("like"))).alias("level"))


def mix(
    df: DataFrame,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    share: float = 1.5,
    weights: Sequence[int] = (3, 1, 2),
    cap: int = 2,
    seed: int = 29,
    weight_col: str | None = None,
    longer: Sequence[tuple[int, float]] = ((0, 1.0), (64, 1.5), (512, 2.0)),
) -> DataFrame:
    """Rows of df as column record (struct of all columns) with size, source_size, target, copies.

    size counts the words of the text (null: 0); copies (0..cap) is how often
    the mix takes the document, the same in every run.  longer gives weights
    by size, a row for each size from which one holds; weight_col, if given,
    holds finite weights above 0 instead, null weighing 1, that count to the
    nearest sixteenth of a factor of two.  Inside a source, inclusion is in
    proportion to weight, and copies stop at cap.  A null source is a source.
    Repeated rows are sampled one by one, whether alike in the key alone or in
    all columns.  A source without words takes nothing.  An empty table gives
    an empty result.
    """
    if weight_col:
        like = F.pow(F.lit(2.0), F.round(16 * F.log2(df[weight_col].cast("double"))) / 16)
        like = F.coalesce(like, F.lit(1.0))
    else:
        like = F.lit(1.0)
        for least, weight in sorted(longer):
            like = F.when(F.col("size") >= least, F.lit(float(weight))).otherwise(like)
    rows = df.select(
        record_of(df).alias("record"),
        df[source].alias("source"),
        df[key].alias("key"),
        n_words(df[text]).alias("size"),
        F.md5(df[text].cast("binary")).alias("text_md5"),
        *([like.alias("like")] if weight_col else []),
        *hashes_of(df, seed),
    )
    rows = rows if weight_col else rows.withColumn("like", like)
    rows = number_copies(rows).withColumn("u", uniform(seed, F.col("key"), F.col("text_md5"), F.col("copy"))).drop("text_md5")
    small = checkpoint(rows.drop("record"))  # so that texts are read once for this and once for the result
    classes = checkpoint(small.groupBy("source", "like").agg(F.sum("size").alias("words"), F.count("*").alias("rows")))
    stats = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows"))
    n_sources, n_rows = stats.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    n_bins = 1 << max(8, math.ceil(math.log2(max(1, n_rows / BIN_ROWS))))
    by_source = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda x: x

    def with_source(x: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
        facts = facts.withColumnRenamed("source", "_s")
        return x.join(by_source(facts), x["source"].eqNullSafe(facts["_s"]), how).drop("_s")

    aims = checkpoint(targets(stats.select("source", "source_size"), share, weights, cap))
    levels = _levels(with_source(classes.where("words > 0").select("source", "like", "words"), aims.select("source", "target")), cap)
    goal = checkpoint(with_source(aims, levels, "left"))

    def ranked(x: DataFrame) -> DataFrame:
        """Adds the source's facts, whole copies, and the rank in 0..1 by odds over odds."""
        copies = F.coalesce(F.least(F.lit(float(cap)), F.col("level") * F.col("like")), F.lit(float(cap)))
        p = F.col("inclusion") - F.col("whole")
        odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
        return (
            with_source(x, goal)
            .withColumn("inclusion", F.when(F.col("source_size") > 0, copies).otherwise(0.0))
            .withColumn("whole", F.floor("inclusion"))
            .withColumn("rank", F.when(p > 0, odds / (1 + odds)).otherwise(1.0))
            .withColumn("bin", F.least(F.floor(F.col("rank") * n_bins), F.lit(n_bins - 1)))
        )

    may = F.col("rank") < 1.0
    sums = (
        ranked(small)
        .groupBy("source", "bin")
        .agg(F.sum(F.when(may, F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    )
    last = (
        sums.withColumn("left", F.col("target") - F.sum("certain").over(Window.partitionBy("source")))
        .withColumn("till", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        .where((F.col("till") >= F.col("left")) | (F.col("bin") == n_bins - 1))
        .groupBy("source")
        .agg(F.min(F.struct("bin", "till", "words", "left")).alias("x"))
        .select("source", F.col("x.bin").alias("last_bin"), (F.col("x.till") - F.col("x.words")).alias("before"), F.col("x.left").alias("left"))
    )
    place = ("rank", "key", "size", "h1", "h2", "copy")
    in_order = Window.partitionBy("source").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(in_order)
    cut = (
        with_source(ranked(small).where(may), last)
        .where(F.col("bin") == F.col("last_bin"))
        .withColumn("upto", upto)
        # the prefix nearest to what is left: a row belongs to it if its middle does
        .where(2 * F.col("upto") - F.col("size") <= 2 * F.col("left"))
        .groupBy("source")
        .agg(F.max(F.struct(*place)).alias("cut"))
    )
    ends = checkpoint(with_source(last.select("source", "last_bin"), cut, "left"))
    in_last = (F.col("bin") == F.col("last_bin")) & F.coalesce(F.struct(*place) <= F.col("cut"), F.lit(False))
    taken = may & ((F.col("bin") < F.coalesce(F.col("last_bin"), F.lit(n_bins))) | in_last)
    return with_source(ranked(rows), ends, "left").select(
        "record", "size", "source_size", "target", (F.col("whole") + F.when(taken, 1).otherwise(0)).cast("int").alias("copies")
    )
