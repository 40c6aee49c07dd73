"""Document fingerprints by spot signatures.

A spot is an anchor, a very common word; its signature is the chain of the
first content words after it.  A document's fingerprint is the set of its
signatures.  Documents are compared by the Jaccard similarity of these sets,
which sets of too different a size cannot reach: they are partitioned by
length, and only sets of the same or the next partition meet, through a
signature among the rarest of both.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilsight.llm.common import checkpoint

#: Fixed anchors: very common words of English, German, French and Spanish.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "have", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "which", "with", "you",
    "auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "avec", "dans", "du", "et", "la", "le", "les", "ne", "par", "pas", "pour", "que", "qui", "sur", "une",
    "al", "con", "del", "el", "en", "las", "lo", "los", "no", "para", "por", "se", "su", "una", "y",
)
#: Content words of a chain, and the words after the anchor they are looked for in.
CHAIN, REACH = 3, 12


def signatures(text: Column, digits: int = 8) -> Column:
    """Sorted distinct signatures of a text, so many hex digits each; none of a null text or one without words.

    Words are runs of letters and digits of the lower-cased text.  The text's
    beginning counts as an anchor, so any word makes a signature.  In a text
    without anchors, as of another language, the words whose md5 begins with
    0 or 8, an eighth of all, stand for them.  Chains are shorter where there
    are fewer content words within reach.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    common = ["", *ANCHORS]

    def chains(w: Column) -> Column:
        listed = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.element_at(w, i).isin(common))
        drawn = F.filter(F.sequence(F.lit(2), F.size(w)), lambda i: F.substring(F.md5(F.element_at(w, i)), 1, 1).isin("0", "8"))
        spots = F.element_at(F.transform(F.array(listed), lambda s: F.when(F.size(s) > 1, s).otherwise(F.concat(s, drawn))), 1)

        def chain(i: Column) -> Column:
            content = F.filter(F.slice(w, i + 1, F.lit(REACH)), lambda x: ~x.isin(common))
            return F.substring(F.md5(F.array_join(F.concat(F.array(F.element_at(w, i)), F.slice(content, 1, CHAIN)), " ")), 1, digits)

        return F.array_sort(F.array_distinct(F.transform(spots, chain)))

    # a transform of one element names the words, so that they are made once
    named = F.transform(F.array(F.concat(F.array(F.lit("")), F.coalesce(words, F.array().cast("array<string>")))), lambda w: F.when(F.size(w) > 1, chains(w)))
    return F.coalesce(F.element_at(named, 1), F.array().cast("array<string>"))


def fingerprint(sigs: Column) -> Column:
    """The signatures end to end: all that comparing needs."""
    return F.array_join(sigs, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures; 1 of two empty ones."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(1.0)).otherwise(inter / union)


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of df: key, text, n_chars, sigs, next_head, next_sigs.

    Documents stand in falling order of key (null last), then of a hash of the
    text; after the last comes the first.  Rows alike in key and text are one
    document, and get the same.  next_head is the next text's
    beginning of a third of n_chars.  A null text is empty.  Only keys and
    lengths are ordered; texts move once, and a third of them once more.
    """
    docs = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    keys = docs.groupBy("key", "h", F.char_length("text").cast("long").alias("n")).agg(F.count("*").alias("rows"))
    spread = keys.repartitionByRange(F.col("key").desc_nulls_last(), F.col("h").desc())
    spread = checkpoint(spread.withColumn("part", F.spark_partition_id()))
    # parts in order; the ends of parts meet those of the next part that has rows
    falling = Window.partitionBy("part").orderBy(F.col("key").desc_nulls_last(), F.col("h").desc())
    here = F.struct("key", "h", "n")
    repeated = not spread.where("rows > 1").isEmpty()
    inner = spread.select("key", "h", "n", "part", F.lag(here).over(falling).alias("before"), F.lead(here).over(falling).alias("after"))
    # one row a part
    ends = inner.where("before IS NULL OR after IS NULL")
    first = ends.where("before IS NULL").select("part", here.alias("first"))
    last = ends.where("after IS NULL").select("part", here.alias("last"))
    parts = first.join(last, "part")
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = parts.select("part", F.coalesce(F.lag("last").over(by_part), F.last("last").over(whole)).alias("part_before"))
    placed = inner.join(met, "part").select(F.col("key").alias("k"), F.col("h").alias("kh"), F.coalesce("before", "part_before").alias("before"))
    placed = docs.join(placed, F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh")))
    placed = placed.select("key", "h", "text", "before", signatures(F.col("text")).alias("sigs"))
    heads = placed.select(
        F.col("before.key").alias("bk"),
        F.col("before.h").alias("bh"),
        F.substring("text", F.lit(1), F.floor(F.col("before.n") / 3).cast("int")).alias("next_head"),
        F.col("sigs").alias("next_sigs"),
    )
    heads = heads.dropDuplicates(["bk", "bh"]) if repeated else heads
    both = placed.join(heads, F.col("key").eqNullSafe(F.col("bk")) & (F.col("h") == F.col("bh")))
    return both.select("key", "text", F.char_length("text").cast("long").alias("n_chars"), "sigs", "next_head", "next_sigs")


def edited(text: Column, n_chars: Column, next_head: Column) -> Column:
    """The text with its last third replaced by the next document's beginning."""
    return F.concat(F.substring(text, F.lit(1), (n_chars - F.floor(n_chars / 3)).cast("int")), next_head)


def similar(df: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs of like classes, and membership.

    Documents with equal fingerprints are a class, named by its smallest key;
    those without signatures are in none.  Pairs have columns a, b (a < b) and
    likeness, at least threshold; membership has key and class.
    """
    docs = df.select(df[key].alias("key"), signatures(df[text], 16).alias("sigs")).where(F.size("sigs") > 0)
    docs = docs.withColumn("print", F.md5(fingerprint(F.col("sigs"))))
    classes = docs.groupBy("print").agg(F.min("key").alias("class"))
    members = docs.select("key", "print").join(classes, "print").select("key", "class")
    sets = checkpoint(docs.join(classes, "print").where("key <=> class").dropDuplicates(["class"]).select("class", "sigs", F.size("sigs").alias("n")))
    seen = sets.select("class", "n", F.explode("sigs").alias("sig"))
    ranked = seen.join(seen.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    rare = ranked.groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("sigs"))
    # of two sets this alike, the rarest of each have one in common
    keep = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int")
    part = F.floor(F.log("n") / -math.log(threshold) + 1e-9)
    rare = checkpoint(rare.select("class", "n", part.alias("part"), F.explode(F.slice("sigs", F.lit(1), keep)).alias("s")).select("class", "n", "part", "s.sig"))
    up = rare.select(F.col("class").alias("a"), F.col("n").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "sig")
    down = rare.select(F.col("class").alias("b"), F.col("n").alias("nb"), "part", "sig")
    # the smaller set looks among its own length and the next; of equals, the smaller key does
    met = up.join(down, ["part", "sig"]).where("(na < nb OR (na = nb AND a < b)) AND na >= nb * %r - 1e-9" % threshold).select("a", "b").distinct()
    left, right = sets.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    judged = met.join(left, "a").join(right, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"))).where(F.col("likeness") >= threshold)
    return judged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), members
