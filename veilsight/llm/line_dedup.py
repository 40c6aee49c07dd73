"""Line deduplication across documents.

Lines are normalised and hashed; a hash found in enough distinct documents
keeps its lines only in the smallest of them; documents are put together from
the lines left, in their order.  Only hashes and positions are exchanged for
the counting; each text moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsight.llm.common import BLANKS, ascii_lower, checkpoint


def keys_of_lines(text: Column) -> Column:
    """The text's lines, each stripped of blanks at both ends and A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))


def _hash(c: Column) -> list[Column]:
    """128 bits: two seeds of a 64-bit hash."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(59), c).alias("h2")]


def drop_shared_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Rows of df as column record (struct of all columns) with n_lines, n_dropped, kept.

    A line's key of at least min_chars code points that at least min_docs
    distinct values of df[key] hold loses its lines except in the smallest of
    those values.  kept joins the other lines by newline.  A null or empty
    text is one empty line.  Rows with equal key count as one document.  Rows
    with a null key are one document too, the largest.  An empty table gives
    an empty result.
    """
    rows = df.select(
        F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("record"),
        df[key].alias("key"),
        F.coalesce(df[text], F.lit("")).alias("text"),
    )
    # rows that share a key may differ in text, so both tell where a position belongs
    lines = rows.select("key", F.xxhash64("text").alias("text_hash"), F.posexplode(keys_of_lines(F.col("text"))).alias("pos", "line"))
    hashes = checkpoint(lines.where(F.char_length("line") >= min_chars).select("key", "text_hash", "pos", *_hash(F.col("line"))))
    found = hashes.groupBy("h1", "h2")
    if min_docs <= 2:
        shared = found.agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max(F.col("key").isNull()).alias("none"))
        if min_docs == 2:
            shared = shared.where((F.col("first") < F.col("last")) | (F.col("none") & F.col("first").isNotNull()))
    else:
        per_doc = hashes.groupBy("h1", "h2", "key").agg(F.lit(1).alias("one"))
        shared = per_doc.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    dropped = (
        hashes.join(shared.select("h1", "h2", "first"), ["h1", "h2"])
        .where(~F.col("key").eqNullSafe(F.col("first")))
        .groupBy("key", "text_hash")
        .agg(F.collect_set("pos").alias("drop"))
        .select(F.col("key").alias("k"), F.col("text_hash").alias("h"), "drop")
    )
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    joined = rows.join(dropped.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left")
    split = F.split("text", "\n", -1)

    def others(lines: Column) -> Column:
        # a difference of arrays hashes positions, so that it takes as long as the lines and the dropped ones together
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "drop")
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    # a transform of one element names the lines, so that they are split once
    kept = F.element_at(F.transform(F.array(split), others), 1)
    breaks = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    return joined.select(
        "record",
        (F.when(F.col("drop").isNull(), breaks + 1).otherwise(F.size(split))).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )
