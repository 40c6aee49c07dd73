"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last keep the columns of documents, and further ones, whatever their
names; the last has doc_id and the columns of packing.  An empty table gives an
empty result.  A null or empty text is a document like any other: it is never
toxic, has one empty line, is no near copy, and counts no words, so that mixing
leaves it out.  Repeated rows are judged alike, but mixed one by one.  Rows with
a null doc_id take part in every stage; where only they are alike, all stay,
as nothing tells which comes first.  Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsight.llm.common import checkpoint, record_of, table

TOXIC_FROM = 0.7


def _columns(docs: DataFrame, changed: dict | None = None) -> list:
    return [(changed or {}).get(c, F.col(f"record.`{c}`")).alias(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score TOXIC_FROM or more, by a model learned from all labelled documents that are here."""
    from veilsight.llm.toxicity import fit, labelled_texts, score_texts

    model = fit(docs, labelled_texts(docs, table(spark, sf_dir, "labels")))
    scored = score_texts(docs, model)
    return scored.where(F.col("score") < TOXIC_FROM).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; n_chars follows the text.  Documents keep their rows, whatever is left of them."""
    from veilsight.llm.line_dedup import drop_shared_lines

    kept = drop_shared_lines(docs, min_chars=10, min_docs=2)
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("record.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("record.n_chars"))
    return kept.select(*_columns(docs, changed))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near copies: five-word shingles, similarity 0.8.

    Rows that repeat the kept one, doc_id and text, stay with it.  A null doc_id
    is the largest, so rows with one go if a near copy has a doc_id.
    """
    from veilsight.llm.near_dedup import BROADCAST_ROWS, Plan, near_components

    gone = near_components(docs.select("doc_id", "text"), plan=Plan(share=80, words=5)).where("NOT kept")
    gone = checkpoint(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = docs.select(record_of(docs).alias("record"), docs["doc_id"].alias("key"), F.xxhash64(docs["text"]).alias("hash"))
    left = rows.join(gone, F.col("key").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    return left.select(*_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    from veilsight.llm.mixing import mix

    out = mix(docs, share=1.5, weights=(3, 1, 2), cap=2).where("copies > 0")
    return out.select("record", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    import public_tokenizers

    from veilsight.llm.packing import pack, tokenize

    return pack(tokenize(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0), capacity=2048)
