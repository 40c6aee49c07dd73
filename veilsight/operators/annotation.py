"""Clauses from records, resumable labelling, span tags, and the joins that make training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from veilsight.config import TEXT_FIELDS
from veilsight.functions.text import ClauseSplitter, RuleSplitter, let, resolve_field


def record_texts(records: DataFrame, key: str = "uuid", fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """uuid, field, field_pos, text_pos, text: a row a text of the fields that are there."""
    present = [f for f in fields if any(a in records.columns for a in (f, f"{f}_list", f.removesuffix("_list")))]
    made = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_pos"), resolve_field(records, f).alias("texts")) for i, f in enumerate(present)])
    rows = records.select(F.col(key).cast("string").alias("uuid"), F.explode(made).alias("f"))
    return rows.select("uuid", "f.field", "f.field_pos", F.posexplode("f.texts").alias("text_pos", "text"))


def clauses(texts: DataFrame, splitter: ClauseSplitter | None = None) -> DataFrame:
    """uuid, field, clause_pos, clause.  clause_pos counts through a field's texts in their order."""
    split = texts.withColumn("_c", (splitter or RuleSplitter()).split(F.col("text")))
    order = ["field_pos", "text_pos"] if "text_pos" in texts.columns else []
    if not order:
        return split.select("uuid", "field", F.posexplode("_c").alias("clause_pos", "clause"))
    before = Window.partitionBy("uuid", "field").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("_at", F.coalesce(F.sum(F.size("_c")).over(before), F.lit(0)))
    out = split.select("uuid", "field", "_at", F.posexplode("_c").alias("_p", "clause"))
    return out.select("uuid", "field", (F.col("_at") + F.col("_p")).cast("int").alias("clause_pos"), "clause")


def not_done(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among those done; repeats within rows stay."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def label(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], labels: tuple[str, ...], text: str = "clause") -> DataFrame:
    """Rows with label, score and probs from the logits an injected model gives for batches of texts.

    Each partition is sorted by length, so that a batch holds like texts.
    """

    @arrow_udf("array<double>")
    def logits(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([list(map(float, x)) for x in model([t or "" for t in column.to_pylist()])], pa.list_(pa.float64()))

    scored = rows.sortWithinPartitions(F.length(text)).withColumn("_p", softmax(logits(F.col(text))))
    return scored.select(*rows.columns, argmax(F.col("_p"), labels).alias("label"), F.array_max("_p").alias("score"), F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.col("_p")).alias("probs"))


def softmax(logits: Column) -> Column:
    def shares(powers: Column) -> Column:
        return let(F.aggregate(powers, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(powers, lambda x: x / total))

    return let(logits, lambda a: let(F.array_max(a), lambda top: let(F.transform(a, lambda x: F.exp(x - top)), shares)))


def argmax(probs: Column, labels: tuple[str, ...]) -> Column:
    """The label of the largest probability, the first of equals."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(probs, F.array_max(probs)).cast("int"))


def clip_and_threshold(score: Column, threshold: float = 0.5) -> tuple[Column, Column]:
    """Score cut to 0..1, and 1 where it reaches the threshold."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score.cast("double")))
    return clipped, (clipped >= threshold).cast("int")


def first_per_text(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each text."""
    columns = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(text).agg(F.min(columns).alias("_r")).select("_r.*")


def candidate_sentences(rows: DataFrame, text: str = "sentence", label: str = "NONE") -> DataFrame:
    """Distinct sentences' pieces between Japanese marks, with a constant label."""
    pieces = F.filter(F.transform(F.split(text, "[、。]", -1), F.trim), lambda x: x != "")
    return rows.select(text).distinct().select(F.explode(pieces).alias("candidate"), F.col(text).alias("text"), F.lit(label).alias("label"))


def span_annotations(rows: DataFrame) -> DataFrame:
    """A row a text with its candidates other than NONE as spans; a text of NONE alone has no spans."""
    one = F.when(F.col("label") != "NONE", F.struct("candidate", "label"))
    return rows.groupBy("text").agg(F.array_sort(F.array_distinct(F.collect_list(one))).alias("spans"))


def find_all(tokens: Column, piece: Column) -> Column:
    """Places, from 1, where a piece's tokens stand one after another."""
    n = F.size(piece)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - n + 1))
    return F.filter(places, lambda i: (n > 0) & (F.slice(tokens, i, n) == piece))


def bio_tags(tokens: Column, spans: Column) -> Column:
    """B-, I- and O tags of tokens; spans is an array of (piece, label), earlier spans taking precedence."""
    def places(t: Column) -> Column:
        one = lambda s: F.transform(find_all(t, s["piece"]), lambda i: F.named_struct(F.lit("at"), i, F.lit("n"), F.size(s["piece"]), F.lit("label"), s["label"]))
        return F.flatten(F.transform(spans, one))

    def tag(found: Column, i: Column) -> Column:
        over = F.get(F.filter(found, lambda f: (i >= f["at"]) & (i < f["at"] + f["n"])), F.lit(0))
        return let(over, lambda one: F.when(one.isNull(), F.lit("O")).otherwise(F.concat(F.when(one["at"] == i, F.lit("B-")).otherwise(F.lit("I-")), one["label"])))

    return let(tokens, lambda t: let(places(t), lambda found: F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: tag(found, i))))


def entity_vote(tags: Column, first: Column, length: Column) -> Column:
    """The label most tags in a range have, the first to appear of equals; NONE without any."""
    part = F.filter(F.slice(tags, first, length), lambda t: F.startswith(t, F.lit("B-")) | F.startswith(t, F.lit("I-")))

    def most(names: Column) -> Column:
        count = lambda n, i: F.named_struct(F.lit("n"), F.size(F.filter(names, lambda m: m == n)), F.lit("i"), -i, F.lit("name"), n)
        return F.array_max(F.transform(F.array_distinct(names), count))["name"]

    return F.coalesce(let(F.transform(part, lambda t: F.substring(t, F.lit(3), F.length(t))), most), F.lit("NONE"))


def candidate_labels(annotations: DataFrame, predictions: DataFrame, order: str | None = None) -> DataFrame:
    """text, candidate, y_true and y_pred: each annotated candidate with the label its tokens' predicted tags vote for.

    annotations has text, candidate, label and piece, the candidate's tokens;
    predictions has text, tokens and tags, and counts the last of several by
    the column that order names; without one a text must have one row.
    Candidates of texts without a prediction are left out; one that does not
    stand in its text is NONE.
    """
    made = F.struct("tokens", "tags")
    if order is None:
        several = F.assert_true(F.count("*") == 1, F.lit("a text has several predictions: name the column that orders them"))
        one = predictions.groupBy("text").agg(F.first(made).alias("_p"), several.alias("_one")).where("_one IS NULL").drop("_one")
    else:
        one = predictions.groupBy("text").agg(F.max_by(made, order).alias("_p"))
    met = annotations.join(one, "text").withColumn("_at", find_all(F.col("_p.tokens"), F.col("piece")))
    tags = F.flatten(F.transform("_at", lambda i: F.slice(F.col("_p.tags"), i, F.size("piece"))))
    voted = F.when(F.size("_at") > 0, entity_vote(tags, F.lit(1), F.greatest(F.lit(1), F.size(tags)))).otherwise(F.lit("NONE"))
    return met.select("text", "candidate", F.col("label").alias("y_true"), voted.alias("y_pred"))


def join_targets(targets: DataFrame, texts: DataFrame) -> DataFrame:
    """Targets (uuid, field, y) with their source text."""
    return targets.join(texts.groupBy("uuid", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_pos", "text"))), lambda x: x["text"]), " ").alias("text")), ["uuid", "field"])

