"""Distinct-record support of attribute sets, and risk scores of spans."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilsight.functions import stats
from veilsight.functions.text import json_key
from veilsight.operators.cooccurrence import phrase_tiers
from veilsight.session import written


def set_records(detail: DataFrame, grain: str = "clause") -> DataFrame:
    """terms, set_size, record_count and probability: the records that have a set in some clause (or field).

    Empty sets don't count; records without any set count among all.
    """
    sets = detail.select("uuid", "field", F.array_sort(F.array_distinct("matched_terms")).alias("terms"))
    if grain == "field":
        sets = sets.groupBy("uuid", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    counted = sets.where(F.size("terms") > 0).select("uuid", "terms").distinct().groupBy("terms").agg(F.count("*").alias("record_count"))
    out = counted.crossJoin(F.broadcast(records(detail)))  # one row
    return out.select("terms", F.size("terms").alias("set_size"), "record_count", (F.col("record_count") / F.col("N")).alias("probability"))


def records(detail: DataFrame) -> DataFrame:
    return detail.agg(F.count_distinct("uuid").alias("N"))


def term_records(detail: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """term, tier, record_count, probability."""
    terms = detail.select("uuid", F.explode("matched_terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("record_count"))
    out = terms.crossJoin(F.broadcast(records(detail))).withColumn("probability", F.col("record_count") / F.col("N"))  # one row
    if tiers is None:
        return out.select("term", F.lit("").alias("tier"), "record_count", "probability")
    known = phrase_tiers(out.select(F.col("term").alias("phrase")), tiers).withColumnRenamed("phrase", "term")
    return out.join(known, "term", "left").select("term", F.coalesce("tier", F.lit("")).alias("tier"), "record_count", "probability")


def risk_meta(detail: DataFrame, clause: DataFrame | None = None, field: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """One row: records, clauses, and distinct clause sets, field sets and terms; their tables may be given."""
    clause = set_records(detail) if clause is None else clause
    field = set_records(detail, "field") if field is None else field
    terms = term_records(detail) if terms is None else terms
    base = detail.agg(F.count_distinct("uuid").alias("N"), F.count("*").alias("n_lines"))
    counts = [x.agg(F.count("*").alias(n)) for x, n in ((clause, "n_phrase_sets"), (field, "n_field_sets"), (terms, "n_terms"))]
    for c in counts:
        base = base.crossJoin(c)  # one row each
    return base


def known_records(meta: DataFrame | None, terms: DataFrame) -> DataFrame:
    """N: from meta, or from a term's count and probability where meta has none."""
    guess = terms.where("probability > 0").agg(F.max(F.round(F.col("record_count") / F.col("probability"))).cast("long").alias("N"))
    if meta is None:
        return guess
    given = meta.agg(F.max("N").alias("M"))
    return given.crossJoin(guess).select(F.when(F.col("M") > 0, F.col("M")).otherwise(F.col("N")).alias("N"))


def join_spans(clauses: DataFrame, detail: DataFrame) -> DataFrame:
    """Clauses with their sets, for records that have as many clauses on both sides."""
    sizes = clauses.groupBy("uuid").agg(F.count("*").alias("n")).join(detail.groupBy("uuid").agg(F.count("*").alias("m")), "uuid").where("n = m").select("uuid")
    both = clauses.join(detail.select("uuid", "field", "clause_pos", "matched_terms"), ["uuid", "field", "clause_pos"])
    return both.join(sizes, "uuid", "left_semi").select(F.col("clause").alias("text"), "label", F.array_sort(F.array_distinct("matched_terms")).alias("qi"))


def dedupe_spans(spans: DataFrame) -> DataFrame:
    """A row a text: the largest label, the set whose JSON text is largest, its size, and freq.

    Label and set are largest each by itself.
    """
    keyed = spans.select("text", "label", F.struct(json_key(F.col("qi")).alias("qi_json"), "qi").alias("k"))
    out = keyed.groupBy("text").agg(F.max("label").alias("label"), F.max("k").alias("k"), F.count("*").alias("freq"))
    return out.select("text", "label", "k.qi", "k.qi_json", F.size("k.qi").alias("size"), "freq")


def score_spans(spans: DataFrame, sets: DataFrame, terms: DataFrame, n: DataFrame) -> DataFrame:
    """Spans with provenance, support, the y scores, min_constituent_df and tier_strictest.

    spans is what dedupe_spans makes, sets has terms and record_count, terms
    has term, tier and record_count, n one row with N.  Spans without terms
    stay only where their label is NONE.  A PROFILE set that sets lack has
    support 1; a term that terms lack counts as in one record.  PII spans get
    the largest scores of the PROFILE ones.
    """
    kept = spans.where("label = 'NONE' OR size > 0").withColumn("provenance", F.when(F.col("label").isin("NONE", "PII"), F.col("label")).otherwise("PROFILE"))
    log_n = F.log10(F.col("N").cast("double"))
    # what a set has is found once a distinct set, and meets the spans in one join
    each = kept.select("qi").distinct()
    flat = each.select("qi", F.explode("qi").alias("term")).join(terms.select("term", F.col("record_count").alias("df"), "tier"), "term", "left")
    bits = flat.crossJoin(F.broadcast(n)).groupBy("qi").agg(  # one row
        F.sum(log_n - F.log10(F.greatest(F.lit(1), F.coalesce("df", F.lit(1))).cast("double"))).alias("_bits"),
        F.min(F.greatest(F.lit(1), F.coalesce("df", F.lit(1)))).cast("long").alias("_min"),
        F.min(F.when(F.col("tier") != "", F.col("tier"))).alias("_tier"),
    )
    each = each.join(bits, "qi", "left").join(sets.select(F.col("terms").alias("qi"), F.col("record_count").alias("_s")), "qi", "left")
    kept = kept.join(each, "qi", "left")
    support = F.when((F.col("label") == "PROFILE") & (F.coalesce("_s", F.lit(0)) == 0), 1).otherwise(F.coalesce("_s", F.lit(0)))
    out = kept.withColumn("support", support.cast("long")).crossJoin(F.broadcast(n))  # one row
    none = F.col("provenance") == "NONE"
    raw = F.when(none, 0.0).otherwise(F.coalesce("_bits", F.lit(0.0)))
    risk = F.when(none, 0.0).otherwise(stats.y_risk(F.col("support"), F.col("N")))
    out = out.select(
        "*",
        risk.alias("y_risk"),
        F.round(raw, 6).alias("y_bits"),
        F.round(F.least(log_n, raw), 6).alias("y_bits_capped"),
        F.when(none, 0).otherwise(F.coalesce("_min", F.lit(0))).cast("long").alias("min_constituent_df"),
        F.round(F.when(none, 0.0).when(F.col("support") >= 2, risk).otherwise(F.greatest(log_n, raw)), 6).alias("y_combined"),
        F.coalesce("_tier", F.lit("")).alias("tier_strictest"),
    )
    # the ceilings and the rows that they raise are two readings of the scores
    return raise_to_ceiling(written(out.drop("_s", "_bits", "_min", "_tier")))


def ceilings(scored: DataFrame) -> DataFrame:
    """The largest y_bits and y_combined of PROFILE spans, log10 N without any; one row."""
    return scored.agg(
        F.max(F.when(F.col("provenance") == "PROFILE", F.col("y_bits"))).alias("ceiling_bits"), F.max(F.when(F.col("provenance") == "PROFILE", F.col("y_combined"))).alias("ceiling_combined")
    )


def raise_to_ceiling(scored: DataFrame) -> DataFrame:
    top = F.round(F.log10(F.col("N").cast("double")), 6)
    out = scored.crossJoin(F.broadcast(ceilings(scored)))  # one row
    pii = F.col("provenance") == "PII"
    for c, to in (("y_risk", top), ("y_bits_capped", top), ("y_bits", F.coalesce("ceiling_bits", top)), ("y_combined", F.coalesce("ceiling_combined", top))):
        out = out.withColumn(c, F.when(pii, F.round(to, 6)).otherwise(F.col(c)))
    return out.drop("ceiling_bits", "ceiling_combined")


def split_key(terms: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with split_key: the term in the fewest records (an unknown one in none), the least of equals; without terms a hash of the text."""
    flat = spans.where("size > 0").select("qi").distinct().select("qi", F.explode("qi").alias("term")).join(terms.select("term", F.col("record_count").alias("df")), "term", "left")
    rare = flat.groupBy("qi").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"))
    empty = F.concat(F.lit("EMPTY:"), F.substring(F.md5("text"), 1, 12))
    return spans.join(rare, "qi", "left").withColumn("split_key", F.coalesce("r.term", empty)).drop("r")


def set_features(sets: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct sets (terms) with features of their wording and of their terms' records."""
    flat = sets.select("terms").distinct().select("terms", F.explode("terms").alias("term")).join(terms.select("term", F.col("record_count").alias("df")), "term", "left")
    words = F.size(F.split(F.trim("term"), r"\s+"))
    df = F.coalesce("df", F.lit(0))
    return flat.groupBy("terms").agg(
        F.max(F.length("term")).alias("char_len_max"),
        F.round(F.avg(F.length("term")), 3).alias("char_len_mean"),
        F.round(F.avg(words), 3).alias("n_words_mean"),
        F.max(F.rlike("term", F.lit(r"\d")).cast("int")).alias("has_digit"),
        F.min(df).cast("long").alias("const_support_min"),
        F.round(F.avg(df), 3).alias("const_support_mean"),
    )


def lds_weights(df: DataFrame, y: str = "y_risk", n_bins: int = 50, sigma: float = 2.0, clip: float = 10.0, out: str = "lds_weight") -> DataFrame:
    """df with weights that fall with the smoothed density of y, of mean 1 and clipped at clip and its inverse.

    y falls into n_bins equal bins (13 at least), whose counts a Gaussian
    kernel of sigma bins smooths.  A constant y weighs 1.  All work but the
    last join is on the bins.
    """
    if n_bins < 13:
        raise ValueError("fewer bins than the kernel is wide")
    ends = df.agg(F.min(y).cast("double").alias("_lo"), F.max(y).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    number = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(y) - F.col("_lo")) / width), F.lit(n_bins - 1))).otherwise(0)
    binned = df.crossJoin(F.broadcast(ends)).withColumn("_bin", number.cast("int"))  # one row
    counts = binned.groupBy("_bin").agg(F.count("*").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    half = max(1, round(3 * sigma))
    kernel = [math.exp(-(k * k) / (2.0 * sigma * sigma)) for k in range(-half, half + 1)]
    total = sum(kernel)
    near = counts.select(F.col("_bin").alias("_b2"), F.col("_n").alias("_n2"))
    weight = F.element_at(F.array(*[F.lit(k / total) for k in kernel]), F.col("_b2") - F.col("_bin") + half + 1)
    smooth = counts.join(F.broadcast(near), F.abs(F.col("_b2") - F.col("_bin")) <= half).groupBy("_bin", "_n", "_lo", "_hi").agg(F.sum(F.col("_n2") * weight).alias("_d"))
    over = Window.partitionBy()  # over the bins
    w = smooth.withColumn("_w", 1.0 / F.greatest(F.col("_d"), F.lit(1e-12)))
    w = w.withColumn("_w", F.col("_w") * F.sum("_n").over(over) / F.sum(F.col("_w") * F.col("_n")).over(over))
    if clip > 0:
        w = w.withColumn("_w", F.greatest(F.least(F.col("_w"), F.lit(float(clip))), F.lit(1.0 / clip)))
        w = w.withColumn("_w", F.col("_w") * F.sum("_n").over(over) / F.sum(F.col("_w") * F.col("_n")).over(over))
    w = w.select("_bin", F.when(F.col("_hi") > F.col("_lo"), F.col("_w")).otherwise(1.0).alias(out))
    return binned.join(F.broadcast(w), "_bin").drop("_bin", "_lo", "_hi")  # n_bins rows

