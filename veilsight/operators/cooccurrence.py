"""Attribute sets and pairs at clause, field and record grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsight.functions import stats
from veilsight.operators.ranking import bh
from veilsight.session import checkpoint

UNITS = ("clause", "field", "uuid")


def unit_sets(detail: DataFrame, units: tuple[str, ...] = UNITS) -> DataFrame:
    """unit, uuid and terms: the sorted set of each clause, field and record, empty ones too.

    detail has uuid, field, clause_pos and matched_terms, and text for the unit
    of that name, a text of a field.  Each grain is made from the one below, so
    that sets shrink before they move.
    """
    clause = detail.select("uuid", "field", F.array_sort(F.array_distinct("matched_terms")).alias("terms"))
    union = lambda: F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")
    field = clause.groupBy("uuid", "field").agg(union())
    if "text" in units:
        texts = detail.select("uuid", "field", "text", F.array_sort(F.array_distinct("matched_terms")).alias("terms")).groupBy("uuid", "field", "text").agg(union())
        field = texts.groupBy("uuid", "field").agg(union())
    made = {"clause": clause.select("uuid", "terms"), "field": field.select("uuid", "terms"), "uuid": field.groupBy("uuid").agg(union())}
    made |= {"text": texts.select("uuid", "terms")} if "text" in units else {}
    out = None
    for u in units:
        one = made[u].select(F.lit(u).alias("unit"), "uuid", "terms")
        out = one if out is None else out.unionByName(one)
    return out


def set_probabilities(sets: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """unit, terms, set_size, cnt and probability = cnt / sets of the unit, the empty set included; tiers and their counts if given."""
    counted = sets.groupBy("unit", "terms").agg(F.count("*").alias("cnt"))
    totals = sets.groupBy("unit").agg(F.count("*").alias("total"))  # a row a unit
    out = counted.join(F.broadcast(totals), "unit")
    out = out.select("unit", "terms", F.size("terms").alias("set_size"), "cnt", (F.col("cnt") / F.col("total")).alias("probability"))
    if tiers is None:
        return out
    term_tier = phrase_tiers(out.select(F.explode("terms").alias("phrase")).distinct(), tiers)
    flat = out.select("unit", "terms", F.posexplode("terms").alias("pos", "phrase")).join(term_tier, "phrase", "left")
    listed = flat.groupBy("unit", "terms").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("tier", F.lit("")).alias("tier")))), lambda x: x["tier"]).alias("tiers"))
    out = out.join(listed, ["unit", "terms"], "left").withColumn("tiers", F.coalesce("tiers", F.array().cast("array<string>")))
    for t, name in (("0.01", "n_tier_001"), ("0.05", "n_tier_005"), ("0.10", "n_tier_010")):
        out = out.withColumn(name, F.size(F.filter("tiers", lambda x, t=t: x == t)))
    return out


def phrase_tiers(phrases: DataFrame, tiers: DataFrame) -> DataFrame:
    """phrase and tier: the strictest of its words' tiers."""
    words = phrases.select("phrase", F.explode(F.split("phrase", " ")).alias("token"))
    return words.join(tiers, "token").groupBy("phrase").agg(F.min("alpha_tier").alias("tier"))


def set_pairs(sets: DataFrame) -> DataFrame:
    """unit, a and b for every two terms a < b of a set; made inside the array, without a shuffle."""
    n = F.size("terms")
    pairs = F.flatten(
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.slice("terms", i + 1, n), lambda b: F.struct(F.element_at("terms", i).alias("a"), b.alias("b"))))
    )
    return sets.where(n >= 2).select("unit", F.explode(pairs).alias("p")).select("unit", "p.a", "p.b")


def pair_counts(sets: DataFrame, min_count: int = 2) -> DataFrame:
    """unit, a, b, co_count, count_a, count_b and n, the sets of the unit, for pairs in min_count sets at least."""
    co = set_pairs(sets).groupBy("unit", "a", "b").agg(F.count("*").alias("co_count")).where(F.col("co_count") >= min_count)
    term = sets.select("unit", F.explode("terms").alias("t")).groupBy("unit", "t").agg(F.count("*").alias("c"))
    totals = sets.groupBy("unit").agg(F.count("*").alias("n"))
    out = co.join(term.select("unit", F.col("t").alias("a"), F.col("c").alias("count_a")), ["unit", "a"])
    out = out.join(term.select("unit", F.col("t").alias("b"), F.col("c").alias("count_b")), ["unit", "b"])
    return out.join(F.broadcast(totals), "unit")  # a row a unit


def pair_associations(pairs: DataFrame) -> DataFrame:
    """pairs with probability, pmi, g2 and positive."""
    co, a, b, n = (F.col(c) for c in ("co_count", "count_a", "count_b", "n"))
    g2 = stats.g_statistic(co, a - co, b - co, n - a - b + co)
    return pairs.select("*", (co / n).alias("probability"), stats.pmi(co, a, b, n).alias("pmi"), g2.alias("g2"), (co > a.cast("double") * b / n).alias("positive"))


def significant_pairs(pairs: DataFrame, q: float = 0.05, tiers: DataFrame | None = None) -> DataFrame:
    """Positive pairs of q_value at most q (all pairs if q is 0 or less); q over the pairs of each unit, of whatever units there are."""
    scored = checkpoint(pair_associations(pairs))
    tails = scored.select("g2").distinct().withColumn("tail", stats.chi2_tail("g2"))
    scored = scored.join(tails, "g2")
    scored = scored.withColumn("p_one", F.when(F.col("positive"), F.col("tail") / 2).otherwise(1 - F.col("tail") / 2))
    out = bh(scored, "p_one", "q_value", by=["unit"])
    out = out.where(F.col("positive") & (F.col("q_value") <= q)) if q > 0 else out
    out = out.select("unit", F.col("a").alias("phrase_a"), F.col("b").alias("phrase_b"), "co_count", "count_a", "count_b", "probability", F.round("pmi", 4).alias("pmi"), F.round("g2", 4).alias("g2"), F.round("q_value", 6).alias("q_value"))
    if tiers is not None:
        known = phrase_tiers(out.select(F.col("phrase_a").alias("phrase")).union(out.select("phrase_b")).distinct(), tiers)
        for side in "ab":
            named = known.select(F.col("phrase").alias(f"phrase_{side}"), F.col("tier").alias(f"tier_{side}"))
            out = out.join(named, f"phrase_{side}", "left").withColumn(f"tier_{side}", F.coalesce(f"tier_{side}", F.lit("")))
    return out.orderBy("unit", F.desc("co_count"), "phrase_a", "phrase_b")
