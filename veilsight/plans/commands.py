"""The commands: each takes tables and options and returns tables, lazily."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsight.config import MAX_PHRASE_FREQ, MIN_PHRASE_FREQ, NP_GRAMMAR
from veilsight.functions import text
from veilsight.operators import cooccurrence as co
from veilsight.operators import annotation, evaluation, itemsets, phrases, risk, sampling, tokens
from veilsight.session import checkpoint, written
from veilsight.sources import sinks


@dataclass
class Cooccurrence:
    detail: DataFrame
    sets: DataFrame
    pairs: DataFrame | None


def method_a(clauses: DataFrame, q: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """All token statistics with tiers, and the significant ones."""
    stats = checkpoint(tokens.with_tier(tokens.token_stats(clauses)))
    return stats, tokens.significant(stats, q)


def method_a_compare(stats: DataFrame) -> DataFrame:
    return tokens.sensitivity(stats)


def method_b(clauses: DataFrame, candidates: DataFrame, grammar: str = NP_GRAMMAR) -> DataFrame:
    """The phrase table of PROFILE clauses about candidate tokens."""
    return phrases.phrase_table(clauses.where("label = 'PROFILE'"), candidates, tokens.token_tiers(candidates), grammar)


def dictionary(clauses: DataFrame, lists: DataFrame | None = None, columns: tuple[str, ...] = (), tagger=text.morphemes, keep=text.content_word, min_profile: int = 1, alpha: float = 0.05) -> DataFrame:
    """The dictionary run: morphemes of labelled clauses that the G test finds more often in PROFILE ones, the strongest first.

    lists, a second source, has text or list columns, the named ones of which
    count as PROFILE texts.  tagger is a function from a text column to structs
    of token and pos, keep tells which of them count; margins are of tokens.
    """
    found = checkpoint(tokens.token_counts(tokens.clause_tokens(clauses, tagger, keep)))
    totals = found.agg(F.coalesce(F.sum("freq_profile"), F.lit(0)).alias("n_profile"), F.coalesce(F.sum("freq_none"), F.lit(0)).alias("n_none"))
    if lists is not None:
        found, totals = tokens.augment_profile(found, totals, lists, columns, tagger, keep)
    return tokens.morphemes(found, totals, min_profile, alpha)


def write_method_a(made: tuple[DataFrame, DataFrame], folder: str) -> None:
    """Token statistics and the significant ones as CSV, in their orders."""
    sinks.csv(tokens.in_order(made[0]), f"{folder}/token_stats")
    sinks.csv(made[1], f"{folder}/significant")


def candidate_report(annotations: DataFrame, predictions: DataFrame, labels: tuple[str, ...], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Of annotated candidates: counts of every two labels, and precision, recall and F1."""
    met = checkpoint(annotation.candidate_labels(annotations, predictions, order))
    return evaluation.confusion(met, labels), evaluation.f1_report(met)


def resolve_min_freq(value: int | str, stats: DataFrame) -> int:
    """A number, or for "auto" the one the odds ratios' intervals recommend."""
    if str(value).strip().lower() != "auto":
        return int(float(value))
    cells = stats.select(F.col("freq_profile").alias("a"), (F.col("n_profile") - F.col("freq_profile")).alias("b"), F.col("freq_none").alias("c"), (F.col("n_none") - F.col("freq_none")).alias("d"))
    found = tokens.frequency_scan(cells).where("recommended = 1").first()
    return int(found["k"]) if found else 1


def resolve_min_phrase_freq(value: int | str, clauses: DataFrame, candidates: DataFrame, target: float = 0.5) -> int:
    """A number, or for "auto" the one two-fold recall recommends, 30 if none does."""
    if str(value).strip().lower() != "auto":
        return int(float(value))
    table = phrases.twofold_recall(phrases.matches(clauses.where("label = 'PROFILE'"), candidates), target)
    found = table.where("recommended = 1").first()
    return int(found["k"]) if found else 30


def select_thresholds(stats: DataFrame, clauses: DataFrame, candidates: DataFrame, ci_target: float = 0.95, rho_target: float = 0.5, layer2: bool = True) -> tuple[DataFrame, DataFrame | None]:
    cells = stats.select(F.col("freq_profile").alias("a"), (F.col("n_profile") - F.col("freq_profile")).alias("b"), F.col("freq_none").alias("c"), (F.col("n_none") - F.col("freq_none")).alias("d"))
    first = tokens.frequency_scan(cells, ci_target)
    return first, phrases.twofold_recall(phrases.matches(clauses.where("label = 'PROFILE'"), candidates), rho_target) if layer2 else None


def cooccurrence(
    clauses: DataFrame, candidates: DataFrame, phrase_table: DataFrame | None = None, min_phrase_freq: int = MIN_PHRASE_FREQ, max_phrase_freq: int = MAX_PHRASE_FREQ,
    multiword: bool = False, units: tuple[str, ...] = co.UNITS, pairs: bool = True, min_pair_count: int = 2, pair_q: float = 0.05, share: float = 1.0, seed: int = 42, grammar: str = NP_GRAMMAR,
) -> Cooccurrence:
    """Detail of every clause, set probabilities and, unless pairs is off, significant pairs of each unit."""
    rows = sampling.bernoulli(clauses, share, F.col("uuid"), seed)
    allowed = None if phrase_table is None else phrases.band(phrase_table, min_phrase_freq, max_phrase_freq, multiword)
    found = phrases.matches(rows, candidates, grammar)
    found = found.where(F.size(F.split("phrase", " ")) >= 2) if multiword else found
    return export(checkpoint(phrases.detail(rows, found, allowed)), tokens.token_tiers(candidates), units, pairs, min_pair_count, pair_q)


def export(detail: DataFrame, tiers: DataFrame | None = None, units: tuple[str, ...] = co.UNITS, pairs: bool = True, min_pair_count: int = 2, pair_q: float = 0.05) -> Cooccurrence:
    """What cooccurrence makes, from a detail table kept before."""
    sets = checkpoint(co.unit_sets(detail, units))
    return Cooccurrence(detail, co.set_probabilities(sets, tiers), co.significant_pairs(co.pair_counts(sets, min_pair_count), pair_q, tiers) if pairs else None)


def all_steps(clauses: DataFrame, q: float = 0.05, min_freq: int | str = 1, min_effect: float = 1.0, min_phrase_freq: int | str = MIN_PHRASE_FREQ, **options) -> tuple[DataFrame, DataFrame, Cooccurrence]:
    """Token statistics, phrase table and co-occurrence, one after another."""
    stats, chosen = method_a(clauses, q)
    picked = checkpoint(tokens.candidates(chosen, resolve_min_freq(min_freq, chosen), min_effect))
    table = checkpoint(method_b(clauses, picked))
    low = resolve_min_phrase_freq(min_phrase_freq, clauses, picked)
    return stats, table, cooccurrence(clauses, picked, table, low, **options)


def benchmark(detail: DataFrame, target: int, ordinal: DataFrame) -> DataFrame:
    """kind, beta, k, estimate: growth of distinct terms, sets and pairs, carried on to target records.

    ordinal gives each uuid its number from 0.
    """
    numbered = detail.join(ordinal, "uuid")
    sets = numbered.groupBy("n", "uuid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_terms")))).alias("terms"))
    kinds = {
        "terms": numbered.select("n", F.explode("matched_terms").alias("x")),
        "sets": sets.select("n", F.array_join("terms", "\x1f").alias("x")),
        "pairs": co.set_pairs(sets.select(F.col("n").alias("unit"), "terms")).select(F.col("unit").alias("n"), F.concat_ws("\x1f", "a", "b").alias("x")),
    }
    out = None
    for kind, rows in kinds.items():
        points = phrases.growth(rows.withColumnRenamed("n", "_o"), "_o", "x")
        one = phrases.heaps(points, target).select(F.lit(kind).alias("kind"), "beta", "k", "estimate")
        out = one if out is None else out.unionByName(one)
    return out


def combos(detail: DataFrame, min_size: int = 3, max_size: int = 0, min_support: float = 0.001) -> DataFrame:
    return itemsets.combinations(itemsets.weighted_sets(co.unit_sets(detail, ("uuid",))), min_size, max_size, min_support)


def risk_sets(detail: DataFrame, tiers: DataFrame | None = None) -> dict[str, DataFrame]:
    """Records of clause sets, field sets and terms, and the totals."""
    detail = written(detail)
    made = {"clause": written(risk.set_records(detail)), "field": written(risk.set_records(detail, "field")), "terms": checkpoint(risk.term_records(detail, tiers))}
    return made | {"meta": checkpoint(risk.risk_meta(detail, *made.values()))}


def span_join(clauses: DataFrame, detail: DataFrame) -> DataFrame:
    return risk.dedupe_spans(risk.join_spans(clauses, detail)).orderBy(F.desc("freq"), "text")


def sample_spans(spans: DataFrame, tables: dict[str, DataFrame], **options) -> DataFrame:
    """The span training table: scores, split, rebalancing and weights."""
    # the callers' tables may be plans, of which these are read more than once
    terms = checkpoint(tables["terms"])
    scored = risk.score_spans(written(spans), tables["clause"], terms, checkpoint(risk.known_records(tables["meta"], terms)))
    return sampling.train_rows(scored, terms, **options)


def sample_balanced(tables: dict[str, DataFrame], token_stats: DataFrame | None = None, source: str = "phrase-field", detail: DataFrame | None = None, none_share: float = 0.15, min_records: int = 1, max_size: int = 4, combo_min_support: int = 2, seed: int = 42, **options) -> DataFrame:
    """The set training table, from clause and field sets, or from records' whole sets and their combinations."""
    terms, n = tables["terms"], risk.known_records(tables["meta"], tables["terms"])
    if source == "uuid":
        weighted = itemsets.weighted_sets(co.unit_sets(detail, ("uuid",)))
        n = weighted.agg(F.sum("cnt").alias("N"))
        single = itemsets.item_support(weighted).select(F.array("term").alias("terms"), F.col("support_count").alias("record_count"))
        terms = single.select(F.element_at("terms", 1).alias("term"), "record_count").join(terms.select("term", "tier"), "term", "left").select("term", F.coalesce("tier", F.lit("")).alias("tier"), "record_count")
        wide = itemsets.frequent_itemsets(weighted, combo_min_support, max_size).where("size >= 2").select(F.col("combo").alias("terms"), F.col("support_count").alias("record_count"))
        made = {"phrase": single, "combination": wide, "record_set": weighted.select("terms", F.col("cnt").alias("record_count"))}
    else:
        made = {"phrase": tables["clause"], "field": tables["field"]}
    rows = None
    for unit, sets in made.items():
        one = sampling.reid_samples(sets, terms, n, unit, min_records)
        rows = one if rows is None else rows.unionByName(one)
    rows = checkpoint(rows)
    wanted = sampling.needed_for_share(none_share, rows.count())
    if wanted and token_stats is not None:
        anchors = sampling.none_anchors(token_stats, wanted, seed).select(F.array("token").alias("terms"), F.greatest(F.lit(1), "freq_none").alias("record_count"))
        rows = rows.unionByName(sampling.reid_samples(anchors, terms, n, "phrase", 1, True))
    return sampling.balanced(rows, terms, seed=seed, **options)
