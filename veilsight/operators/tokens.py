"""Tokens over-represented in attribute-bearing clauses: counts, exact tests, false-discovery control."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsight.config import ALPHA
from veilsight.functions import stats, text
from veilsight.operators.ranking import bh
from veilsight.session import checkpoint


def clause_tokens(clauses: DataFrame, tagger=None, keep=text.content_word) -> DataFrame:
    """label, token, pos of every content word of a clause, with repeats; PII clauses left out.

    tagger is a function from the clause column to structs of token and pos,
    as text.PartnerMorphemes is; keep tells by token and pos which ones count.
    """
    labelled = clauses.where(F.col("label").isin("PROFILE", "NONE"))
    if tagger is None or tagger is text.morphemes:
        # the default tags, put to words that stand in rows: compiled, where a lambda over an array is not
        words = labelled.select("label", F.explode(text.words(F.col("clause"))).alias("token")).withColumn("pos", text.part_of_speech(F.col("token")))
    else:
        words = labelled.select("label", F.explode(tagger(F.col("clause"))).alias("_m")).select("label", "_m.token", "_m.pos")
    return words.where(keep(F.col("token"), F.col("pos")))


def augment_profile(counts: DataFrame, totals: DataFrame, rows: DataFrame, columns: tuple[str, ...], tagger=text.morphemes, keep=text.content_word) -> tuple[DataFrame, DataFrame]:
    """counts and token totals with the content words of further profile texts added: text or list columns of rows.

    counts has token, pos, freq_profile and freq_none, totals n_profile and n_none.
    """
    texts = rows.select(F.explode(F.concat(*[text.normalize_field(rows, c) for c in columns])).alias("clause"))
    # a row a token, used for the counts and for the totals
    found = checkpoint(clause_tokens(texts.withColumn("label", F.lit("PROFILE")), tagger, keep).groupBy("token", "pos").agg(F.count("*").alias("freq_profile"), F.lit(0).cast("long").alias("freq_none")))
    both = counts.select("token", "pos", "freq_profile", "freq_none").unionByName(found)
    more = found.agg(F.coalesce(F.sum("freq_profile"), F.lit(0)).alias("_more"))
    out = both.groupBy("token", "pos").agg(F.sum("freq_profile").alias("freq_profile"), F.sum("freq_none").alias("freq_none"))
    return out, totals.crossJoin(F.broadcast(more)).withColumn("n_profile", F.col("n_profile") + F.col("_more")).drop("_more")  # one row


def token_counts(tokens: DataFrame) -> DataFrame:
    """freq_profile and freq_none of each token: a full outer join of the labels' counts, as one aggregation."""
    return tokens.groupBy("token", "pos").agg(
        F.count_if(F.col("label") == "PROFILE").alias("freq_profile"), F.count_if(F.col("label") == "NONE").alias("freq_none")
    )


def _words_counted(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """label, token, n: words of lower-cased clauses, counted as far as memory goes."""
    counts = {"PROFILE": Counter(), "NONE": Counter()}

    def counted() -> Iterator[pa.RecordBatch]:
        for label, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["label", "token", "n"])
            c.clear()

    for batch in batches:
        for label, c in counts.items():
            # no word goes over a line
            texts = batch.column(1).filter(pc.equal(batch.column(0), label)).drop_null().to_pylist()
            c.update(text.words_of("\n".join(texts)))
        if sum(map(len, counts.values())) > most:
            yield from counted()
    yield from counted()


def default_counts(clauses: DataFrame) -> DataFrame:
    """token_counts of clause_tokens by the default tags: words are counted in one pass over Arrow batches, and tagged when they are."""
    labelled = clauses.where(F.col("label").isin("PROFILE", "NONE")).select("label", F.lower("clause").alias("clause"))
    n = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    found = labelled.mapInArrow(_words_counted, "label string, token string, n long").groupBy("token").agg(n("PROFILE").alias("freq_profile"), n("NONE").alias("freq_none"))
    found = found.withColumn("pos", text.part_of_speech(F.col("token"))).where(text.content_word(F.col("token"), F.col("pos")))
    return found.select("token", "pos", "freq_profile", "freq_none")


def clause_totals(clauses: DataFrame) -> DataFrame:
    """n_profile and n_none: clauses of each label, one row."""
    return clauses.agg(F.count_if(F.col("label") == "PROFILE").alias("n_profile"), F.count_if(F.col("label") == "NONE").alias("n_none"))


def contingency(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Cells a, b, c, d of each token that PROFILE clauses have.

    Counts are occurrences and totals clauses, so a frequent token's b or d
    may be negative; it is then not tested.
    """
    return (
        counts.where("freq_profile > 0")
        .crossJoin(F.broadcast(totals))  # one row
        .withColumn("a", F.col("freq_profile"))
        .withColumn("b", F.col("n_profile") - F.col("freq_profile"))
        .withColumn("c", F.col("freq_none"))
        .withColumn("d", F.col("n_none") - F.col("freq_none"))
    )


def fisher(cells: DataFrame) -> DataFrame:
    """cells with p_value; each distinct table is tested once."""
    tables = cells.select("a", "b", "c", "d").distinct()
    tested = tables.withColumn("p_value", stats.fisher_greater("a", "b", "c", "d"))
    return cells.join(tested, ["a", "b", "c", "d"])


def counts_and_totals(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """token_counts of clauses and their clause_totals.

    Clauses are read once: each adds an empty token, whose counts are the totals.
    """
    labelled = clauses.where(F.col("label").isin("PROFILE", "NONE"))
    words = labelled.select("label", F.explode(F.concat(F.array(F.lit("")), text.words(F.col("clause")))).alias("token"))
    words = words.withColumn("pos", text.part_of_speech(F.col("token"))).where((F.col("token") == "") | text.content_word(F.col("token"), F.col("pos")))
    counts = checkpoint(token_counts(words))
    totals = counts.where("token = ''").agg(F.coalesce(F.sum("freq_profile"), F.lit(0)).alias("n_profile"), F.coalesce(F.sum("freq_none"), F.lit(0)).alias("n_none"))
    return counts.where("token <> ''"), totals


def token_stats(clauses: DataFrame) -> DataFrame:
    """Every tested token with p_value, effect_size, q_value and the numbers of tokens and tests."""
    return stats_of(*counts_and_totals(clauses))


def stats_of(counts: DataFrame, totals: DataFrame) -> DataFrame:
    # a row a token, used for the tests and for their number
    cells = fisher(contingency(counts, totals))
    scored = bh(cells.withColumn("effect_size", stats.odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d"))))
    sizes = counts.agg(F.count("*").alias("n_tokens"), F.count_if(F.col("freq_profile") > 0).alias("n_tested"))
    return scored.crossJoin(F.broadcast(sizes)).drop("a", "b", "c", "d")  # one row


def in_order(stats_df: DataFrame) -> DataFrame:
    """Token statistics as they are written: the surest first, by q and then p, untested ones last."""
    by = [F.col(c).asc_nulls_last() for c in ("q_value", "p_value") if c in stats_df.columns]
    return stats_df.orderBy(*by, "token")


def significant(stats_df: DataFrame, q: float = 0.05) -> DataFrame:
    """Tokens of q at most, the strongest first; by Bonferroni where there is no q."""
    if "q_value" not in stats_df.columns:
        return bonferroni(stats_df, q)
    return stats_df.where(F.col("q_value") <= q).orderBy(F.desc("effect_size"), "token")


def bonferroni(stats_df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Tokens of p below alpha / tests; if none is, those below alpha."""
    some = stats_df.agg(F.count_if(F.col("p_value") < alpha / F.col("n_tested")).alias("strict"))
    bound = F.when(F.col("strict") > 0, F.lit(alpha) / F.col("n_tested")).otherwise(F.lit(alpha))
    return stats_df.crossJoin(F.broadcast(some)).where(F.col("p_value") < bound).drop("strict")  # one row


def with_tier(stats_df: DataFrame) -> DataFrame:
    tier = stats.tier_of_q(F.col("q_value")) if "q_value" in stats_df.columns else stats.tier_of_p(F.col("p_value"), F.col("n_tested"))
    return stats_df.withColumn("alpha_tier", tier)


def sensitivity(stats_df: DataFrame, base: float = 0.05, levels: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """For each level: tokens, change against the base level, tokens added and lost, and Jaccard (1 of two empty sets)."""
    grid = stats_df.sparkSession.createDataFrame([(float(x),) for x in levels], "level double")
    inside, in_base = F.col("q_value") <= F.col("level"), F.col("q_value") <= base
    out = grid.crossJoin(stats_df.select("q_value")).groupBy("level")  # three levels
    out = out.agg(
        F.count_if(inside).alias("n_tokens"),
        (F.count_if(inside) - F.count_if(in_base)).alias("delta"),
        F.count_if(inside & ~in_base).alias("added"),
        F.count_if(in_base & ~inside).alias("lost"),
        F.count_if(inside & in_base).alias("_and"),
        F.count_if(inside | in_base).alias("_or"),
    )
    return out.withColumn("jaccard", F.when(F.col("_or") > 0, F.col("_and") / F.col("_or")).otherwise(1.0)).drop("_and", "_or")


def candidates(stats_df: DataFrame, min_freq: int = 1, min_effect: float = 1.0) -> DataFrame:
    """Tokens over both thresholds, trimmed and lower-cased, with their tier."""
    kept = stats_df.where((F.col("freq_profile") >= min_freq) & (F.col("effect_size") >= min_effect))
    kept = kept if "alpha_tier" in kept.columns else with_tier(kept)
    return kept.withColumn("token", F.lower(F.trim("token")))


def frequency_scan(cells: DataFrame, target: float = 0.95, max_k: int = 30, z: float = 1.96) -> DataFrame:
    """k, tokens of frequency k or more, and the share of them whose odds ratio is surely above 1; recommended marks the first k that reaches target, else the last."""
    lower = stats.odds_ratio_lower(F.col("a"), F.col("b"), F.col("c"), F.col("d"), z)
    sure = cells.withColumn("sure", (lower > 1.0).cast("int"))
    # a token of frequency f counts for every k up to it: explode at most max_k rows of the aggregated frequencies
    by_freq = sure.groupBy(F.least(F.col("a"), F.lit(max_k)).alias("f")).agg(F.count("*").alias("n"), F.sum("sure").alias("s"))
    grid = by_freq.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("f"))).alias("k"), "n", "s")
    table = grid.groupBy("k").agg(F.sum("n").alias("tokens"), (F.sum("s") / F.sum("n")).alias("rate"))
    return _recommend(table, F.col("rate") >= target)


def _recommend(table: DataFrame, good: Column) -> DataFrame:
    pick = table.agg(F.coalesce(F.min(F.when(good, F.col("k"))), F.max("k")).alias("recommended"))
    return table.crossJoin(F.broadcast(pick)).withColumn("recommended", (F.col("k") == F.col("recommended")).cast("int"))  # one row


def morphemes(counts: DataFrame, totals: DataFrame, min_profile: int = 1, alpha: float = 0.05) -> DataFrame:
    """Tokens that the G test finds more often among PROFILE tokens; totals are of tokens, so the margins are consistent."""
    cells = contingency(counts, totals.select("n_profile", "n_none")).where((F.col("a") >= min_profile) & (F.col("b") >= 0) & (F.col("d") >= 0))
    a, b, c, d = (F.col(x) for x in "abcd")
    whole = (a + b > 0) & (c + d > 0) & (a + c > 0) & (b + d > 0)
    tested = cells.select("a", "b", "c", "d").distinct().withColumn("llr_g", F.when(whole, stats.g_statistic(a, b, c, d)).otherwise(0.0))
    tested = tested.withColumn("p_value", F.when(whole, stats.chi2_tail("llr_g")).otherwise(1.0))
    out = cells.join(tested, ["a", "b", "c", "d"])
    rate = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0)
    out = out.select("token", F.col("a").alias("count_profile"), F.col("c").alias("count_none"), rate("a", "n_profile").alias("rate_profile"), rate("c", "n_none").alias("rate_none"), stats.odds_ratio(a, b, c, d).alias("odds_ratio"), "llr_g", "p_value")
    return out.where(f"rate_profile > rate_none AND odds_ratio > 1 AND p_value < {alpha}").orderBy(F.desc("odds_ratio"), F.desc("count_profile"), "token")


def token_tiers(stats_df: DataFrame) -> DataFrame:
    """token and its strictest tier, the token's lemma standing for it too."""
    known = stats_df.where(F.col("alpha_tier").isNotNull()).select("token", "alpha_tier")
    return known.unionByName(known.withColumn("token", text.lemma(F.col("token")))).groupBy("token").agg(F.min("alpha_tier").alias("alpha_tier"))

