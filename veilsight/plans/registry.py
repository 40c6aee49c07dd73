"""The registered queries, each an operator over a binding of the sample tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsight.functions import stats, text
from veilsight.operators import annotation, cooccurrence, diagnostics, evaluation, itemsets, phrases, ranking, risk, sampling, tagging, tokens
from veilsight.plans import bindings, commands, sql
from veilsight.session import checkpoint, written, new_folder
from veilsight.sources import readers, runs, sinks
from veilsight.streaming import resume

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def joined(df: DataFrame, column: str = "terms", sep: str = "|") -> DataFrame:
    """An array column as text."""
    return df.withColumn(column, F.array_join(column, sep))


# ---- text ----------------------------------------------------------------


@query(sql.CLAUSES + "SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT clause) AS BIGINT) AS n_distinct FROM cl GROUP BY label")
def clause_split_counts(s, d):
    return bindings.text_clauses(s, d).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("clause").alias("n_distinct"))


@query(sql.CLAUSES + f"SELECT uuid, CAST(count(*) AS BIGINT) AS n, CAST(sum({sql.wc('clause')}) AS BIGINT) AS words, CAST(min({sql.wc('clause')}) AS INTEGER) AS fewest FROM cl GROUP BY uuid")
def clause_word_filter(s, d):
    n = text.word_count(F.col("clause"))
    return bindings.text_clauses(s, d).groupBy("uuid").agg(F.count("*").alias("n"), F.sum(n).alias("words"), F.min(n).alias("fewest"))


@query(sql.TOKENS + "SELECT token, CAST(count(*) FILTER (label = 'PROFILE') AS BIGINT) AS freq_profile, CAST(count(*) FILTER (label = 'NONE') AS BIGINT) AS freq_none FROM tok GROUP BY token")
def token_counts_by_label(s, d):
    return tokens.token_counts(tokens.clause_tokens(bindings.text_clauses(s, d))).drop("pos")


@query(sql.CELLS + "SELECT token, a, b, c, d, round(((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5)), 6) AS odds FROM cells")
def token_contingency_odds(s, d):
    cells = tokens.contingency(*tokens.counts_and_totals(bindings.text_clauses(s, d)))
    return cells.select("token", "a", "b", "c", "d", F.round(stats.odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6).alias("odds"))


@query(sql.FISHER + "SELECT token, round(p, 6) AS p_value FROM fisher")
def token_fisher_p(s, d):
    cells = tokens.contingency(*tokens.counts_and_totals(bindings.text_clauses(s, d)))
    return tokens.fisher(cells).select("token", F.round("p_value", 6).alias("p_value"))


@query(sql.BH + "SELECT token, round(q, 6) AS q_value, n_tested FROM bh")
def token_bh_q(s, d):
    return tokens.token_stats(bindings.text_clauses(s, d)).select("token", F.round("q_value", 6).alias("q_value"), "n_tested")


@query(
    sql.BH
    + "SELECT token, p < 0.05 / n_tested AS strict FROM bh WHERE p < CASE WHEN (SELECT count(*) FROM bh WHERE p < 0.05 / n_tested) > 0 THEN 0.05 / n_tested ELSE 0.05 END"
)
def token_bonferroni(s, d):
    found = tokens.bonferroni(tokens.token_stats(bindings.text_clauses(s, d)))
    return found.select("token", (F.col("p_value") < F.lit(0.05) / F.col("n_tested")).alias("strict"))


@query(sql.BH + "SELECT CASE WHEN q <= 0.01 THEN '0.01' WHEN q <= 0.05 THEN '0.05' WHEN q <= 0.10 THEN '0.10' END AS alpha_tier, CAST(count(*) AS BIGINT) AS n FROM bh GROUP BY 1")
def tier_assignment(s, d):
    return tokens.with_tier(tokens.token_stats(bindings.text_clauses(s, d))).groupBy("alpha_tier").agg(F.count("*").alias("n"))


@query(
    sql.BH
    + """SELECT level, CAST(count(*) FILTER (q <= level) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (q <= level) - count(*) FILTER (q <= 0.05) AS BIGINT) AS delta,
CAST(count(*) FILTER (q <= level AND q > 0.05) AS BIGINT) AS added, CAST(count(*) FILTER (q > level AND q <= 0.05) AS BIGINT) AS lost,
CASE WHEN count(*) FILTER (q <= level OR q <= 0.05) > 0 THEN count(*) FILTER (q <= level AND q <= 0.05)::DOUBLE / count(*) FILTER (q <= level OR q <= 0.05) ELSE 1.0 END AS jaccard
FROM bh, (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.10::DOUBLE)) g(level) GROUP BY level"""
)
def q_sensitivity_jaccard(s, d):
    return tokens.sensitivity(tokens.token_stats(bindings.text_clauses(s, d)).select("q_value"))


@query(
    sql.CELLS
    + """, w AS (SELECT a, ln(((a+.5)*(d+.5))/((b+.5)*(c+.5))) - 1.96*sqrt(1/(a+.5)+1/(b+.5)+1/(c+.5)+1/(d+.5)) > 0 AS sure FROM cells),
t AS (SELECT k, count(*) AS tokens, avg(sure::INT) AS rate FROM w, range(1, 31) r(k) WHERE a >= k GROUP BY k)
SELECT k, CAST(tokens AS BIGINT) AS tokens, round(rate, 6) AS rate, CAST(k = coalesce((SELECT min(k) FROM t WHERE rate >= 0.95), (SELECT max(k) FROM t)) AS INTEGER) AS recommended FROM t"""
)
def or_ci_threshold_scan(s, d):
    cells = tokens.contingency(*tokens.counts_and_totals(bindings.text_clauses(s, d)))
    return tokens.frequency_scan(cells).select("k", "tokens", F.round("rate", 6).alias("rate"), "recommended")


def _vocabulary(clauses):
    """Tokens of a frequency from 3 on: the sample's words carry no significance of their own."""
    return tokens.default_counts(clauses.where("label = 'PROFILE'")).where("freq_profile >= 3").select("token")


def _found(s, d):
    """Clauses with their phrases; clauses are split once for vocabulary and phrases."""
    clauses = checkpoint(bindings.text_clauses(s, d).where("label = 'PROFILE'"))
    return phrases.matches(clauses, _vocabulary(clauses))


@query(sql.PHRASES + "SELECT phrase, CAST(count(*) AS BIGINT) AS freq, CAST(count(DISTINCT (uuid, field, clause_pos)) AS BIGINT) AS clause_freq FROM found GROUP BY phrase")
def phrase_freq(s, d):
    return phrases.phrase_frequencies(_found(s, d)).select("phrase", "freq", "clause_freq")


@query(sql.PHRASES + "SELECT phrase, CAST(count(*) AS BIGINT) AS freq FROM found GROUP BY phrase HAVING count(*) BETWEEN 3 AND 20 AND len(string_split(phrase, ' ')) >= 2")
def phrase_bandpass(s, d):
    return phrases.band(phrases.phrase_frequencies(_found(s, d)).select("phrase", "freq"), 3, 20, multiword=True)


@query(
    sql.PHRASES
    + """, f AS (SELECT phrase, clause, min((uuid, field, clause_pos)) AS place FROM found GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY place) AS rn FROM f),
h AS (SELECT phrase, count(*) AS freq, max((uuid, field, clause_pos, token)) AS last FROM found GROUP BY phrase)
SELECT h.phrase, CAST(freq AS BIGINT) AS freq, last[4] AS head_token, max(clause) FILTER (rn = 1) AS example_clause_1, max(clause) FILTER (rn = 2) AS example_clause_2, max(clause) FILTER (rn = 3) AS example_clause_3
FROM h JOIN r USING (phrase) GROUP BY h.phrase, freq, last"""
)
def phrase_examples_top3(s, d):
    none = s.createDataFrame([], "token string, alpha_tier string")
    clauses = written(bindings.text_clauses(s, d).where("label = 'PROFILE'"))
    return phrases.phrase_table(clauses, _vocabulary(clauses), none).select("phrase", "freq", "head_token", "example_clause_1", "example_clause_2", "example_clause_3")


@query(sql.CLAUSES + ", v(token) AS (VALUES ('tion'), ('ing'), ('ther'), ('and')) SELECT token, CAST(count(*) AS BIGINT) AS n FROM cl JOIN v ON contains(lower(clause), token) GROUP BY token")
def token_substring_theta_join(s, d):
    vocabulary = s.createDataFrame([("tion",), ("ing",), ("ther",), ("and",)], "token string")
    return phrases.substring_matches(bindings.text_clauses(s, d), vocabulary).groupBy("token").agg(F.count("*").alias("n"))


@query(sql.TOKENS + ", v AS (SELECT token FROM tok WHERE label = 'PROFILE' GROUP BY token HAVING count(*) >= 3) SELECT token, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT uuid) AS BIGINT) AS n_records FROM cl JOIN v ON contains(lower(clause), token) GROUP BY token")
def token_containment(s, d):
    """The counted vocabulary against every clause, by containment."""
    clauses = checkpoint(bindings.text_clauses(s, d))
    found = phrases.substring_matches(clauses.select("uuid", "clause"), _vocabulary(clauses))
    return found.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("uuid").alias("n_records"))


@query(
    sql.PHRASES
    + f"""
, h AS (SELECT phrase, sum(CASE WHEN {sql.draw(42, 'uuid', 'field', 'clause_pos')} < 0.5 THEN 1 ELSE 0 END) AS x, sum(CASE WHEN {sql.draw(42, 'uuid', 'field', 'clause_pos')} < 0.5 THEN 0 ELSE 1 END) AS y FROM found GROUP BY phrase),
sd AS (SELECT x AS f, y > 0 AS hit FROM h WHERE x > 0 UNION ALL SELECT y, x > 0 FROM h WHERE y > 0),
t AS (SELECT k, count(f) AS phrases, avg(hit::INT) AS recall FROM range(1, 31) r(k) LEFT JOIN sd ON f >= k GROUP BY k)
SELECT k, CAST(phrases AS BIGINT) AS phrases, round(recall, 6) AS recall, CAST(k = coalesce((SELECT min(k) FROM t WHERE recall >= 0.5), 30) AS INTEGER) AS recommended FROM t"""
)
def twofold_recall(s, d):
    return phrases.twofold_recall(_found(s, d)).select("k", "phrases", F.round("recall", 6).alias("recall"), "recommended")


@query(sql.BH + f"SELECT token, {sql.lemma('token')} AS lemma FROM bh")
def token_lemmas(s, d):
    c = bindings.text_clauses(s, d)
    return tokens.token_counts(tokens.clause_tokens(c)).where("freq_profile > 0").select("token", text.lemma(F.col("token")).alias("lemma"))


# ---- sets and pairs --------------------------------------------------------


@query(sql.basket("p_brand") + sql.set_probability("clause"))
def set_prob_clause(s, d):
    return _set_prob(s, d, "clause")


@query(sql.basket("p_type") + sql.set_probability("field"))
def set_prob_field(s, d):
    return _set_prob(s, d, "field", "p_type")


@query(sql.basket("p_type") + sql.set_probability("uuid"))
def set_prob_record(s, d):
    return _set_prob(s, d, "uuid", "p_type")


def _set_prob(s, d, unit, term="p_brand"):
    out = cooccurrence.set_probabilities(cooccurrence.unit_sets(bindings.basket_detail(s, d, term), (unit,)))
    return joined(out).select("terms", "set_size", "cnt", F.round("probability", 8).alias("probability"))


@query(sql.basket("p_type") + sql.SETS + "SELECT unit, array_to_string(t, '|') AS terms, CAST(count(*) AS BIGINT) AS cnt FROM sets GROUP BY ALL")
def set_prob_all_grains(s, d):
    return joined(cooccurrence.set_probabilities(cooccurrence.unit_sets(bindings.basket_detail(s, d, "p_type")))).select("unit", "terms", "cnt")


def _pairs(s, d):
    return cooccurrence.pair_counts(cooccurrence.unit_sets(bindings.basket_detail(s, d)), 2)


@query(sql.PAIRS + "SELECT unit, a, b, co_count, count_a, count_b, n FROM pairs")
def pair_counts(s, d):
    return _pairs(s, d).select("unit", "a", "b", "co_count", "count_a", "count_b", "n")


@query(sql.PAIRS + f"SELECT unit, a, b, round(log2(co_count::DOUBLE * n / (count_a::DOUBLE * count_b)), 6) AS pmi, round({sql.g2('co_count', 'count_a - co_count', 'count_b - co_count', 'n - count_a - count_b + co_count')}, 5) AS g2, co_count > count_a::DOUBLE * count_b / n AS positive FROM pairs")
def pair_pmi_g2(s, d):
    return cooccurrence.pair_associations(_pairs(s, d)).select("unit", "a", "b", F.round("pmi", 6).alias("pmi"), F.round("g2", 5).alias("g2"), "positive")


@query(sql.PAIRS + sql.FDR)
def pair_fdr(s, d):
    sets = checkpoint(cooccurrence.unit_sets(bindings.basket_detail(s, d)))
    return cooccurrence.significant_pairs(cooccurrence.pair_counts(sets, 2), 0.05).withColumn("probability", F.round("probability", 8))


@query(sql.TEXT_PAIRS + sql.FDR)
def pair_fdr_text(s, d):
    """Pairs of clauses and of texts, each with its own false-discovery control."""
    sets = checkpoint(cooccurrence.unit_sets(bindings.basket_texts(s, d), ("clause", "text")))
    return cooccurrence.significant_pairs(cooccurrence.pair_counts(sets, 2), 0.05).withColumn("probability", F.round("probability", 8))


# ---- itemsets ---------------------------------------------------------------


def _weighted(s, d):
    return itemsets.weighted_sets(cooccurrence.unit_sets(bindings.basket_detail(s, d, "p_type"), ("field",)))


_ITEMSETS = "WITH RECURSIVE" + sql.basket("p_type").removeprefix("WITH") + sql.ITEMSETS


@query(_ITEMSETS + "SELECT combo, size, support_count FROM items")
def itemsets_apriori(s, d):
    return joined(itemsets.frequent_itemsets(_weighted(s, d), 5), "combo")


@query(_ITEMSETS + "SELECT combo, size, support_count, round(100.0 * support_count / (SELECT sum(cnt) FROM ws), 6) AS support_pct FROM items WHERE size >= 3")
def itemset_support_pct(s, d):
    found = itemsets.combinations(_weighted(s, d), 3, 0, 5.0)
    return joined(found, "combo").withColumn("support_pct", F.round("support_pct", 6))


# ---- risk -------------------------------------------------------------------


@query(sql.basket("p_brand") + sql.set_records("clause"))
def risk_set_records_clause(s, d):
    return _records(risk.set_records(bindings.basket_detail(s, d)))


@query(sql.basket("p_brand") + sql.set_records("field"))
def risk_set_records_field(s, d):
    return _records(risk.set_records(bindings.basket_detail(s, d), "field"))


def _records(df):
    return joined(df).withColumn("probability", F.round("probability", 8))


@query(sql.basket("p_brand") + "SELECT term, CAST(count(DISTINCT uuid) AS BIGINT) AS record_count, round(count(DISTINCT uuid)::DOUBLE / (SELECT count(DISTINCT uuid) FROM b), 8) AS probability FROM b GROUP BY term")
def risk_term_records(s, d):
    return risk.term_records(written(bindings.basket_detail(s, d))).select("term", "record_count", F.round("probability", 8).alias("probability"))


@query(
    sql.basket("p_brand")
    + """SELECT CAST(count(DISTINCT uuid) AS BIGINT) AS N, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(DISTINCT t) AS BIGINT) AS n_phrase_sets,
CAST((SELECT count(DISTINCT t) FROM (SELECT uuid, field, list_sort(list_distinct(list(term))) AS t FROM b GROUP BY uuid, field)) AS BIGINT) AS n_field_sets, CAST((SELECT count(DISTINCT term) FROM b) AS BIGINT) AS n_terms FROM det"""
)
def risk_meta(s, d):
    return risk.risk_meta(bindings.basket_detail(s, d))


def _spans(s, d):
    return _spans_of(written(bindings.basket_orders(s, d)))


def _spans_of(orders):
    return risk.dedupe_spans(risk.join_spans(bindings.spans_of(orders), orders.drop("label")))


@query(sql.SPANS + "SELECT text, label, qi_json, size, freq FROM spans")
def span_dedupe(s, d):
    return _spans(s, d).drop("qi")


@query(sql.SPANS + "SELECT text, label, qi_json, CAST(coalesce(record_count, 0) AS BIGINT) AS support FROM spans LEFT JOIN rec USING (qi)")
def span_support_join(s, d):
    orders = written(bindings.basket_orders(s, d))
    sets = risk.set_records(orders.drop("label")).select(F.col("terms").alias("qi"), "record_count")
    return _spans_of(orders).join(sets, "qi", "left").select("text", "label", "qi_json", F.coalesce("record_count", F.lit(0)).cast("long").alias("support"))


def _scored(s, d):
    return _scored_and_terms(s, d)[0]


def _scored_and_terms(s, d):
    """Scored spans and the terms' records; the orders are gathered once for both."""
    orders = written(bindings.basket_orders(s, d))
    detail = orders.drop("label")
    terms = checkpoint(risk.term_records(detail))
    return risk.score_spans(written(_spans_of(orders)), risk.set_records(detail), terms, checkpoint(risk.records(detail))), terms


@query(sql.SCORES + "SELECT text, provenance, support, y_risk FROM scored")
def y_risk(s, d):
    return _scored(s, d).select("text", "provenance", "support", "y_risk")


@query(sql.SCORES + "SELECT text, y_bits, y_bits_capped, min_constituent_df FROM scored")
def y_bits(s, d):
    return _scored(s, d).select("text", "y_bits", "y_bits_capped", "min_constituent_df")


@query(sql.SCORES + "SELECT text, provenance, y_combined FROM scored")
def y_combined(s, d):
    return _scored(s, d).select("text", "provenance", "y_combined")


@query(sql.SCORES + "SELECT max(y_bits) FILTER (provenance = 'PROFILE') AS ceiling_bits, max(y_combined) FILTER (provenance = 'PROFILE') AS ceiling_combined FROM scored")
def pii_ceiling(s, d):
    return risk.ceilings(_scored(s, d))


@query(
    sql.basket("p_brand")
    + """, df AS (SELECT term, count(DISTINCT uuid) AS df FROM b GROUP BY term), st AS (SELECT DISTINCT t FROM det), fl AS (SELECT t, unnest(t) AS term FROM st)
SELECT array_to_string(t, '|') AS terms, CAST(max(length(term)) AS INTEGER) AS char_len_max, round(avg(length(term)), 3) AS char_len_mean, round(avg(len(string_split(trim(term), ' '))), 3) AS n_words_mean,
CAST(max(CASE WHEN regexp_matches(term, '[0-9]') THEN 1 ELSE 0 END) AS INTEGER) AS has_digit, CAST(min(df) AS BIGINT) AS const_support_min, round(avg(df), 3) AS const_support_mean FROM fl JOIN df USING (term) GROUP BY t"""
)
def reid_features(s, d):
    detail = written(bindings.basket_detail(s, d))
    return joined(risk.set_features(risk.set_records(detail), risk.term_records(detail)))


@query(sql.SCORES + f", k AS (SELECT text, {sql.SPLIT_KEY} AS split_key FROM scored) SELECT text, split_key, CASE WHEN {sql.mod1000('split_key')} < 200 THEN 'test' ELSE 'train' END AS split FROM k")
def md5_group_split(s, d):
    scored, terms = _scored_and_terms(s, d)
    rows = risk.split_key(terms, scored)
    return rows.select("text", "split_key", stats.split_of(F.col("split_key")).alias("split"))


@query(sql.SCORES + sql.LDS + "SELECT text, round(w, 6) AS lds_weight FROM lds")
def lds_weights(s, d):
    return risk.lds_weights(checkpoint(_scored(s, d).select("text", "y_risk"))).select("text", F.round("lds_weight", 6).alias("lds_weight"))


@query(
    sql.SCORES
    + f"""
, k AS (SELECT *, {sql.SPLIT_KEY} AS split_key FROM scored), sp AS (SELECT *, CASE WHEN {sql.mod1000('split_key')} < 200 THEN 'test' ELSE 'train' END AS split FROM k),
z AS (SELECT *, split = 'train' AND provenance = 'PROFILE' AND support = 1 AS one FROM sp),
r AS (SELECT *, row_number() OVER (PARTITION BY one ORDER BY {sql.draw(42, 'text')}, text) AS rn FROM z)
SELECT text, provenance, split FROM r WHERE NOT one OR rn <= 100"""
)
def rebalance_caps(s, d):
    scored, terms = _scored_and_terms(s, d)
    rows = risk.split_key(terms, scored.select("text", "provenance", "support", "size", "qi")).withColumn("split", stats.split_of(F.col("split_key")))
    return sampling.rebalance(written(rows.drop("qi", "split_key")), max_support1=100).select("text", "provenance", "split")


@query(
    sql.SCORES
    + f"""
, q AS (SELECT text, y_risk, ntile(10) OVER (ORDER BY y_risk, text) AS bin FROM scored), m AS (SELECT min(n) AS per_bin FROM (SELECT count(*) AS n FROM q GROUP BY bin)),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {sql.draw(42, 'text')}, text) AS rn FROM q) SELECT text, y_risk FROM r, m WHERE rn <= per_bin"""
)
def bin_equal_sample(s, d):
    rows = checkpoint(_scored(s, d).select("text", "y_risk"))
    return sampling.bin_equal(rows, "y_risk", 10, ["text"])


@query(sql.BH + f", r AS (SELECT token, freq_none, row_number() OVER (ORDER BY {sql.draw(42, 'token')}, token) AS rn FROM bh WHERE q > 0.5 AND freq_none >= freq_profile) SELECT token, freq_none FROM r WHERE rn <= 50")
def none_anchors(s, d):
    return sampling.none_anchors(checkpoint(tokens.token_stats(bindings.text_clauses(s, d))), 50)


@query(sql.SCORES + f", r AS (SELECT text, row_number() OVER (ORDER BY -ln({sql.draw(42, 'text')}) / (1 + y_risk), text) AS rn FROM scored) SELECT text FROM r WHERE rn <= 200")
def weighted_sample(s, d):
    return sampling.weighted(checkpoint(_scored(s, d).select("text", (1 + F.col("y_risk")).alias("w"))), 200, "w", ["text"]).select("text")


@query(
    f"""WITH n AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {sql.draw(42, 'c_custkey')}, c_custkey) AS rn FROM customer)
SELECT c_custkey, c_mktsegment FROM r JOIN n ON label = c_mktsegment WHERE rn <= greatest(1, round_even(n * 300.0 / (SELECT sum(n) FROM n), 0))"""
)
def stratified_subsample(s, d):
    return sampling.stratified(bindings.table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 300, ["c_custkey"])


@query(f"SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY {sql.draw(42, 'c_custkey')}, c_custkey) - 1) % 5 AS INTEGER) AS fold FROM customer")
def kfold_assign(s, d):
    return sampling.k_fold(bindings.table(s, d, "customer").select("c_custkey", "c_mktsegment"), 5, ["c_custkey"], "c_mktsegment").select("c_custkey", "fold")


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)) AS weight FROM customer GROUP BY c_mktsegment")
def class_weights(s, d):
    return sampling.class_weights(bindings.table(s, d, "customer"), "c_mktsegment")


@query(
    sql.SCORES
    + f", sk AS (SELECT *, {sql.SPLIT_KEY} AS split_key FROM scored), sp AS (SELECT *, CASE WHEN {sql.mod1000('split_key')} < 200 THEN 'test' ELSE 'train' END AS split FROM sk), train AS (SELECT * FROM sp WHERE split = 'train')"
    + sql.LDS.replace("FROM scored", "FROM train")
    + """SELECT sp.text, label, qi_json, size, freq, provenance, support, (SELECT n FROM N) AS N, sp.y_risk, y_bits, y_bits_capped, min_constituent_df, y_combined, '' AS tier_strictest, split,
CASE WHEN split = 'train' THEN round(w, 6) ELSE 1.0::DOUBLE END AS lds_weight FROM sp LEFT JOIN lds ON sp.text = lds.text"""
)
def training_spans(s, d):
    """The span training table, end to end."""
    orders = written(bindings.basket_orders(s, d))
    detail = orders.drop("label")
    return commands.sample_spans(commands.span_join(bindings.spans_of(orders), detail), commands.risk_sets(detail)).drop("qi")


@query(
    sql.basket("p_type")
    + """, df AS (SELECT term, count(DISTINCT uuid) AS df FROM b GROUP BY term), nn AS (SELECT CAST(count(DISTINCT uuid) AS BIGINT) AS n FROM b),
fs AS (SELECT uuid, list_sort(list_distinct(list(term))) AS t FROM b GROUP BY uuid, field),
st AS (SELECT 'phrase' AS unit_type, t, CAST(count(DISTINCT uuid) AS BIGINT) AS support FROM det GROUP BY t UNION ALL SELECT 'field', t, CAST(count(DISTINCT uuid) AS BIGINT) FROM fs GROUP BY t),
ft AS (SELECT unit_type, t, CAST(max(length(term)) AS INTEGER) AS char_len_max, round(avg(length(term)), 3) AS char_len_mean, round(avg(len(string_split(trim(term), ' '))), 3) AS n_words_mean,
  CAST(max(CASE WHEN regexp_matches(term, '[0-9]') THEN 1 ELSE 0 END) AS INTEGER) AS has_digit, CAST(min(df) AS BIGINT) AS const_support_min, round(avg(df), 3) AS const_support_mean, min((df, term)) AS rare
  FROM (SELECT unit_type, t, unnest(t) AS term FROM st) JOIN df USING (term) GROUP BY unit_type, t),
scored AS (SELECT unit_type || array_to_string(t, '|') AS text, unit_type, array_to_string(t, '|') AS terms, CAST(len(t) AS INTEGER) AS size, support, n, round(log10(n::DOUBLE / support), 6) AS y_risk, rare[2] AS split_key, char_len_max, char_len_mean, n_words_mean, has_digit, const_support_min, const_support_mean
  FROM st JOIN ft USING (unit_type, t), nn)"""
    + sql.LDS
    + f"""SELECT 'PROFILE' AS provenance, unit_type, size, terms, support, n AS N, s.y_risk, '' AS tier_strictest, char_len_max, char_len_mean, n_words_mean, has_digit, const_support_min, const_support_mean,
round(w, 6) AS lds_weight, CASE WHEN {sql.mod1000('split_key')} < 200 THEN 'test' ELSE 'train' END AS split FROM scored s JOIN lds ON s.text = lds.text"""
)
def training_sets(s, d):
    """The set training table, end to end."""
    return joined(commands.sample_balanced(commands.risk_sets(bindings.basket_detail(s, d, "p_type"))))


@query(
    sql.basket("p_type")
    + f""", tx AS (SELECT uuid, field, list_sort(list_distinct(list(term))) AS t FROM b GROUP BY uuid, field), st AS (SELECT t, count(*) AS n FROM tx GROUP BY t),
pr AS (SELECT n, count(*) AS sets, n::DOUBLE / (SELECT count(*) FROM tx) AS p, least(floor(ln(greatest(1.0::DOUBLE, n * count(*))) * 10), n * count(*)) AS cap FROM st GROUP BY n),
r AS (SELECT uuid, field, n, row_number() OVER (PARTITION BY n ORDER BY {sql.draw(42, 'uuid', 'field')}, uuid, field) AS rn FROM tx JOIN st USING (t))
SELECT uuid, field, round(((SELECT max(p) FROM pr) - p) / (SELECT max(p) FROM pr), 9) AS y FROM r JOIN pr USING (n) WHERE rn <= cap"""
)
def target_dataset(s, d):
    out = sampling.target_rows(bindings.basket_detail(s, d, "p_type").groupBy("uuid", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_terms")))).alias("terms")))
    return out.withColumn("y", F.round("y", 9))


# ---- evaluation --------------------------------------------------------------


@query(
    "WITH p AS (SELECT l_returnflag AS t, CASE WHEN l_linestatus = 'F' THEN 'A' WHEN l_quantity > 25 THEN 'N' ELSE 'R' END AS p FROM lineitem), l(x) AS (VALUES ('A'), ('N'), ('R'))"
    " SELECT a.x AS true_label, b.x AS pred_label, CAST((SELECT count(*) FROM p WHERE t = a.x AND p = b.x) AS BIGINT) AS n FROM l a, l b"
)
def confusion_matrix(s, d):
    return evaluation.confusion(_flags(s, d), ("A", "N", "R"))


def _flags(s, d):
    guess = F.when(F.col("l_linestatus") == "F", "A").when(F.col("l_quantity") > 25, "N").otherwise("R")
    return bindings.table(s, d, "lineitem").select(F.col("l_returnflag").alias("y_true"), guess.alias("y_pred"))


@query(
    """WITH p AS (SELECT l_returnflag AS t, CASE WHEN l_linestatus = 'F' THEN 'A' WHEN l_quantity > 25 THEN 'N' ELSE 'R' END AS p FROM lineitem), l(x) AS (SELECT t FROM p UNION SELECT p FROM p),
c AS (SELECT x, (SELECT count(*) FROM p WHERE t = x AND p = x) AS tp, (SELECT count(*) FROM p WHERE p = x) AS pr, (SELECT count(*) FROM p WHERE t = x) AS su FROM l),
f AS (SELECT x AS label, tp, su, CASE WHEN pr > 0 THEN tp::DOUBLE / pr ELSE 0 END AS precision, CASE WHEN su > 0 THEN tp::DOUBLE / su ELSE 0 END AS recall FROM c),
g AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM f)
SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, CAST(su AS BIGINT) AS support FROM g
UNION ALL SELECT 'macro avg', round(avg(precision), 8), round(avg(recall), 8), round(avg(f1), 8), CAST(sum(su) AS BIGINT) FROM g
UNION ALL SELECT 'weighted avg', round(sum(precision * su) / sum(su), 8), round(sum(recall * su) / sum(su), 8), round(sum(f1 * su) / sum(su), 8), CAST(sum(su) AS BIGINT) FROM g
UNION ALL SELECT 'accuracy', round(sum(tp)::DOUBLE / sum(su), 8), round(sum(tp)::DOUBLE / sum(su), 8), round(sum(tp)::DOUBLE / sum(su), 8), CAST(sum(su) AS BIGINT) FROM g"""
)
def f1_report(s, d):
    out = evaluation.f1_report(_flags(s, d))
    return out.select("label", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(sql.PREDICTIONS + sql.STRATA + "SELECT stratum, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mean_true, 6) AS mean_true, round(mean_pred, 6) AS mean_pred FROM per")
def eval_mae_rmse_strata(s, d):
    out = evaluation.stratified_errors(evaluation.test_rows(bindings.predictions(s, d)))
    return out.select("stratum", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mean_true", "mean_pred")])


@query(sql.PREDICTIONS + sql.STRATA + "SELECT round(avg(mae), 6) AS macro_mae, round(avg(rmse), 6) AS macro_rmse, CAST(count(*) AS BIGINT) AS strata FROM per")
def eval_macro(s, d):
    out = evaluation.macro_errors(evaluation.test_rows(bindings.predictions(s, d)))
    return out.select(F.round("macro_mae", 6).alias("macro_mae"), F.round("macro_rmse", 6).alias("macro_rmse"), "strata")


@query(
    sql.PREDICTIONS
    + """, m AS (SELECT avg(y_true) AS mean, max(y_true) AS top FROM p), bl AS (SELECT 'mean' AS baseline, y_true, mean AS y_pred FROM p, m UNION ALL SELECT 'ymax', y_true, top FROM p, m
UNION ALL SELECT 'support', y_true, CASE WHEN abs(y_true) <= 1e-8 THEN 0 ELSE log10(1000.0::DOUBLE / greatest(1, support)) END FROM p)
SELECT baseline, round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse FROM bl GROUP BY baseline"""
)
def eval_baselines(s, d):
    rows = evaluation.baselines(evaluation.test_rows(bindings.predictions(s, d)), 1000.0)
    diff = F.col("y_true") - F.col("y_pred")
    return rows.groupBy("baseline").agg(F.round(F.avg(F.abs(diff)), 6).alias("mae"), F.round(F.sqrt(F.avg(diff * diff)), 6).alias("rmse"))


@query(sql.PREDICTIONS + sql.RANKS + "SELECT round(corr(rx, ry), 6) AS spearman, CAST(count(*) AS BIGINT) AS n FROM r")
def spearman(s, d):
    out = evaluation.spearman(evaluation.test_rows(bindings.predictions(s, d)))
    return out.select(F.round("spearman", 6).alias("spearman"), "n")


@query(sql.PREDICTIONS + sql.RANKS + ", q AS (SELECT ry, abs(y_true - top) <= 1e-8 + 1e-5 * top AS pos FROM r, (SELECT max(y_true) AS top FROM p)) SELECT round((sum(ry) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc, CAST(count(*) FILTER (pos) AS BIGINT) AS n_pos FROM q")
def unicity_auc(s, d):
    rows = evaluation.test_rows(bindings.predictions(s, d))
    top = rows.crossJoin(F.broadcast(rows.agg(F.max("y_true").alias("top"))))  # one row
    out = evaluation.auc(top, "y_pred", evaluation.close(F.col("y_true"), F.col("top")))
    return out.select(F.round("auc", 6).alias("auc"), "n_pos")


@query(
    sql.PREDICTIONS
    + """, m AS (SELECT avg(y_true) AS mean, max(y_true) AS top FROM p), bl AS (SELECT 'model' AS model, y_true, y_pred FROM p UNION ALL SELECT 'mean', y_true, mean FROM p, m UNION ALL SELECT 'ymax', y_true, top FROM p, m
UNION ALL SELECT 'support', y_true, CASE WHEN abs(y_true) <= 1e-8 THEN 0 ELSE log10(pow(10.0::DOUBLE, top) / greatest(1, support)) END FROM p, m),
sm AS (SELECT model, y_true, y_pred, unnest(list_filter([CASE WHEN abs(y_true) <= 1e-8 THEN 'zero' END, CASE WHEN y_true > 0 AND (y_true < 1 OR y_true < top) THEN CASE WHEN y_true < 1 THEN 'below one' ELSE floor(y_true)::VARCHAR END END,
  CASE WHEN abs(y_true - top) <= 1e-8 + 1e-5 * abs(top) THEN 'top' END], lambda x: x IS NOT NULL)) AS stratum FROM bl, m),
ps AS (SELECT model, stratum, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse FROM sm GROUP BY ALL),
ma AS (SELECT model, avg(mae) AS macro_mae, avg(rmse) AS macro_rmse, CAST(count(*) AS BIGINT) AS strata FROM ps GROUP BY model),
rk AS (SELECT model, y_true, y_pred, rank() OVER (PARTITION BY model ORDER BY y_true) + (count(*) OVER (PARTITION BY model, y_true) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY model ORDER BY y_pred) + (count(*) OVER (PARTITION BY model, y_pred) - 1) / 2.0 AS ry, abs(y_true - top) <= 1e-8 + 1e-5 * abs(top) AS pos FROM bl, m),
er AS (SELECT model, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, CAST(count(*) AS BIGINT) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS spearman,
  (sum(ry) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc FROM rk GROUP BY model)
SELECT model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, n, round(macro_mae, 6) AS macro_mae, round(macro_rmse, 6) AS macro_rmse, strata, round(spearman, 6) AS spearman, round(auc, 6) AS auc FROM er JOIN ma USING (model)"""
)
def eval_report(s, d):
    out = evaluation.report(bindings.predictions(s, d))
    return out.select("model", "n", "strata", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "macro_mae", "macro_rmse", "spearman", "auc")])


# ---- diagnostics -------------------------------------------------------------


@query("SELECT x.share AS share, round(x.value, 6) AS value FROM (SELECT unnest([{'share': 0.5::DOUBLE, 'value': quantile_cont(o_totalprice, 0.5)}, {'share': 0.9::DOUBLE, 'value': quantile_cont(o_totalprice, 0.9)}, {'share': 0.99::DOUBLE, 'value': quantile_cont(o_totalprice, 0.99)}, {'share': 0.999::DOUBLE, 'value': quantile_cont(o_totalprice, 0.999)}]) AS x FROM orders)")
def percentiles(s, d):
    return diagnostics.percentiles(bindings.table(s, d, "orders"), "o_totalprice", (0.5, 0.9, 0.99, 0.999)).withColumn("value", F.round("value", 6))


@query(sql.SCORES + """, e AS (SELECT greatest(6.0::DOUBLE, ceil(max(y_combined) / 2) * 2) AS top FROM scored),
l AS (SELECT CASE WHEN y_combined < 6 THEN floor(y_combined * 2) / 2 WHEN floor((y_combined - 6) / 2) * 2 + 6 >= top AND top > 6 THEN top - 2 ELSE floor((y_combined - 6) / 2) * 2 + 6 END AS lo FROM scored, e)
SELECT CAST(lo AS DOUBLE) AS lo, CAST(lo + CASE WHEN lo < 6 THEN 0.5 ELSE 2 END AS DOUBLE) AS hi, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY lo""")
def hist_targets(s, d):
    return diagnostics.target_bins(checkpoint(_scored(s, d).select("y_combined")))


@query(sql.SCORES + sql.LDS + """, h AS (SELECT greatest(0.5::DOUBLE, ceil(y_risk * 2) / 2) AS hi, count(*) AS n, sum(w) AS w FROM lds GROUP BY 1)
SELECT hi, CAST(n AS BIGINT) AS n, round(100.0 * n / sum(n) OVER (), 5) AS n_percent, round(100.0 * w / sum(w) OVER (), 5) AS weight_percent FROM h""")
def hist_weighted(s, d):
    out = diagnostics.weighted_bins(risk.lds_weights(checkpoint(_scored(s, d).select("text", "y_risk"))))
    return out.select("hi", "n", F.round("n_percent", 5).alias("n_percent"), F.round("weight_percent", 5).alias("weight_percent"))


def _freqs(s, d):
    return bindings.table(s, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("phrase")).agg(F.count("*").alias("freq"))


@query(sql.FREQS + f"SELECT CAST(lo AS BIGINT) AS lo, CAST(count(freq) AS BIGINT) AS n, 100.0::DOUBLE * count(freq) / (SELECT count(*) FROM f) AS percent FROM ({sql.FREQ_BINS}) e LEFT JOIN f ON freq >= e.lo AND freq < e.hi GROUP BY lo")
def hist_log_freq(s, d):
    return diagnostics.frequency_bins(_freqs(s, d))


@query(
    sql.FREQS
    + """, v(k) AS (VALUES (45), (40), (35), (30), (20)), r AS (SELECT k, phrase, freq, row_number() OVER (PARTITION BY k ORDER BY freq, phrase DESC) AS rn FROM f, v WHERE freq > k)
SELECT CAST(v.k AS BIGINT) AS k, CAST((SELECT count(*) FROM f WHERE freq > v.k) AS BIGINT) AS dropped, 100.0::DOUBLE * (SELECT count(*) FROM f WHERE freq > v.k) / (SELECT count(*) FROM f) AS percent,
coalesce((SELECT string_agg(phrase || '(' || freq || ')', ', ' ORDER BY freq DESC, phrase DESC) FROM r WHERE rn <= 6 AND r.k = v.k), '') AS nearest FROM v"""
)
def k_grid_exclusion(s, d):
    return diagnostics.frequency_grid(_freqs(s, d), (45, 40, 35, 30, 20))


@query(
    sql.basket("p_type")
    + """, df AS (SELECT term, 100.0 * count(DISTINCT uuid) / (SELECT count(DISTINCT uuid) FROM b) AS r FROM b GROUP BY term),
e(lo, hi) AS (VALUES (50, 101), (30, 50), (20, 30), (10, 20), (5, 10), (1, 5), (0, 1))
SELECT CAST(lo AS INTEGER) AS lo, CAST(count(r) AS BIGINT) AS n, 100.0::DOUBLE * count(r) / (SELECT count(*) FROM df) AS percent FROM e LEFT JOIN df ON r >= lo AND r < hi GROUP BY lo"""
)
def rate_buckets(s, d):
    detail = bindings.basket_detail(s, d, "p_type")
    return diagnostics.rate_buckets(risk.term_records(detail), risk.records(detail))


@query(
    sql.SCORES
    + """, q AS (SELECT 'all' AS part, size FROM scored WHERE provenance = 'PROFILE' UNION ALL SELECT 'support1', size FROM scored WHERE provenance = 'PROFILE' AND support = 1 UNION ALL SELECT 'support2', size FROM scored WHERE provenance = 'PROFILE' AND support >= 2)
SELECT part, CAST(size AS INTEGER) AS size, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY part), 6) AS percent FROM q GROUP BY part, size"""
)
def support1_decomposition(s, d):
    out = diagnostics.support_sizes(_scored(s, d))
    return out.withColumn("percent", F.round("percent", 6))


@query(sql.SCORES + ", r AS (SELECT min_constituent_df AS m FROM scored WHERE provenance = 'PROFILE' AND support = 1) SELECT CAST(k AS INTEGER) AS k, CAST(count(*) FILTER (m < k) AS BIGINT) AS affected, round(100.0 * count(*) FILTER (m < k) / greatest(1, count(*)), 6) AS percent FROM (VALUES (3), (5), (10), (20), (50)) g(k), r GROUP BY k")
def support1_grid(s, d):
    rare = diagnostics.support1_rarest(*_scored_and_terms(s, d))
    return diagnostics.support1_grid(rare).withColumn("percent", F.round("percent", 6))


@query(sql.SCORES + ", v AS (SELECT support, count(*) AS n FROM scored WHERE provenance = 'PROFILE' GROUP BY support) SELECT support, CAST(n AS BIGINT) AS n, round(100.0 * n / (SELECT sum(n) FROM v), 6) AS percent FROM v ORDER BY n DESC, support LIMIT 8")
def support_topk(s, d):
    out = diagnostics.value_shares(_scored(s, d).where("provenance = 'PROFILE'"), "support").limit(8)
    return out.withColumn("percent", F.round("percent", 6))


@query(sql.SCORES + ", v AS (SELECT provenance, count(*) AS n FROM scored GROUP BY 1) SELECT provenance, CAST(n AS BIGINT) AS n, round(100.0 * n / (SELECT sum(n) FROM v), 6) AS percent FROM v")
def provenance_shares(s, d):
    return diagnostics.value_shares(_scored(s, d), "provenance").withColumn("percent", F.round("percent", 6))


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS n FROM orders), t AS (SELECT n, l_partkey FROM o JOIN lineitem ON l_orderkey = o_orderkey),
g AS (SELECT DISTINCT CAST(floor((SELECT max(n) + 1 FROM t) * i / 10.0) AS BIGINT) AS n FROM range(1, 11) r(i)), f AS (SELECT l_partkey, min(n) AS first FROM t GROUP BY 1),
pt AS (SELECT g.n, count(*) AS seen FROM g JOIN f ON first < g.n GROUP BY g.n)
SELECT round(regr_slope(ln(seen), ln(n)), 6) AS beta, round(exp(regr_intercept(ln(seen), ln(n))), 5) AS k, round(exp(regr_intercept(ln(seen), ln(n))) * 1000000.0 ** regr_slope(ln(seen), ln(n)), 2) AS estimate FROM pt"""
)
def heaps_fit(s, d):
    orders = bindings.table(s, d, "orders").select("o_custkey", "o_orderkey")
    numbered = ranking.running(orders.select("o_custkey").distinct(), [F.col("o_custkey").asc()], {"n": F.lit(1)}).withColumn("n", F.col("n") - 1)
    lines = bindings.table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    rows = orders.join(numbered, "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("n").alias("at"), "l_partkey")
    out = phrases.heaps(phrases.growth(rows, "at", "l_partkey"), 1_000_000)
    return out.select(F.round("beta", 6).alias("beta"), F.round("k", 5).alias("k"), F.round("estimate", 2).alias("estimate"))


@query("WITH o AS (SELECT row_number() OVER () AS place, l_returnflag AS flag FROM lineitem), c AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (ORDER BY place) THEN 1 ELSE 0 END AS new FROM o), r AS (SELECT flag, sum(new) OVER (ORDER BY place) AS run FROM c), n AS (SELECT flag, run, count(*) AS n FROM r GROUP BY ALL) SELECT flag, CAST(count(*) AS BIGINT) AS runs, CAST(max(n) AS BIGINT) AS longest FROM n GROUP BY flag")
def consecutive_runs(s, d):
    """Runs of equal return flags in the order in which the files hold the lines."""
    placed = runs.runs_of(bindings.table(s, d, "lineitem").select(F.col("l_returnflag").alias("flag")), "flag")
    return placed.groupBy("flag", "run").agg(F.count("*").alias("n")).groupBy("flag").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


# ---- annotation ---------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def resume_anti_join(s, d):
    done = bindings.table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return annotation.not_done(bindings.table(s, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey AND m.l_returnflag = 'R')")
def unannotated_pairs_anti_join(s, d):
    lines = bindings.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return annotation.not_done(lines, lines.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id AS uuid, source AS field, toxic::DOUBLE AS y, text FROM documents JOIN labels USING (doc_id)")
def target_source_join(s, d):
    docs, labels = bindings.table(s, d, "documents"), bindings.table(s, d, "labels")
    targets = docs.select("doc_id", "source").join(labels, "doc_id").select(F.col("doc_id").alias("uuid"), F.col("source").alias("field"), F.col("toxic").cast("double").alias("y"))
    sources = docs.select(F.col("doc_id").alias("uuid"), F.col("source").alias("field"), F.lit(0).alias("text_pos"), "text")
    return annotation.join_targets(targets, sources).select("uuid", "field", "y", "text")


@query(
    sql.TOKENS
    + f"""
, n AS (SELECT count(*) FILTER (label = 'PROFILE') AS np, count(*) FILTER (label = 'NONE') AS nn FROM tok), g AS (SELECT token, count(*) FILTER (label = 'PROFILE') AS a, count(*) FILTER (label = 'NONE') AS c FROM tok GROUP BY token),
q AS (SELECT token, a, np - a AS b, c, nn - c AS d, np, nn FROM g, n WHERE a >= 5), r AS (SELECT *, {sql.g2('a', 'b', 'c', 'd')} AS llr, ((a + .5) * (d + .5)) / ((b + .5) * (c + .5)) AS odds FROM q)
SELECT token, CAST(a AS BIGINT) AS count_profile, CAST(c AS BIGINT) AS count_none, round(odds, 6) AS odds_ratio, round(llr, 5) AS llr_g FROM r WHERE a::DOUBLE / np > c::DOUBLE / nn AND odds > 1 AND llr > 3.841458820694124"""
)
def morpheme_gtest(s, d):
    counts = checkpoint(tokens.token_counts(tokens.clause_tokens(bindings.text_clauses(s, d))))
    totals = counts.agg(F.coalesce(F.sum("freq_profile"), F.lit(0)).alias("n_profile"), F.coalesce(F.sum("freq_none"), F.lit(0)).alias("n_none"))
    out = tokens.morphemes(counts, totals, 5)
    return out.select("token", "count_profile", "count_none", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("llr_g", 5).alias("llr_g"))


@query(
    sql.TOKENS
    + f"""
, nm AS (SELECT label, token FROM tok UNION ALL SELECT 'PROFILE', token FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS token FROM part) WHERE length(token) >= 3 AND {sql._NOUN}),
n AS (SELECT count(*) FILTER (label = 'PROFILE') AS np, count(*) FILTER (label = 'NONE') AS nn FROM nm), g AS (SELECT token, count(*) FILTER (label = 'PROFILE') AS a, count(*) FILTER (label = 'NONE') AS c FROM nm GROUP BY token),
q AS (SELECT token, a, np - a AS b, c, nn - c AS d, np, nn FROM g, n WHERE a >= 5), r AS (SELECT *, {sql.g2('a', 'b', 'c', 'd')} AS llr, ((a + .5) * (d + .5)) / ((b + .5) * (c + .5)) AS odds FROM q)
SELECT token, CAST(a AS BIGINT) AS count_profile, CAST(c AS BIGINT) AS count_none, round(a::DOUBLE / np, 9) AS rate_profile, round(odds, 6) AS odds_ratio, round(llr, 5) AS llr_g FROM r WHERE a::DOUBLE / np > c::DOUBLE / nn AND odds > 1 AND llr > 3.841458820694124"""
)
def dictionary_run(s, d):
    """The dictionary command from end to end, the parts' names being its second source."""
    out = commands.dictionary(bindings.text_clauses(s, d), bindings.table(s, d, "part"), ("p_name",), min_profile=5)
    return out.select("token", "count_profile", "count_none", F.round("rate_profile", 9).alias("rate_profile"), F.round("odds_ratio", 6).alias("odds_ratio"), F.round("llr_g", 5).alias("llr_g"))


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 10.0 AS a, l_discount * 30 AS b, l_tax * 40 AS c FROM lineitem), e AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN a >= b AND a >= c THEN 'NONE' WHEN b >= c THEN 'PII' ELSE 'PROFILE' END AS label, round(greatest(ea, eb, ec) / (ea + eb + ec), 8) AS score FROM e"""
)
def softmax_argmax(s, d):
    logits = F.array(F.col("l_quantity") / 10.0, F.col("l_discount") * 30, F.col("l_tax") * 40)
    rows = bindings.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", annotation.softmax(logits).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", annotation.argmax(F.col("p"), ("NONE", "PII", "PROFILE")).alias("label"), F.round(F.array_max("p"), 8).alias("score"))


@query("SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS clipped, CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) >= 0.5 AS INTEGER) AS pred FROM events")
def threshold_clip(s, d):
    clipped, pred = annotation.clip_and_threshold(F.col("value") / 100)
    return bindings.table(s, d, "events").select("event_id", clipped.alias("clipped"), pred.alias("pred"))


@query("SELECT l_orderkey AS text, array_to_string(list_sort(list_distinct(list(l_shipdate::DATE::VARCHAR || ':' || l_returnflag) FILTER (l_returnflag <> 'N'))), ',') AS spans FROM lineitem GROUP BY l_orderkey")
def span_annotations(s, d):
    rows = bindings.table(s, d, "lineitem").select(F.col("l_orderkey").alias("text"), F.to_date("l_shipdate").cast("string").alias("candidate"), F.when(F.col("l_returnflag") == "N", "NONE").otherwise(F.col("l_returnflag")).alias("label"))
    out = annotation.span_annotations(rows)
    joined_spans = F.array_join(F.transform("spans", lambda x: F.concat(x["candidate"], F.lit(":"), x["label"])), ",")
    return out.select("text", F.when(F.size("spans") > 0, joined_spans).alias("spans"))


@query(
    r"WITH t AS (SELECT conv_id, turn, string_split_regex(lower(text), '\s+') AS w FROM conversations WHERE text IS NOT NULL),"
    " c AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'of' AND w[i + 1] = 'the') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'to') AS b FROM t)"
    " SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS n_tokens, CAST(len(a) AS INTEGER) AS n_profile, CAST(len(b) AS INTEGER) AS n_pii,"
    " CASE WHEN len(a) + len(b) = 0 THEN 'NONE' WHEN 2 * len(a) > len(b) OR (2 * len(a) = len(b) AND a[1] < b[1]) THEN 'PROFILE' ELSE 'PII' END AS vote FROM c"
)
def bio_tags(s, d):
    toks = F.split(F.lower("text"), r"\s+")
    spans = F.array(F.struct(F.split(F.lit("of the"), " ").alias("piece"), F.lit("PROFILE").alias("label")), F.struct(F.split(F.lit("to"), " ").alias("piece"), F.lit("PII").alias("label")))
    rows = bindings.table(s, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", annotation.bio_tags(toks, spans).alias("tags"))
    return rows.select("conv_id", "turn", F.size("tags").alias("n_tokens"), F.size(F.filter("tags", lambda t: t == "B-PROFILE")).alias("n_profile"), F.size(F.filter("tags", lambda t: t == "B-PII")).alias("n_pii"), annotation.entity_vote(F.col("tags"), F.lit(1), F.size("tags")).alias("vote"))


@query(
    r"WITH t AS (SELECT string_split_regex(lower(text), '\s+') AS w FROM conversations WHERE text IS NOT NULL),"
    " c AS (SELECT list_contains(w, 'to') AS has_to, len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0 AS has_of FROM t),"
    " p AS (SELECT 'PII' AS y, CASE WHEN has_to THEN 'PII' ELSE 'NONE' END AS p FROM c UNION ALL SELECT 'PROFILE', CASE WHEN has_of THEN 'PROFILE' ELSE 'NONE' END FROM c UNION ALL SELECT 'NONE', 'NONE' FROM c),"
    " l(x) AS (VALUES ('NONE'), ('PII'), ('PROFILE')) SELECT a.x AS true_label, b.x AS pred_label, CAST((SELECT count(*) FROM p WHERE y = a.x AND p.p = b.x) AS BIGINT) AS n FROM l a, l b"
)
def candidate_confusion(s, d):
    """Annotated candidates of every turn against the votes of predicted tags, of which the later of two counts."""
    turns = bindings.table(s, d, "conversations").where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("text"), F.split(F.lower("text"), r"\s+").alias("tokens"))
    turns = checkpoint(turns)
    given = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(y).alias("label")) for c, y in (("to", "PII"), ("of the", "PROFILE"), ("in", "NONE"))])
    annotated = turns.select("text", F.explode(given).alias("g")).select("text", "g.candidate", "g.label", F.split("g.candidate", " ").alias("piece"))
    tag = lambda w: F.when(w == "to", "B-PII").when(w == "of", "B-PROFILE").otherwise("O")
    first = turns.select("text", "tokens", F.transform("tokens", lambda w: F.lit("B-PII")).alias("tags"), F.lit(1).alias("at"))
    told = first.unionByName(turns.select("text", "tokens", F.transform("tokens", tag).alias("tags"), F.lit(2).alias("at")))
    return commands.candidate_report(annotated, told, ("NONE", "PII", "PROFILE"), "at")[0]


@query()
def tagger_agreement(s, d):
    """The hidden Markov tagger, fitted on four fifths of the clauses as the word lists tag them, against the lists on the others."""
    clauses = checkpoint(bindings.text_clauses(s, d).select(F.concat_ws(":", "uuid", "field", "clause_pos").alias("sentence"), "clause"))
    tagged = clauses.select("sentence", F.posexplode(text.words(F.col("clause"))).alias("place", "token"))
    tagged = checkpoint(tagged.withColumn("pos", text.part_of_speech(F.col("token"))))
    apart = stats.draw(42, F.col("sentence")) < 0.2
    return tagging.agreement(tagged.where(apart), tagging.fit(tagged.where(~apart)))


# ---- commands, sinks and streams from end to end ---------------------------------


@query(sql.BH + "SELECT token, freq_profile, freq_none, round(q, 6) AS q_value, CASE WHEN q <= 0.01 THEN '0.01' WHEN q <= 0.05 THEN '0.05' WHEN q <= 0.10 THEN '0.10' END AS alpha_tier FROM bh WHERE q <= 0.9")
def method_a_command(s, d):
    return commands.method_a(bindings.text_clauses(s, d), 0.9)[1].select("token", "freq_profile", "freq_none", F.round("q_value", 6).alias("q_value"), "alpha_tier")


def _candidates(clauses):
    return checkpoint(_vocabulary(clauses).withColumn("alpha_tier", F.lit("0.05")))


@query(
    sql.PHRASES
    + """, h AS (SELECT phrase, count(*) AS freq, max((uuid, field, clause_pos, token))[4] AS head_token, array_to_string(list_sort(list_distinct(list(token))), '|') AS source_tokens FROM found WHERE phrase <> '' GROUP BY phrase)"""
    + f", tk AS (SELECT list(t) AS ts FROM (SELECT token AS t FROM voc UNION SELECT {sql.lemma('token')} FROM voc))"
    + " SELECT phrase, CAST(freq AS BIGINT) AS freq, head_token, source_tokens, CASE WHEN list_has_any(string_split(phrase, ' '), ts) THEN '0.05' END AS alpha_tier FROM h, tk"
)
def method_b_command(s, d):
    # vocabulary and phrases read no others
    clauses = written(bindings.text_clauses(s, d).where("label = 'PROFILE'"))
    return commands.method_b(clauses, _candidates(clauses)).select("phrase", "freq", "head_token", "source_tokens", "alpha_tier")


@query(
    sql.PHRASES
    + """, ds AS (SELECT uuid, field, clause_pos, list_sort(list_distinct(list(phrase))) AS t FROM found WHERE phrase <> '' GROUP BY uuid, field, clause_pos),
cs AS (SELECT c.uuid, coalesce(t, CAST([] AS VARCHAR[])) AS t FROM cl c LEFT JOIN ds USING (uuid, field, clause_pos) WHERE label = 'PROFILE'), us AS (SELECT uuid, list_sort(list_distinct(flatten(list(t)))) AS t FROM cs GROUP BY uuid)
SELECT 'clause' AS unit, array_to_string(t, '|') AS terms, CAST(count(*) AS BIGINT) AS cnt, round(count(*)::DOUBLE / (SELECT count(*) FROM cs), 9) AS probability FROM cs GROUP BY t
UNION ALL SELECT 'uuid', array_to_string(t, '|'), CAST(count(*) AS BIGINT), round(count(*)::DOUBLE / (SELECT count(*) FROM us), 9) FROM us GROUP BY t"""
)
def cooccurrence_command(s, d):
    clauses = checkpoint(bindings.text_clauses(s, d).where("label = 'PROFILE'"))
    made = commands.cooccurrence(clauses, _candidates(clauses), units=("clause", "uuid"), pairs=False)
    return joined(made.sets).select("unit", "terms", "cnt", F.round("probability", 9).alias("probability"))


_GROWTH = """WITH u AS (SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS o, p_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
st AS (SELECT o, list_sort(list_distinct(list(p_type))) AS t FROM u GROUP BY o), e AS (SELECT o, unnest(t) AS x FROM st),
x AS (SELECT 'terms' AS kind, o, x FROM e UNION ALL SELECT 'sets', o, array_to_string(t, '|') FROM st UNION ALL SELECT 'pairs', a.o, a.x || '|' || b.x FROM e a JOIN e b ON a.o = b.o AND a.x < b.x),
f AS (SELECT kind, x, min(o) AS first FROM x GROUP BY ALL), l AS (SELECT kind, max(o) + 1 AS n FROM x GROUP BY kind),
g AS (SELECT DISTINCT kind, CAST(floor(n * i / 10.0) AS BIGINT) AS n FROM l, range(1, 11) r(i)), pt AS (SELECT g.kind, g.n, count(*) AS seen FROM g JOIN f ON f.kind = g.kind AND first < g.n WHERE g.n > 0 GROUP BY g.kind, g.n)
SELECT kind, round(regr_slope(ln(seen), ln(n)), 6) AS beta, round(exp(regr_intercept(ln(seen), ln(n))), 5) AS k FROM pt GROUP BY kind"""


@query(_GROWTH)
def benchmark_command(s, d):
    """Growth of distinct terms, sets and pairs with the records."""
    detail = checkpoint(bindings.basket_detail(s, d, "p_type"))
    ordinal = ranking.running(detail.select("uuid").distinct(), [F.col("uuid").asc()], {"n": F.lit(1)}).withColumn("n", F.col("n") - 1)
    out = commands.benchmark(detail, 1_000_000, checkpoint(ordinal))
    return out.select("kind", F.round("beta", 6).alias("beta"), F.round("k", 5).alias("k"))


@query(sql.basket("p_type") + sql.set_probability("field"))
def sets_through_csv(s, d):
    """Set probabilities written as CSV in their order and read back."""
    made = cooccurrence.set_probabilities(cooccurrence.unit_sets(bindings.basket_detail(s, d, "p_type"), ("field",)))
    at = new_folder(s, "sets-csv")
    sinks.csv(sinks.ordered_sets(made.select("terms", "set_size", "cnt", F.round("probability", 8).alias("probability"))), at)
    back = readers.csv(s, at, "terms_json string, set_size int, cnt long, probability double")
    return joined(back.withColumn("terms", F.from_json("terms_json", "array<string>"))).select("terms", "set_size", "cnt", "probability")


@query(sql.basket("p_type") + "SELECT uuid, CAST(count(*) AS BIGINT) AS clauses, CAST(sum(len(t)) AS BIGINT) AS terms FROM det GROUP BY uuid")
def detail_through_json(s, d):
    """The detail table appended as JSON lines, in two goes, and read back by its schema."""
    at = new_folder(s, "detail-json")
    made = checkpoint(bindings.basket_detail(s, d, "p_type"))
    for part in (0, 1):
        sinks.append_json(made.where(F.col("clause_pos") % 2 == part), at)
    back = s.read.schema("uuid long, field string, clause_pos long, matched_terms array<string>").json(at)
    return back.groupBy("uuid").agg(F.count("*").alias("clauses"), F.sum(F.size("matched_terms")).alias("terms"))


@query(sql.SCORES + "SELECT provenance, CAST(count(*) AS BIGINT) AS n, CAST(sum(support) AS BIGINT) AS support, CAST(sum(size) AS BIGINT) AS size, CAST(sum(freq) AS BIGINT) AS freq, round(avg(y_risk), 4) AS y_risk FROM scored GROUP BY provenance")
def samples_through_parquet(s, d):
    """Risk samples in their columns and types as Parquet by provenance, and read back."""
    at = new_folder(s, "samples")
    rows = _scored(s, d).withColumn("split", F.lit("train")).withColumn("lds_weight", F.lit(1.0))
    sinks.parquet(sinks.typed(sinks.samples(rows)), at, by=("provenance",))
    back = s.read.parquet(at)
    return back.groupBy("provenance").agg(F.count("*").alias("n"), F.sum("support").alias("support"), F.sum("size").alias("size"), F.sum("freq").alias("freq"), F.round(F.avg(F.col("y_risk").cast("double")), 4).alias("y_risk"))


@query("SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'PII' ELSE 'NONE' END AS label FROM orders")
def label_stream(s, d):
    """Every customer's first order labelled by a stream, once, with keys kept as state."""
    at = new_folder(s, "labelled")
    step = lambda rows: rows.select("o_custkey", F.when(F.col("o_custkey") % 3 == 0, "PII").otherwise("NONE").alias("label"))
    # a pattern, as the table may be one file
    resume.label_stream(s, f"{d}/orders.parque[t]", "o_orderkey long, o_custkey long", ["o_custkey"], step, at, new_folder(s, "labelling")).awaitTermination()
    return s.read.parquet(at).select("o_custkey", "label")
