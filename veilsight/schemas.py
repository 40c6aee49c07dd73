"""Schemas of the tables this library reads and writes."""

from __future__ import annotations

CLAUSES = "row_index long, uuid string, field string, clause string, label string, clause_pos int"
SCORED_CLAUSES = CLAUSES + ", score double, probs map<string,double>"
TOKEN_STATS = (
    "token string, pos string, freq_profile long, freq_none long, n_profile long, n_none long, "
    "p_value double, effect_size double, n_tokens long, q_value double, n_tested long"
)
PHRASES = "phrase string, head_token string, alpha_tier string, source_tokens string, freq long, example_clause_1 string, example_clause_2 string, example_clause_3 string"
DETAIL = "row_index long, uuid string, field string, clause_pos int, matched_terms array<string>"
SET_PROBABILITIES = "terms array<string>, tiers array<string>, set_size int, cnt long, probability double, n_tier_001 int, n_tier_005 int, n_tier_010 int"
PAIRS = "phrase_a string, phrase_b string, co_count long, count_a long, count_b long, probability double, pmi double, g2 double, q_value double, tier_a string, tier_b string"
ITEMSETS = "combo array<string>, size int, support_count long, support_pct double"
SET_RECORDS = "terms array<string>, set_size int, record_count long, probability double"
TERM_RECORDS = "term string, tier string, record_count long, probability double"
RISK_META = "N long, n_lines long, n_phrase_sets long, n_field_sets long, n_terms long"
SPANS = "text string, label string, qi array<string>, size int, freq long"
RISK_SAMPLES = (
    "provenance string, text string, qi_json string, size int, support long, N long, y_risk float, y_bits float, y_bits_capped float, "
    "min_constituent_df long, y_combined float, lds_weight float, split string, tier_strictest string, freq long"
)
PREDICTIONS = "y_true double, y_pred double, split string, support long"
