"""Defaults.  Values marked fixed are part of the data's definition."""

from __future__ import annotations

#: Fixed: narrative fields of a record, in the order in which their clauses count.
TEXT_FIELDS = (
    "professional_persona", "sports_persona", "arts_persona", "travel_persona", "culinary_persona",
    "persona", "cultural_background", "skills_and_expertise", "hobbies_and_interests", "career_goals_and_ambitions",
)
#: Fixed: columns that are never text fields.
NOT_TEXT = (
    "uuid", "id", "index", "row_index", "prompt", "messages", "conversation", "conversations", "source", "lang",
    "language", "country", "region", "created_at", "updated_at",
)
LABELS = ("NONE", "PII", "PROFILE")
TIERS = ("0.01", "0.05", "0.10")
ALPHA = 0.05
#: Fixed: the least words of a clause, and the words beyond which a sentence is split at conjunctions too.
MIN_CLAUSE_WORDS, LONG_SENTENCE_WORDS = 3, 18
#: Fixed: defaults of the phrase commands.
NP_GRAMMAR = "base"
MIN_PHRASE_FREQ, MAX_PHRASE_FREQ = 3, 0
#: Fixed: edges and grids of the diagnostics.
FREQ_EDGES = (1, 3, 10, 30, 100, 300, 1_000, 3_000, 10_000, 30_000, 100_000, 300_000, 1_000_000, 3_000_000, 1_000_000_000)
FREQ_GRID = (500_000, 300_000, 200_000, 100_000, 50_000, 30_000, 20_000, 10_000, 5_000)
SUPPORT1_GRID = (3, 5, 10, 20, 50)
RATE_EDGES = ((50, 101), (30, 50), (20, 30), (10, 20), (5, 10), (1, 5), (0, 1))
RARE_EDGES = ((1, 1), (2, 2), (3, 4), (5, 9), (10, 49), (50, 1_000_000_000))
#: Fixed: words that count as prepositions in the diagnostics.
PREPOSITIONS = ("of", "at", "in", "from", "for", "with", "on", "to", "by", "as", "near", "about", "into", "over", "under")
