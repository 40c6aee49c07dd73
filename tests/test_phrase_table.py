"""The phrase table: postings are the rows of `matches`, texts are read once, counts and examples are whole."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilsight.functions import text
from veilsight.operators import phrases, tokens
from veilsight.plans import commands

WORDS = ["the", "a", "senior", "nurse", "nurses", "of", "hospital", "parties", "boxes", "classes", "dies", "useful", "musical", "and", "is", "Very", "bus", "éclair", "axes", "table", "tables", "in", "with", "x", "s", "King", "İs"]
VOCABULARY = ["nurse", "nurses", "of", "the", "useful", "table", "parties", "is", "clair", "dies", "king", "absent", "", None]


def made(rnd, most):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", ".", "'s"]) for _ in range(rnd.randint(0, most)))


def test_tags_and_lemmas_of_one_word(spark):
    rnd = random.Random(2)
    words = [*text.STOPWORDS, *text.PREPOSITION_TAGS, *text.DETERMINERS] + ["".join(rnd.choice("aeisuxzchlb") for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "s", "es", "ies", *text.ADJECTIVE_ENDS]) for _ in range(3000)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.tag(F.col("w")).alias("t"), text.lemma(F.col("w")).alias("l")).collect()
    assert [(r["t"], r["l"]) for r in rows] == [(text.tag_of(r["w"]), text.lemma_of(r["w"])) for r in rows]


@pytest.mark.parametrize("grammar", ["base", "pp1", "chain"])
@pytest.mark.parametrize("most", [2_000_000, 0])
def test_postings_are_the_rows_of_matches(spark, monkeypatch, grammar, most):
    rnd = random.Random(5)
    rows = spark.createDataFrame([(i, made(rnd, 14)) for i in range(300)] + [(300, ""), (301, " , "), (302, None)], "uuid long, clause string")
    vocabulary = spark.createDataFrame([(w,) for w in VOCABULARY], "token string")
    want = Counter(map(tuple, phrases.matches(rows, vocabulary, grammar).select("uuid", "clause", "phrase", "token").collect()))
    monkeypatch.setattr(phrases, "BROADCAST_WORDS", most)
    got = phrases.postings(rows, vocabulary, grammar)
    assert got.columns == ["uuid", "clause", "phrase", "tokens"]
    assert Counter((r["uuid"], r["clause"], r["phrase"], w) for r in got.collect() for w in r["tokens"]) == want


def test_tokens_of_one_hash_are_told_apart():
    known = phrases.Known(pa.array(["a", "b", "c"]))
    known.hashes[:] = hash("b")
    assert known.has(["a", "b", "d"]) == [False, True, False] and phrases.Known(pa.array([], pa.string())).has(["a"]) == [False]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_the_table_counts_all_and_reads_texts_once(spark, monkeypatch, most):
    rnd = random.Random(7)
    texts = [made(rnd, 6) for _ in range(60)] + [None, "The nurse", "the nurse", "nurses", "the Nurse, the nurse"]
    # texts that stand many times, places that stand twice, labels that do not count
    rows = [(rnd.randint(0, 40), rnd.choice(["f", "g", None]), rnd.randint(0, 2), rnd.choice(texts), rnd.choice(["PROFILE", "PROFILE", "NONE"])) for _ in range(500)]
    clauses = spark.createDataFrame(rows, "uuid long, field string, clause_pos int, clause string, label string")
    candidates = spark.createDataFrame([(w, t) for w, t in zip(VOCABULARY, ["0.05", "0.01", None, "0.10"] * 4, strict=False)], "token string, alpha_tier string")
    found = phrases.matches(clauses.where("label = 'PROFILE'"), candidates).collect()
    monkeypatch.setattr(phrases, "BROADCAST_WORDS", most)
    table = commands.method_b(clauses, candidates)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "[DIJNO]" not in plan and "[a-z]" not in plan
    # as in Spark, null comes first
    place = lambda r: (r["uuid"], r["field"] is not None, r["field"] or "", r["clause_pos"])
    tiers = {}
    for w, t in zip(VOCABULARY, ["0.05", "0.01", None, "0.10"] * 4, strict=False):
        for x in {w, text.lemma_of(w)} if w and t else ():
            tiers[x] = min(t, tiers.get(x, t))
    want = {}
    for p in {r["phrase"] for r in found}:
        own = [r for r in found if r["phrase"] == p]
        first = {}
        for r in own:
            first[r["clause"]] = min(place(r), first.get(r["clause"], place(r)))
        head = max((place(r), r["token"]) for r in own)[1]
        tier = min([tiers[w] for w in p.split(" ") if w in tiers], default=None)
        want[p] = (head, tier, "|".join(sorted({r["token"] for r in own})), len(own)), first
    got = table.collect()
    assert [(r["freq"], r["phrase"]) for r in got] == sorted([(r["freq"], r["phrase"]) for r in got], key=lambda x: (-x[0], x[1]))
    assert {r["phrase"]: (r["head_token"], r["alpha_tier"], r["source_tokens"], r["freq"]) for r in got} == {p: w for p, (w, _) in want.items()}
    for r in got:
        first = want[r["phrase"]][1]
        examples = [e for i in (1, 2, 3) if (e := r[f"example_clause_{i}"]) is not None]
        # texts at one place may come in any order
        assert [first[e] for e in examples] == sorted(first.values())[:3] and len(set(examples)) == len(examples)


def test_words_counted_by_batch_are_the_tokens_of_clauses(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["PROFILE", "NONE", "PII", None]), made(rnd, 12) + rnd.choice(["", "\n", "nu"])) for _ in range(400)] + [("PROFILE", None), ("NONE", ""), ("PROFILE", "nurse")]
    clauses = spark.createDataFrame(rows, "label string, clause string")
    want = Counter(map(tuple, tokens.token_counts(tokens.clause_tokens(clauses)).collect()))
    assert Counter(map(tuple, tokens.default_counts(clauses).collect())) == want and len(want) > 5
    assert tokens.default_counts(clauses.limit(0)).collect() == []
    # in as many rows as memory asks for
    batch = pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows]), pa.array([None if t is None else t.lower() for _, t in rows])], ["label", "clause"])
    slices = [batch.slice(i, 50) for i in range(0, len(rows), 50)]
    once, several = ([(r["label"], r["token"], r["n"]) for b in tokens._words_counted(iter(slices), most) for r in b.to_pylist()] for most in (1000, 3))
    summed = Counter()
    for label, token, n in several:
        summed[label, token] += n
    assert summed == {(label, token): n for label, token, n in once} and len(several) > len(once)


@pytest.mark.parametrize("word_boundary", [False, True])
def test_conjunctions_are_those_of_a_pattern_in_any_case(word_boundary):
    rnd = random.Random(9)
    bits = ["and ", "AND\t", "But  ", "whİle ", "WhIle ", "however, ", "sand ", ", because ", "K", "İ", "ı", "ß", "Whereas ", "x y ", "although ", "Though ", "Σ ", " "]
    apart = r"(?:(?<=\s)|(?<=\s,))" if word_boundary else ""
    pattern = re.compile(rf"(?ai){apart}(?:and|but|while|although|though|whereas|however|because|since|when|after|before)\s+")
    for _ in range(3000):
        s = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
        assert text._at_conjunctions(s, word_boundary) == pattern.split(s)
