"""Injected taggers, the text grain, candidate labels, and paths that only large tables take."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilsight.functions import text
from veilsight.operators import annotation, cooccurrence, phrases, ranking, sampling, tokens
from veilsight.session import counted


def tagger():
    # a function of a function goes to the workers by value
    return text.PartnerMorphemes(lambda t: [(w.strip("."), "NN" if w[0].isupper() else "VB") for w in t.split()])


def test_a_partners_tagger_takes_the_default_ones_place(spark):
    rows = spark.createDataFrame([("PROFILE", "Alice teaches Maths"), ("NONE", "It rains"), ("PII", "Bob Bob")], "label string, clause string")
    noun = lambda token, pos: pos == "NN"
    got = tokens.clause_tokens(rows, tagger(), noun).collect()
    assert Counter((r["label"], r["token"]) for r in got) == Counter([("PROFILE", "Alice"), ("PROFILE", "Maths"), ("NONE", "It")])
    same = tokens.clause_tokens(rows, text.morphemes)
    assert sorted(same.collect()) == sorted(tokens.clause_tokens(rows).collect())
    phrase = rows.select(text.noun_phrases(F.col("clause"), tagger=tagger()).alias("p")).first()["p"]
    assert phrase == ["alice", "maths"]


def test_profile_counts_are_augmented_from_lists(spark):
    counts = spark.createDataFrame([("nurse", "NN", 2, 1)], "token string, pos string, freq_profile long, freq_none long")
    totals = spark.createDataFrame([(2, 1)], "n_profile long, n_none long")
    rows = spark.createDataFrame([(["nurse school", None], "teacher"), (None, None)], "hobbies array<string>, job string")
    out, sums = tokens.augment_profile(counts, totals, rows, ("hobbies", "job"))
    assert {r["token"]: (r["freq_profile"], r["freq_none"]) for r in out.collect()} == {"nurse": (3, 1), "school": (1, 0), "teacher": (1, 0)}
    assert tuple(sums.first()) == (1, 5) or sums.first().asDict() == {"n_profile": 5, "n_none": 1}


def test_token_statistics_come_surest_first(spark):
    rows = spark.createDataFrame([("a", 0.2, 0.1), ("b", 0.1, 0.3), ("c", None, None), ("d", 0.1, 0.2)], "token string, q_value double, p_value double")
    assert [r["token"] for r in tokens.in_order(rows).collect()] == ["d", "b", "a", "c"]


def test_text_grain(spark):
    rows = [(1, "f", 0, "t1", ["a"]), (1, "f", 1, "t1", ["b"]), (1, "f", 2, "t2", ["a"]), (2, "g", 0, "t1", [])]
    detail = spark.createDataFrame(rows, "uuid long, field string, clause_pos int, text string, matched_terms array<string>")
    got = cooccurrence.unit_sets(detail, ("text", "field")).collect()
    assert Counter((r["unit"], tuple(r["terms"])) for r in got) == Counter([("text", ("a", "b")), ("text", ("a",)), ("text", ()), ("field", ("a", "b")), ("field", ())])


def test_candidate_labels(spark):
    said = spark.createDataFrame([("t", "x y", "QPII", ["x", "y"]), ("t", "z", "NONE", ["z"]), ("t", "q", "PII", ["q"]), ("u", "x", "PII", ["x"])], "text string, candidate string, label string, piece array<string>")
    told = spark.createDataFrame([("t", ["x", "y", "z", "x", "y"], ["B-QPII", "I-QPII", "O", "B-PII", "O"])], "text string, tokens array<string>, tags array<string>")
    got = {r["candidate"]: (r["y_true"], r["y_pred"]) for r in annotation.candidate_labels(said, told).collect()}
    assert got == {"x y": ("QPII", "QPII"), "z": ("NONE", "NONE"), "q": ("PII", "NONE")}


def test_counters(spark):
    df, seen = counted(spark.range(10), "progress", even=F.count_if(F.col("id") % 2 == 0))
    df.collect()
    assert seen.get == {"rows": 10, "even": 5}


def test_dedupe_folds_case_in_any_length(spark):
    rnd = random.Random(3)
    words = [rnd.choice(["Straße", "STRASSE", "a", "A", "b", None, "Été", "ÉTÉ"]) for _ in range(50)] + [f"w{i % 3000}" for i in range(20_000)]
    seen, want = set(), []
    for w in words:
        if w is not None and w.casefold() not in seen:
            seen.add(w.casefold())
            want.append(w)
    assert spark.createDataFrame([(words,)], "w array<string>").select(text.dedupe(F.col("w")).alias("d")).first()["d"] == want


@pytest.mark.parametrize("most", [100, 0])
def test_tokens_meet_clauses_whatever_the_vocabulary(spark, most):
    clauses = spark.createDataFrame([(1, "He is A nurse"), (1, "He is A nurse"), (2, "ab"), (3, ""), (4, None)], "uuid int, clause string")
    vocabulary = spark.createDataFrame([("a",), ("is",), ("nurse",), ("nursery",), ("",), (None,), ("ab",)], "token string")
    got = Counter((r["uuid"], r["token"]) for r in phrases.substring_matches(clauses, vocabulary, most).collect())
    assert got == Counter({(1, "a"): 2, (1, "is"): 2, (1, "nurse"): 2, (1, ""): 2, (2, "a"): 1, (2, "ab"): 1, (2, ""): 1, (3, ""): 1})


def test_bins_follow_from_the_rows(spark, monkeypatch):
    df = spark.range(5000).select("id", (F.xxhash64("id") % 1000003 + 2000003).cast("double").alias("r"), (F.col("id") % 3).cast("string").alias("s"))
    for size in (4096, 2):
        monkeypatch.setattr(ranking, "BIN_ROWS", size)
        got = {(r["s"], r["id"]) for r in ranking.take_lowest(df, "r", 100, F.col("s"), ["id"]).collect()}
        rows = df.collect()
        want = {(s, r["id"]) for s in "012" for r in sorted((x for x in rows if x["s"] == s), key=lambda x: (x["r"], x["id"]))[:100]}
        assert got == want
    folds = Counter(r["fold"] for r in sampling.k_fold(df, 5, ["id"]).collect())
    assert set(folds.values()) == {1000}


@pytest.mark.parametrize("part", [2_000_000, 150])
def test_containment_by_windows(spark, part):
    rnd = random.Random(6)
    letters = "abé日 "
    clauses = [(i, "".join(rnd.choice(letters + "ABÉ") for _ in range(rnd.randint(0, 200)))) for i in range(300)] + [(500, None), (501, ""), (502, "ab" * 5000)]
    long = {c[k : k + n] for n in (30, 64, 65, 90) for k in (0, 3, 60) for _, c in clauses[:60] if c and len(c.lower()[k : k + n]) == n}
    vocabulary = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(0, 7))) for _ in range(400)} | {t.lower() for t in long} | {"ab" * 40, "ab" * 40 + "é"})
    given = spark.createDataFrame([(t,) for t in vocabulary], "token string")
    found = phrases.substring_matches(spark.createDataFrame(clauses, "uuid long, clause string"), given, 10, part)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert Counter(map(tuple, found.select("uuid", "token").collect())) == Counter((i, t) for i, c in clauses if c is not None for t in vocabulary if t in c.lower())
