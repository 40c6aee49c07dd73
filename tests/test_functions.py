import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilsight.functions import stats, text
from veilsight.operators import annotation, cooccurrence, itemsets, phrases, ranking, risk, sampling


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(c.alias("x")).first()["x"]


def test_clauses(spark):
    t = "She is a nurse, and plays chess because it calms. Short. A\nb c d"
    assert one(spark, text.rule_clauses(F.lit(t))) == ["She is a nurse, and plays chess because it calms", "Short", "A", "b c d"]
    long = "one two three four five six seven eight nine ten eleven twelve and thirteen fourteen fifteen sixteen seventeen eighteen nineteen but ONE"
    assert one(spark, text.rule_clauses(F.lit(long)))[1] == "thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    assert one(spark, text.RuleSplitter().split(F.lit("a b c d. x"))) == ["a b c d"]
    assert one(spark, text.RuleSplitter().split(F.lit("x. y"))) == ["x", "y"]
    assert one(spark, text.rule_clauses(F.lit(""))) == []
    assert one(spark, text.MarkSplitter().split(F.lit("甲。乙、、丙"))) == ["甲", "乙", "丙"]


def test_dedupe_keeps_the_first(spark):
    assert one(spark, text.dedupe(F.array(F.lit("B"), F.lit("a"), F.lit("b"), F.lit("A")))) == ["B", "a"]


def test_phrases(spark):
    t = "the senior nurses work at a large school in boston"
    assert one(spark, text.noun_phrases(F.lit(t), "base"))[-1] == "boston"
    assert one(spark, text.noun_phrases(F.lit(t), "chain"))[-1].endswith("large school in boston")
    assert one(spark, text.normalize_phrase(F.lit("The Registered Nurses"))) == "registered nurse"
    assert [one(spark, text.lemma(F.lit(w))) for w in ("cities", "boxes", "classes", "gas", "bus", "dogs", "pies")] == ["city", "box", "class", "gas", "bus", "dog", "pie"]
    assert one(spark, text.longest_phrase(F.array(F.lit("a b"), F.lit("b c d")), F.lit("b"))) == "b c d"
    assert one(spark, text.longest_phrase(F.array(F.lit("a")), F.lit("z"))) == "z"


def test_json_key(spark):
    assert one(spark, text.json_key(F.array(F.lit('a"b'), F.lit("é"), F.lit("c, d")))) == '["a\\"b", "é", "c, d"]'
    assert one(spark, text.json_key(F.array().cast("array<string>"))) == "[]"


@pytest.mark.parametrize(("cells", "p"), [((7, 93, 2, 98), 0.084860138783), ((30, 970, 5, 495), 0.009238293800), ((1, 9, 0, 10), 0.5), ((-1, 1, 1, 1), None)])
def test_fisher(spark, cells, p):
    got = spark.createDataFrame([cells], "a long, b long, c long, d long").select(stats.fisher_greater("a", "b", "c", "d")).first()[0]
    assert got is None if p is None else abs(got - p) < 1e-10


def test_bh(spark):
    p = [0.001, 0.01, 0.01, 0.03, 0.2, 0.2, 0.9, 1.0]
    q = [0.008, 0.08 / 3, 0.08 / 3, 0.06, 1.6 / 6, 1.6 / 6, 1.0, 1.0]
    got = ranking.bh(spark.createDataFrame([(i, x) for i, x in enumerate([*p, None])], "i int, p_value double")).orderBy("i").collect()
    assert got[-1]["q_value"] is None
    assert all(abs(r["q_value"] - w) < 1e-9 for r, w in zip(got, q, strict=False))


def test_running_by_parts_equals_one_task(spark, monkeypatch):
    rows = [(i, random.Random(i).random()) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v double").repartition(4)
    call = lambda: {r["i"]: (r["s"], r["m"]) for r in ranking.running(df, [F.col("i").asc()], {"s": F.lit(1)}, {"m": F.col("v")}).collect()}
    whole = call()
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 10)
    assert call() == whole
    assert whole[499][0] == 500


def test_take_lowest(spark):
    df = spark.createDataFrame([(i % 3, float(i + 1)) for i in range(300)], "s int, r double")
    caps = spark.createDataFrame([("0", 7), ("1", None), ("2", 500)], "s string, cap long")
    got = ranking.take_lowest(df, "r", caps, F.col("s")).groupBy("s").agg(F.count("*").alias("n"), F.max("r").alias("m")).orderBy("s").collect()
    assert [(r["n"], r["m"]) for r in got] == [(7, 19.0), (100, 299.0), (100, 300.0)]
    assert ranking.take_lowest(df, "r", 5).count() == 5


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=20))
def test_md5_split_agrees_with_python(spark, key):
    assert one(spark, stats.mod_1000_of_md5(F.lit("42:" + key))) == int(hashlib.md5(("42:" + key).encode("utf-8", "ignore")).hexdigest(), 16) % 1000


def test_split_examples(spark):
    assert one(spark, stats.mod_1000_of_md5(F.lit("42:abc"))) == 384
    assert one(spark, stats.mod_1000_of_md5(F.lit("42:zz top"))) == 451


DETAIL = [("r1", "f", 0, ["a", "b"]), ("r1", "f", 1, ["a", "b"]), ("r2", "f", 0, ["a"]), ("r3", "f", 0, [])]


def test_sets_and_records(spark):
    d = spark.createDataFrame(DETAIL, "uuid string, field string, clause_pos int, matched_terms array<string>")
    probs = {tuple(r["terms"]): (r["cnt"], r["probability"]) for r in cooccurrence.set_probabilities(cooccurrence.unit_sets(d, ("clause",))).collect()}
    assert probs == {("a", "b"): (2, 0.5), ("a",): (1, 0.25), (): (1, 0.25)}
    assert {tuple(r["terms"]): r["record_count"] for r in risk.set_records(d).collect()} == {("a", "b"): 1, ("a",): 1}
    assert {r["term"]: r["record_count"] for r in risk.term_records(d).collect()} == {"a": 2, "b": 1}
    assert risk.risk_meta(d).first().asDict() == {"N": 3, "n_lines": 4, "n_phrase_sets": 2, "n_field_sets": 2, "n_terms": 2}


def test_itemsets_against_all_subsets(spark):
    from itertools import combinations

    rnd = random.Random(5)
    sets = [sorted(rnd.sample("abcdefg", rnd.randint(0, 6))) for _ in range(80)]
    w = itemsets.weighted_sets(spark.createDataFrame([(s,) for s in sets], "terms array<string>"))
    got = {tuple(r["combo"]): r["support_count"] for r in itemsets.frequent_itemsets(w, 9).collect()}
    want = {}
    for k in range(1, 8):
        for c in combinations("abcdefg", k):
            n = sum(set(c) <= set(s) for s in sets)
            if n >= 9:
                want[c] = n
    assert got == want


def test_scores(spark):
    spans = spark.createDataFrame([("t1", "PROFILE", ["a", "b"], '["a", "b"]', 2, 1), ("t2", "PII", ["a"], '["a"]', 1, 1), ("t3", "NONE", [], "[]", 0, 1), ("t4", "PROFILE", [], "[]", 0, 1), ("t5", "PROFILE", ["z"], '["z"]', 1, 1)], "text string, label string, qi array<string>, qi_json string, size int, freq long")
    sets = spark.createDataFrame([(["a", "b"], 4), (["a"], 10)], "terms array<string>, record_count long")
    terms = spark.createDataFrame([("a", "0.05", 10), ("b", "0.01", 5)], "term string, tier string, record_count long")
    got = {r["text"]: r for r in risk.score_spans(spans, sets, terms, spark.createDataFrame([(100,)], "N long")).collect()}
    assert set(got) == {"t1", "t2", "t3", "t5"}
    assert got["t1"]["y_risk"] == got["t1"]["y_combined"] == round(math.log10(25), 6)
    assert got["t1"]["y_bits"] == round(math.log10(10) + math.log10(20), 6)
    assert (got["t3"]["y_risk"], got["t3"]["y_combined"]) == (0.0, 0.0)
    assert (got["t5"]["support"], got["t5"]["min_constituent_df"], got["t5"]["y_combined"]) == (1, 1, 2.0)
    assert (got["t2"]["y_risk"], got["t2"]["y_combined"], got["t2"]["y_bits"]) == (2.0, 2.0, got["t1"]["y_bits"])
    assert got["t1"]["tier_strictest"] == "0.01"


def test_lds_weights_have_mean_one_and_constants_weigh_one(spark):
    df = spark.createDataFrame([(float(x * x % 97),) for x in range(300)], "y_risk double")
    w = [r["lds_weight"] for r in risk.lds_weights(df).collect()]
    assert abs(sum(w) / len(w) - 1) < 1e-9
    assert [r["lds_weight"] for r in risk.lds_weights(spark.createDataFrame([(2.0,), (2.0,)], "y_risk double")).collect()] == [1.0, 1.0]


def test_samples(spark):
    df = spark.range(1000).withColumn("label", F.col("id") % 3).withColumn("w", 1.0 + F.col("id"))
    assert sampling.at_most(df, 10, ["id"]).count() == 10
    assert sampling.weighted(df, 50, "w", ["id"]).select(F.avg("id")).first()[0] > 550
    folds = sampling.k_fold(df, 5, ["id"], "label").groupBy("label", "fold").count().collect()
    assert len(folds) == 15 and max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1
    assert sampling.bin_equal(df, "w", 10, ["id"], 7).count() == 70
    assert 98 <= sampling.stratified(df, "label", 100, ["id"]).count() <= 102


def test_bio(spark):
    df = spark.createDataFrame([(["x", "new", "york", "y", "new"],)], "t array<string>")
    spans = F.array(F.struct(F.array(F.lit("new"), F.lit("york")).alias("piece"), F.lit("PII").alias("label")))
    tags = df.select(annotation.bio_tags(F.col("t"), spans).alias("x"))
    assert tags.first()["x"] == ["O", "B-PII", "I-PII", "O", "O"]
    assert tags.select(annotation.entity_vote(F.col("x"), F.lit(1), F.lit(5))).first()[0] == "PII"


def test_heaps_falls_back_to_a_line(spark):
    got = phrases.heaps(spark.createDataFrame([(10, 5)], "n long, seen long"), 100).first()
    assert got["beta"] is None and got["estimate"] == 50.0
