"""The hidden Markov tagger against plain Viterbi, and its accuracy on tagged rows of a known grammar."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from veilsight.functions import text
from veilsight.operators import phrases, tagging, tokens

NOUNS = [f"{a}{b}tion" for a in "bcdfg" for b in "aeiou"]
VERBS = [f"{a}{b}ize" for a in "klmnp" for b in "aeiou"]
BOTH = ["run", "walk", "call", "plan"]


def sentence(rnd, new=False):
    """Words that are noun or verb by their place: a determiner comes before a noun, a noun before a verb."""
    out = []
    for _ in range(rnd.randint(1, 3)):
        noun = rnd.choice(BOTH) if rnd.random() < 0.4 else (f"{rnd.choice('rstvw')}{rnd.choice('aeiou')}tion" if new else rnd.choice(NOUNS))
        verb = rnd.choice(BOTH) if rnd.random() < 0.4 else (f"{rnd.choice('rstvw')}{rnd.choice('aeiou')}ize" if new else rnd.choice(VERBS))
        out += [("the", "DT"), (noun, "NN"), (verb, "VB")]
    return out


def tagged(spark, n, seed, new=False):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, k, w, p) for i in range(n) for k, (w, p) in enumerate(sentence(rnd, new))], "sentence long, place int, token string, pos string")


def test_words_that_two_tags_share_and_words_never_seen(spark):
    model = tagging.fit(tagged(spark, 400, 1))
    for new in (False, True):
        found = tagging.agreement(tagged(spark, 200, 2, new), model).collect()
        assert {r["pos"] for r in found} == {"DT", "NN", "VB"}
        assert sum(r["right"] for r in found) >= 0.99 * sum(r["n"] for r in found)


def test_decoding_equals_trying_all_paths(spark):
    model = tagging.fit(tagged(spark, 60, 3))
    rnd, texts = random.Random(4), []
    for _ in range(60):
        texts.append([rnd.choice([*BOTH, "the", "bation", "kaize", "odd", "xtion"]) for _ in range(rnd.randint(0, 5))])
    for words, got in zip(texts, model.decode(texts), strict=True):
        score = lambda path, words=words: sum((model.first[path[0]] if k == 0 else model.after[path[k - 1], t]) + model.emission(w)[t] for k, (w, t) in enumerate(zip(words, path, strict=True)))
        if words:
            best = max(score(p) for p in itertools.product(range(len(model.tags)), repeat=len(words)))
            assert np.isclose(score([model.tags.index(t) for t in got]), best)
        else:
            assert got == []


def test_the_tagger_serves_tokens_and_phrases(spark):
    tagger = tagging.MarkovTagger(tagging.fit(tagged(spark, 400, 1)))
    rows = spark.createDataFrame([("PROFILE", "The run walk. The bation run"), ("NONE", None)], "label string, clause string")
    got = tokens.clause_tokens(rows, tagger, lambda token, pos: pos == "NN").collect()
    assert sorted(r["token"] for r in got) == ["bation", "run"]
    found = phrases.matches(rows.withColumn("uuid", F.lit(1)), spark.createDataFrame([("bation",), ("walk",)], "token string"), tagger=tagger).collect()
    assert {(r["token"], r["phrase"]) for r in found} == {("bation", "bation"), ("walk", "walk")}


def test_bounds_of_the_model(spark):
    model = tagging.fit(tagged(spark, 100, 5), max_words=5, ending=2)
    assert len(model.words) == 5 and len(model.endings) <= 5 and model.longest == 2
    assert text.words is not None and model.decode([["the", "bation"]])[0][0] == "DT"
