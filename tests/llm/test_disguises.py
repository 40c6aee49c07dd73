"""Every disguise that the lattice can read reaches it."""

import random

import numpy as np
import pytest

from veilsight.llm import toxicity

WORDS = "idiot stupid moron loser worthless cow the and of river stone will need der und"


@pytest.fixture(scope="module")
def model():
    return toxicity.CharModel(np.bincount(toxicity.count_trigrams(" ".join([WORDS] * 50)), minlength=toxicity.SYMBOLS**3))


@pytest.mark.parametrize(
    ("seen", "word"),
    [
        ("iidiot", "idiot"), ("stuppiid", "stupid"), ("stuuupid", "stupid"), ("Looser", "loser"), ("1d10t", "idiot"), ("st*pid", "stupid"),
        ("c o w", "cow"), ("c-o-w", "cow"), ("c 0 w", "cow"), ("1 d 1 0 t", "idiot"), ("w o r t h l e s s", "worthless"),
        ("lоsеr", "loser"), ("ídíöt", "idiot"), ("mоroon", "moron"), ("ｌｏｓｅｒ", "loser"),
    ],
)
def test_disguised_words_are_restored(model, seen, word):
    assert word in toxicity.Restorer(model).words(f"der {seen} und")[1], seen


def test_words_that_stand_as_they_are_stay(model):
    assert toxicity.Restorer(model).words("the worthless need, will of stone") == ({"the", "worthless", "need", "will", "of", "stone"}, set())


def test_words_of_another_script_stay():
    text = "мама мыла раму окно село море река"
    other = toxicity.CharModel(np.bincount(toxicity.count_trigrams(" ".join([WORDS, text] * 50)), minlength=toxicity.SYMBOLS**3))
    assert toxicity.Restorer(other).words(text)[1] == set()
    assert "loser" in toxicity.Restorer(other).words("lоsеr")[1]


def test_spaced_finds_what_its_pattern_finds(model):
    rnd, read, found = random.Random(3), toxicity.Restorer(model), 0
    for _ in range(30_000):
        text = "".join(rnd.choice("ab1é!$| ..-*~/_  \n“о ,") for _ in range(rnd.randint(1, 14)))
        want = {m.group(0) for m in toxicity.SPACED.finditer(text)}
        found += bool(want)
        assert read.spaced(text) == want, text
    assert found > 500
