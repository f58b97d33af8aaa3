"""Languages by naive Bayes over hashed letter n-grams."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.functions import verifiers as V
from quillstream.operators import language_model as L

TRAIN = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs to the river with all of its friends", "fr": "le renard brun saute par dessus le chien paresseux et puis il court vers la rivière avec ses amis",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann läuft er mit seinen freunden zum fluss", "ru": "быстрая коричневая лиса прыгает через ленивую собаку и потом бежит к реке",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, v) for k, v in TRAIN.items()] * 3 + [(None, "x y z"), ("en", None), ("fr", "")]
    return L.LanguageModel.of(L.profiles(spark.createDataFrame(rows, "lang string, text string")))


@pytest.mark.parametrize("text, want", [
    ("the river is over there with the dog", "en"), ("THE RIVER IS OVER THERE WITH THE DOG", "en"), ("le chien est dans la rivière avec le renard", "fr"), ("der hund ist mit dem fuchs über den fluss", "de"), ("собака бежит к реке", "ru"), ("", None), (None, None), ("123 ... !", None), ("the", "en"),
])
def test_guesses(model, text, want):
    assert model.guess([text]) == [want] and model.guess(["x", text, "der hund"])[1] == want


def test_ngrams_do_not_cross_texts_or_gaps():
    alone = [Counter(L.grams([t])[0].tolist()) for t in ("Ab c", "abc", "")]
    bucket, of = L.grams(["Ab c", "abc", ""])
    assert [Counter(bucket[of == k].tolist()) for k in range(3)] == alone
    assert Counter(L.grams(["AB  - C"])[0].tolist()) == alone[0]
    assert sum(alone[1].values()) == 3 + 4 + 3 and sum(alone[2].values()) == 0  # a b c, _a ab bc c_, _ab abc bc_
    assert sum(alone[0].values()) == 3 + 5 + 3  # a b c, _a ab b_ _c c_, _ab ab_ _c_


def test_counts_are_those_of_all_texts(spark):
    rows = [(k, v) for k, v in TRAIN.items() for _ in range(50)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    got = {(r["lang"], r["bucket"]): r["n"] for r in L.gram_counts(df).collect()}
    want = {(k, b): 50 * n for k, v in TRAIN.items() for b, n in Counter(L.grams([v])[0].tolist()).items()}
    assert got == want
    weights = {r["lang"]: np.array(r["weights"]) for r in L.profiles(df).collect()}
    for k in TRAIN:
        n = np.array([want.get((k, b), 0) for b in range(L.BUCKETS)])
        assert np.allclose(weights[k], np.log((n + L.SMOOTHING) / (n.sum() + L.SMOOTHING * L.BUCKETS)))
    assert L.LanguageModel.of(L.profiles(df.where("false"))).guess(["a"]) == [None]


def test_checkers_use_the_model(spark, model):
    df = spark.createDataFrame([("the dog runs to the river",), ("THE DOG RUNS TO THE RIVER",), ("le chien est dans la rivière",), ("",), (None,)], "t string")
    check = lambda name, **a: [r[0] for r in df.select(V.verify(name, "t", model=model, **a)).collect()]
    assert check("language:response_language", language="en") == [True, True, False, False, False]
    assert check("language:response_language", language="fr") == [False, False, True, False, False]
    assert check("language:response_language", language="xx") == [False] * 5  # unknown
    assert check("change_case:english_capital") == [False, True, False, False, False]
    assert check("change_case:english_lowercase") == [True, False, False, False, False]
    assert df.select(F.lit(1)).count() == 5
