"""Sentences by a model learned from the corpus."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstream.functions import verifiers as V
from quillstream.operators import sentence_model as N

#: A corpus in which approx., vol. and e.g. are abbreviations, No. 7 goes on, and The starts sentences.
SENTENCES = ["The tower is approx. 300 metres high.", "See vol. 3 of it, e.g. the end.", "We met in Rome.", "The water was cold!", "They left at 5.", "The book is vol. 2 of many.", "Is it red?", "In Rome the sun is approx. above us.", "The end of it was red.", "On 3. June it rained.", "The sun was cold.", "So many of us are high.", "It rained on us for many a high day.", "See 5 of them in June."]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(" ".join(rng.sample(SENTENCES, len(SENTENCES))),) for _ in range(60)], "text string")
    return N.SentenceModel.of(N.train(df))


def test_what_is_learned(model):
    assert {"approx", "vol", "e.g"} <= model.abbreviations and not model.abbreviations & {"rome", "red", "high", "end", "many"}
    assert ("##number##", "june") in model.collocations and "the" in model.starters


@pytest.mark.parametrize("text, want", [
    (" ".join(SENTENCES), SENTENCES), ("It is approx. 5 and vol. 7. They left.", ["It is approx. 5 and vol. 7.", "They left."]), ("He said so (it was red.) They left.", ["He said so (it was red.)", "They left."]),
    ("J. Smith came. He left", ["J. Smith came.", "He left"]), ("Wait... what? Yes.", ["Wait... what?", "Yes."]), ("Wait... They left.", ["Wait...", "They left."]), ("It is approx. The end.", ["It is approx.", "The end."]), ("", []), (" \n ", []), ("one", ["one"]), ("3. is odd", ["3. is odd"]),
])
def test_texts_are_split(spark, model, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(model.split(F.col("t")), model.count(F.col("t"))).first()
    assert row[0] == want and row[1] == len(want)


def test_checkers_use_the_model(spark, model):
    rows = [("It is approx. 300. They left.",), ("One. Two. They left.",), (None,), ("a b *** c d *** vol. 3",), ("a b *** c d",)]
    df = spark.createDataFrame(rows, "t string")
    two = V.verify("length_constraints:number_sentences", "t", num_sentences=3, relation="less than", model=model)
    assert [r[0] for r in df.select(two).collect()] == [True, False, False, True, True]
    composed = V.verify("count:counting_composition", "t", n_sent=1, n_words=2, model=model)
    assert [r[0] for r in df.select(composed).collect()] == [False, False, False, True, False]


def ratio(a, b, ab, n):
    log = lambda k, p: k * math.log(p) if k > 0 else 0.0
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    side = lambda x, y: log(ab, x) + log(a - ab, 1 - x) + log(b - ab, y) + log(n - a - b + ab, 1 - y)
    return -2 * (side(p, p) - side(p1, p2)) if ab * n > a * b else 0.0


def test_likelihoods(spark):
    cases = [(10, 20, 5, 1000), (10, 20, 10, 1000), (10, 10, 10, 1000), (100, 100, 1, 1000), (3, 5, 0, 9)]
    df = spark.createDataFrame(cases, "a int, b int, ab int, n int")
    got = [r[0] for r in df.select(N.likelihood(*map(F.col, ("a", "b", "ab", "n")))).collect()]
    assert got == pytest.approx([ratio(*c) for c in cases])


def test_counts_of_a_small_corpus(spark):
    df = spark.createDataFrame([("a b. A, (b.) 3. 4 c... b!",), (None,), ("",)], "text string")
    got = {r["type"]: (r["with_period"], r["n"]) for r in N.type_counts(N.word_pairs(df)).collect()}
    assert got == {"a": (0, 2), "b": (2, 3), "##number##": (1, 2), "c": (0, 1)}
    assert Counter(r["kind"] for r in N.train(df.where("text = ''")).collect()) == {}


def test_words_are_counted_as_written(spark, model):
    """Each spelling is looked into once, and only words with a mark before another word are paired."""
    df = spark.createDataFrame([("a b. A b. A\n(b.) \t 3. 4 c... b!",), ("b. A " + "x" * 300_000,), (None,), (" ",)], "text string")
    assert {(r["core"], r["type"], r["n"]) for r in N.word_counts(df.where("length(text) < 99")).collect()} >= {("b.", "b", 2), ("A", "a", 2), ("b.", "b", 1)}
    marked = {(r["core"], r["type"], r["next"]): r["n"] for r in N.word_pairs(df, marked=True).collect()}
    assert marked == {("b.", "b", "a"): 3, ("b.", "b", "##number##"): 1, ("3.", "##number##", "##number##"): 1, ("c...", "c", "b"): 1}
    both = df.select(model.count(F.col("text")), F.size(model.split(F.col("text")))).collect()
    assert [r[0] for r in both] == [4, 2, None, 0] and [r[1] for r in both] == [4, 2, None, 0]


def test_nothing_learned_is_dropped(spark, model, monkeypatch):
    """However few members are told to tasks, all that is learned counts: the rest meets texts by joins."""
    monkeypatch.setattr(N, "MOST", 1, raising=False)
    monkeypatch.setattr(N, "TOLD", 1, raising=False)
    rng = random.Random(0)
    learned = N.train(spark.createDataFrame([(" ".join(rng.sample(SENTENCES, len(SENTENCES))),) for _ in range(60)], "text string"))
    assert learned.count() > 3 and N.SentenceModel.of(learned) == model
    odd = ["It is approx. 300. They left.", "It is approx. 300. They left.", "J. Smith... came? He (left.) On 3. June. 'So", "Wait... what? Yes.", "\n", "", None, "3. is Ⓐ. Ⓐ so", "approx. The. the. Ⓐ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*SENTENCES, " ".join(SENTENCES), *odd])], "i int, text string")
    joined, counted = N.counting(df, learned)
    assert isinstance(counted, N.Counted) and joined.columns[:2] == df.columns
    eight = V.verify("length_constraints:number_sentences", "text", num_sentences=8, relation="at least", model=counted)
    ours = {r[0]: r[1:] for r in joined.select("i", counted.count(F.col("text")), eight).collect()}
    told = {r[0]: r[1] for r in df.select("i", model.count(F.col("text"))).collect()}
    assert {i: n for i, (n, _) in ours.items()} == told and ours[len(SENTENCES)] == (len(SENTENCES), True)
