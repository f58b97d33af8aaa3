"""Functions on fixed examples, settings, files, and what queries can't show."""

import itertools

import pytest
from pyspark.sql import functions as F

from quillstream.functions import flops, graders, options
from quillstream.functions import verifiers as V
from quillstream.operators import balance, frame, rewards
from quillstream.operators import shaping as S
from quillstream.registry import DISPATCH, REWARD_MANAGERS, load_dataset
from quillstream.sources import files, prepare


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ("Dr. Who came. He left!", ["Dr. Who came.", "He left!"]), ("See a.com now. It costs 3.5 pounds.", ["See a.com now.", "It costs 3.5 pounds."]), ("Wait... what? Yes.", ["Wait...", "what?", "Yes."]),
    ("He has a Ph.D. in it.", ["He has a Ph.D. in it."]), ("In the U.S. It rains.", ["In the U.S.", "It rains."]), ('He said "no." Then left.', ['He said "no".', "Then left."]), ("one\ntwo", ["one two"]), ("", []), ("ab.cd", ["ab.", "cd"]), ("a.b", ["a.b"]),
])
def test_sentences(spark, text, want):
    assert one(spark, V.sentences(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [
    ("Hello, world!", ["Hello", ",", "world", "!"]), ("I can't, won't.", ["I", "ca", "n't", ",", "wo", "n't", "."]), ("It's 3:30 -- really?", ["It", "'s", "3:30", "--", "really", "?"]), ('"Hi" (he said)...', ["``", "Hi", "''", "(", "he", "said", ")", "..."]),
    ("gonna cannot", ["gon", "na", "can", "not"]), ("a b. c", ["a", "b.", "c"]), ("", []),
])
def test_word_tokens(spark, text, want):
    assert one(spark, V.treebank(F.lit(text))) == want


@pytest.mark.parametrize("name, args, yes, no", [
    ("keywords:palindrome", {}, ["a noon b", "x yz"], ["Aa", "Madam, hello there"]), ("keywords:start_end", {}, ["The end of the", "a a"], ["word", "the end."]), ("detectable_format:bigram_wrapping", {}, ["<<a b>> c", "<<a b>> <<c d>>", "x"], ["<<a b>> c d", "a b>>"]),
    ("count:count_unique", {}, ["a b c.", "x"], ["a b a", "one. two."]), ("first_word:first_word_sent", {"first_word": "so"}, ["So it is. so be it."], ["So it is. It be."]), ("rephrase:changes_only", {"original_message": "a *x* b"}, ["a *y z* b"], ["a b", "c *x* b"]),
    ("startend:constrained_start", {"starter": "My answer"}, ["x\n  My answer is"], ["x My answer"]), ("rephrase:word_overlap", {"original_paragraph": "a b b", "low": 2, "high": 2}, ["b b", "a b c"], ["a b b", "c"]),
    ("keywords:key_sentences", {"key_sentences": ["One.", "Two."], "num_sentences": 2}, ["One. Two. x"], ["One. x"]), ("count:counting_composition", {"n_sent": 1, "n_words": 3}, ["a b. *** c d. *** e f."], ["a b. *** c d.", "a b. *** *** c d."]),
])
def test_verifiers(spark, name, args, yes, no):
    got = spark.createDataFrame([(t,) for t in yes + no], "t string").select(V.verify(name, "t", **args).alias("v"))
    assert [r["v"] for r in got.collect()] == [True] * len(yes) + [False] * len(no)


def test_final_answers(spark):
    for text, want in (("<think>x</think> <answer>y</answer>", "y"), ("<|assistant|>z<|think|>", "z"), ("<|channel>thought\nx<channel|>y", "y"), ("<|channel>thought x", "<|channel>thought x")):
        assert one(spark, V.final_answer(F.lit(text))) == want
    assert one(spark, V.final_answer(F.lit("no end"), "</think>")) is None


def test_settings():
    assert [options.as_flag(x, True) for x in ("yes", "OFF", 0, None, "?")] == [True, False, False, True, True]
    assert options.band_mode("upper-only") == "no_lower_zero" and options.band_mode(None) == "both"
    with pytest.raises(ValueError):
        options.band_mode("x")
    assert options.resume_point(["/a/step_9", "/a/step_10", "/a/x"]) == "/a/step_10" and options.resume_point([]) is None
    assert options.common_multiple([4, 6]) == 12 and options.plain({"a": (1, float("nan"), b"\x01")}) == {"a": [1, None, "01"]}


def test_model_of_a_configuration():
    dense = {"hidden_size": 8, "num_hidden_layers": 2, "num_attention_heads": 2, "vocab_size": 10, "intermediate_size": 16}
    assert flops.model_of(dense) == flops.model_of({"text_config": dense}) == flops.Model.of(2, 8, 2, 2, 4, 16, 10)
    mixture = dense | {"num_experts": 8, "num_experts_per_tok": 2, "moe_intermediate_size": 4, "layer_types": ["sliding_attention", "full_attention"], "sliding_window": 5}
    assert flops.model_of(mixture) == flops.Model.of(2, 8, 2, 2, 4, 8, 10, 1, 5)
    for bad in (dense | {"hidden_size": 0}, dense | {"num_attention_heads": 3}, mixture | {"num_experts_per_tok": 9}):
        with pytest.raises(ValueError):
            flops.model_of(bad)


def test_differencing_is_near_the_best():
    for seed in range(6):
        w = [(seed * 7 + i * i * 13) % 40 + 1 for i in range(8)]
        best = min(max(sum(w[i] for i in range(8) if pick[i] == p) for p in (0, 1)) for pick in itertools.product((0, 1), repeat=8))
        parts = balance.differencing(w, 2)
        assert sorted(i for p in parts for i in p) == list(range(8))
        assert max(sum(w[i] for i in p) for p in parts) <= 1.2 * best
        assert [len(p) for p in balance.differencing(w, 4, True)] == [2] * 4


def test_clipped_modes(spark):
    df = spark.createDataFrame([(1, [1, 1]), (2, [1, 1])], "id int, response_mask array<int>")
    with pytest.raises(ValueError):
        S.clipped_batch(df, "drop", 2)
    with pytest.raises(ValueError):
        S.clipped_batch(df, "cut", 2)
    assert S.clipped_batch(df, "use", 2).count() == 2 and S.clipped_batch(df.limit(0), "drop", 2).count() == 0


def test_reward_functions(spark, tmp_path):
    (tmp_path / "r.py").write_text("from pyspark.sql import functions as F\ndef f(text, truth, extra, bonus=0.0):\n    return F.length(text) + F.lit(bonus)\n")
    df = spark.createDataFrame([("abc", "x", 2), (None, "x", 0)], "response_text string, ground_truth string, response_length int")
    got = REWARD_MANAGERS.get("prime")(df, rewards.custom(str(tmp_path / "r.py"), "f", bonus=0.5)).collect()
    assert [(r["reward_score"], r["token_level_scores"]) for r in got] == [(3.5, [0.0, 3.5]), (0.0, [])]
    with pytest.raises(Exception, match="no reward for"):
        rewards.naive(df.withColumn("data_source", F.lit("z")), rewards.by_source({"a": "exact"})).collect()
    assert {"naive", "batch", "dapo", "prime", "gdpo", "remote", "limited"} <= set(REWARD_MANAGERS.names())


def test_dispatch_and_datasets(spark, tmp_path):
    assert DISPATCH.get("dp")(spark.range(10), 3).count() == 10
    (tmp_path / "d.py").write_text("def good(spark, *paths):\n    return spark.range(len(paths))\ndef bad(spark, *paths):\n    return 1\n")
    assert load_dataset(str(tmp_path / "d.py"), "good", spark, "a", "b").count() == 2
    with pytest.raises(TypeError):
        load_dataset(str(tmp_path / "d.py"), "bad", spark)


def test_files(spark, tmp_path):
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.txt").write_text("hello")
    assert files.same_tree(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    (tmp_path / "b" / "x.txt").write_text("jello")
    assert not files.same_tree(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    with pytest.raises(FileNotFoundError):
        files.publication([("a", "r/a")], set())
    with pytest.raises(ValueError):
        files.publication([("a", "r/./a"), ("b", "r/a")], {"a", "b"})
    out = str(tmp_path / "s")
    for step in (3, 12):
        files.append_samples(spark.range(20).withColumnRenamed("id", "row_id"), out, step, 5)
        spark.range(1).write.parquet(f"{tmp_path}/t/step={step}")
    assert spark.read.parquet(out).groupBy("step").count().count() == 2
    assert files.last_step(spark, f"{tmp_path}/t") == 12 and files.last_step(spark, f"{tmp_path}/t", 5) == 3 and files.last_step(spark, f"{tmp_path}/none") is None
    files.append_line(spark.range(1), f"{tmp_path}/l", 4)
    assert spark.read.json(f"{tmp_path}/l").first()["step"] == 4
    prepare.write_split(spark.range(30), f"{tmp_path}/p", "id", 7)
    assert spark.read.parquet(f"{tmp_path}/p/val.parquet").count() == 7


@pytest.mark.parametrize("keys", [[0, 5, 10**15, 3, 10**15 + 1], [7], [], list(range(300))])
def test_positions_of_sparse_keys(spark, monkeypatch, keys):
    monkeypatch.setattr(frame, "RANGE_ROWS", 2)
    df = spark.createDataFrame([(k, k % 5) for k in keys], "row_id long, v long")
    got = sorted((r["rn"], r["row_id"], r["to"]) for r in frame.running_sum(frame.with_position(df), "v", out="to").collect())
    total, want = 0, []
    for i, k in enumerate(sorted(keys)):
        total += k % 5
        want.append((i, k, total))
    assert got == want


def test_answers_without_a_marker():
    assert graders.find_answer(None) == (False, "") and graders.find_answer("The answer is 3. So") == (True, "3")


def test_questions_of_letters_without_a_capital(spark, tmp_path):
    """A sharp s stays itself in capitals, as in the SQL."""
    from quillstream.plans.measures import grade_question

    spark.createDataFrame([(1, "Erßie entech erein"), (2, "the cat sat"), (3, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {tuple(r) for r in grade_question(spark, str(tmp_path)).collect()} == {(1, 1.0), (2, 1.0), (3, 1.0)}


def test_multiples_beyond_doubles(spark):
    cases = [(10**16 + 1, 10**16 + 8), (10**16, 10**16), (7, 8), (0, 0), (-9, -8), (2**62 - 3, 2**62)]
    df = spark.createDataFrame(cases, "n long, w long")
    assert [r[0] for r in df.select(options.round_up(F.col("n"), 8)).collect()] == [w for _, w in cases]


def test_settings_of_large_ids(spark, tmp_path):
    from quillstream.plans.texts import settings

    n = 10**16 + 3
    spark.createDataFrame([(n, "view")], "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    row = settings(spark, str(tmp_path)).first()
    assert row["rounded"] == n + 5 and row["logp"] == -0.5 * (n % 14)


def test_few_word_rules_are_enough_for_plain_sentences(spark):
    import random

    from pyspark.sql import types as T

    assert len(V.PLAIN_RULES) == 4
    rng = random.Random(7)
    bits = ["a", "B", "cannot", "Gonna", "it's", "x,y", "1,000", "3.5", ":", ", ", ". ", "?", "!", "--", "-", "..", '"', "``", "'", "(", "]", "»", "\n", "\t", "\u00a0", "\r\n", "ß", " ", " ", " ", "."]
    texts = ["", " ", ".", "a.", "a. \n", "a,", "a:\n", "x.\u2028"] + ["".join(rng.choice(bits[:1] * 4 + bits) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], T.StructType([T.StructField("t", T.StringType())]))
    whole = F.filter(F.split(V.apply_rules(F.col("t"), V.WORD_RULES), " "), lambda w: w != "")
    assert df.where(~V.treebank(F.col("t")).eqNullSafe(whole)).select("t").take(5) == []
