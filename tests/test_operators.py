"""Operators on small rows: groups of one, ties, empty masks, padding, packing, queues."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.functions import algebra
from quillstream.functions import graders as G
from quillstream.functions import masked as M
from quillstream.functions import messages as Y
from quillstream.functions import verifiers as V
from quillstream.operators import advantage as A
from quillstream.operators import balance as P
from quillstream.operators import curation as C
from quillstream.operators import frame as B
from quillstream.operators import losses as L
from quillstream.operators import metrics as X
from quillstream.operators import offpolicy as O
from quillstream.operators import shaping as S
from quillstream.registry import ADVANTAGES, LOSSES, Registry, load_function
from quillstream.streaming import queues as Q

SCHEMA = "row_id long, uid string, token_level_rewards array<double>, response_mask array<int>"


def batch(spark, scores, uids):
    return spark.createDataFrame([(i, u, [s, 0.0], [1, 1]) for i, (s, u) in enumerate(zip(scores, uids))], SCHEMA)


def scalars(df):
    return {r["row_id"]: r["advantages"][0] if r["advantages"] else None for r in df.collect()}


@pytest.fixture
def groups(spark):
    return batch(spark, [3.0, 1.0, 1.0, 5.0, 5.0, 2.0, 7.0], ["one", "same", "same", "tie", "tie", "tie", "tie2"])


def test_single_groups_differ_between_estimators(groups):
    assert scalars(A.rloo(groups))[0] == 3.0
    assert scalars(A.rloo_vectorized(groups))[0] == 0.0
    assert math.isclose(scalars(A.grpo(groups))[0], 3.0 / (1 + 1e-6))
    assert scalars(A.opo(groups))[0] == 3.0


def test_equal_scores_have_no_advantage(groups):
    got = scalars(A.grpo(groups))
    assert got[1] == got[2] == 0.0


def test_leave_one_out(groups):
    got = scalars(A.rloo(groups))
    assert math.isclose(got[3], 5 - (5 + 2) / 2) and math.isclose(got[5], 2 - 5)


def test_passk_ties_go_to_the_earliest(spark):
    got = scalars(A.grpo_passk(batch(spark, [5.0, 5.0, 2.0], ["a"] * 3)))
    assert got == {0: 0.0, 1: 0.0, 2: 0.0}
    got = scalars(A.grpo_passk(batch(spark, [1.0, 4.0, 2.0], ["a"] * 3), norm_by_std=False))
    assert got == {0: 0.0, 1: 2.0, 2: 0.0}


def test_gae_carries_through_masked_steps(spark):
    r, v, m = [1.0, 9.0, 2.0], [0.5, 9.0, 0.25], [1, 0, 1]
    df = spark.createDataFrame([(r, v, m)], "r array<double>, v array<double>, m array<int>")
    last = 2.0 - 0.25
    first = 1.0 + 0.9 * 0.25 - 0.5 + 0.9 * 0.8 * last
    got = df.select(M.gae("r", "v", "m", 0.9, 0.8).alias("a")).first()["a"]
    assert np.allclose(got, [first, last, last])


def test_masked_mean_has_its_epsilon(spark):
    df = spark.createDataFrame([([1.0, 3.0], [1, 1]), ([1.0, float("nan")], [1, 0]), ([], [])], "v array<double>, m array<int>")
    got = [r["x"] for r in df.select(M.masked_mean("v", "m").alias("x")).collect()]
    assert got == [4 / (2 + 1e-8), 1 / (1 + 1e-8), 0.0]


def test_token_baseline_by_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i, n in enumerate([3, 5, 2, 4]):
        rows.append((i, "a" if i < 3 else "b", rng.random(n).tolist(), [1] * n, (-rng.random(n)).tolist(), rng.random(n).tolist()))
    df = spark.createDataFrame(rows, SCHEMA + ", old_log_probs array<double>, sum_pi_squared array<double>")
    got = {r["row_id"]: r["advantages"] for r in A.optimal_token_baseline(df).collect()}
    g = {r[0]: np.cumsum(r[2][::-1])[::-1] for r in rows}
    w = {r[0]: np.cumsum(1 - 2 * np.exp(r[4]) + np.array(r[5])) for r in rows}
    for t in range(5):
        at = [i for i in range(3) if t < len(g[i])]
        base = sum(g[i][t] * w[i][t] for i in at) / (sum(w[i][t] for i in at) + 1e-8)
        for i in at:
            assert math.isclose(got[i][t], 0.0 if t >= 3 else g[i][t] - base, abs_tol=1e-9)
    assert got[3] == [0.0] * 4


@pytest.mark.parametrize("option", O.OPTIONS)
def test_rejection_options_keep_the_shape(spark, option):
    df = spark.createDataFrame([(0, [0.0, -1.0], [0.0, -1.0], [1, 1]), (1, [0.0, -9.0], [-5.0, 0.0], [1, 1]), (2, [], [], [])], "row_id long, old_log_probs array<double>, rollout_log_probs array<double>, response_mask array<int>")
    got = {r["row_id"]: r["response_mask"] for r in O.rejection_mask(df, [option], 1.5).collect()}
    assert got[0] == [1, 1] and got[2] == [] and len(got[1]) == 2
    assert 0 in got[1]


def test_thresholds():
    assert O.is_threshold("0.5_2") == (0.5, 2.0) and O.is_threshold(3) == (None, 3.0)
    assert O.rs_thresholds(["token_k1", "seq_max_k2"], "2,3") == {"token_k1": (0.5, 2.0), "seq_max_k2": (None, 3.0)}
    for bad in (True, "2_1", "0"):
        with pytest.raises((ValueError, TypeError)):
            O.is_threshold(bad)


def test_weights_truncate_or_zero(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], [-3.0, 0.0], [1, 1])], "row_id long, old_log_probs array<double>, rollout_log_probs array<double>, response_mask array<int>")
    assert O.importance_weights(df).first()["is_weights"] == [2.0, 1.0]
    assert O.importance_weights(df, threshold="0.5_2").first()["is_weights"] == [0.0, 1.0]


def test_losses_run_and_unknown_mode_fails(spark):
    rows = [(i, t, (t + i) % 2, -0.1 * t, -0.2, 0.5 - t, -0.3) for i, t in product(range(3), range(4))]
    df = spark.createDataFrame(rows, "row_id long, t long, mask int, logp double, old_logp double, adv double, rollout_logp double")
    for name in LOSSES.names():
        assert math.isfinite(L.agg_loss(LOSSES.get(name)(df)).first()["loss"]), name
    with pytest.raises(ValueError):
        L.agg_loss(df.withColumn("loss", F.lit(1.0)), mode="other")


def test_frame_verbs(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    assert [r["row_id"] for r in B.slice_rows(df, 1, 8, 3).orderBy("row_id").collect()] == [1, 4, 7]
    assert [r["row_id"] for r in B.repeat(df.limit(3), 2).orderBy("pos").collect()] == [0, 0, 1, 1, 2, 2]
    assert [r["row_id"] for r in B.repeat(df.limit(3), 2, False).orderBy("pos").collect()] == [0, 1, 2, 0, 1, 2]
    padded = B.pad_to_divisor(df.limit(3), 8)
    assert [r["row_id"] for r in padded.orderBy("rn").collect()] == [0, 1, 2, 0, 1, 2, 0, 1]
    assert B.unpad(padded).count() == 3
    assert sorted(r["chunk"] for r in B.chunk(df, 4).collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert B.split_equal(df, 3).count() == 9
    with pytest.raises(KeyError):
        B.pop(df, ["missing"])


def test_union_of_columns_checks_shared_ones(spark):
    a = spark.createDataFrame([(1, 2, 3)], "row_id long, x long, y long")
    b = spark.createDataFrame([(1, 2, 4)], "row_id long, x long, z long")
    assert B.union_columns(a, b).first().asDict() == {"row_id": 1, "x": 2, "y": 3, "z": 4}
    with pytest.raises(Exception, match="differs"):
        B.union_columns(a, b.withColumn("x", F.lit(9).cast("long"))).collect()


def test_positions_across_ranges(spark):
    df = spark.createDataFrame([(5,), (70_000,), (70_001,), (200_000,)], "row_id long")
    assert [r["rn"] for r in B.with_position(df).orderBy("row_id").collect()] == [0, 1, 2, 3]


def test_reduce_by_name_prefers_max(spark):
    df = spark.createDataFrame([("minmax_diff", 1.0), ("minmax_diff", 3.0), ("a_min", 1.0), ("a_min", 2.0), ("x", 1.0), ("x", 2.0)], "name string, value double")
    assert {r["name"]: r["value"] for r in X.reduce_by_name(df).collect()} == {"minmax_diff": 3.0, "a_min": 1.0, "x": 1.5}


def test_majority_ties_go_to_the_first_vote(spark):
    df = spark.createDataFrame([("u", "b", 1.0, 0), ("u", "a", 2.0, 1), ("u", "a", 3.0, 2), ("u", "b", 4.0, 3), ("v", "x", 5.0, 0)], "uid string, pred string, value double, pos int")
    assert {r["uid"]: (r["vote"], r["value"]) for r in X.majority(df, ["uid"]).collect()} == {"u": ("b", 1.0), "v": ("x", 5.0)}


@pytest.mark.parametrize("k", [2, 3, 4])
def test_partitions_cover_and_balance(k):
    rng = np.random.default_rng(k)
    w = rng.integers(1, 1000, 24).tolist()
    for f in (P.differencing, P.longest_first, P.lightest_first):
        parts = f(w, k)
        assert sorted(i for p in parts for i in p) == list(range(24)) and all(parts)
    sums = [sum(w[i] for i in p) for p in P.differencing(w, k)]
    assert max(sums) - min(sums) <= max(w)
    assert {len(p) for p in P.differencing(w, k, True)} == {24 // k}


def test_greedy_does_not_sort():
    assert P.lightest_first([1, 1, 10], 2) == [[0, 2], [1]]
    assert P.longest_first([1, 1, 10], 2) == [[2], [0, 1]]


def test_quotas(spark):
    df = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "k string, n long")
    for f in (C.largest_remainder, C.nearest_quota):
        got = {r["k"]: r["quota"] for r in f(df, "k", "n", 7).collect()}
        assert sum(got.values()) == 7 and got["a"] in (3, 4)


def test_loop_detector():
    assert C.is_loop("again " * 60) and not C.is_loop("again " * 10) and not C.is_loop(None)
    assert not C.is_loop(" ".join(f"w{i}" for i in range(60)))


def check(spark, name, text, **k):
    return spark.createDataFrame([(text,)], "t string").select(V.verify(name, "t", **k).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name,text,arguments,expected",
    [
        ("length_constraints:number_words", "été naïve", {"num_words": 2, "relation": "at least"}, True),
        ("length_constraints:number_words", "été naïve", {"num_words": 3, "relation": "at least"}, False),
        ("length_constraints:number_paragraphs", "a *** b", {"num_paragraphs": 2}, True),
        ("length_constraints:number_paragraphs", "*** a *** b ***", {"num_paragraphs": 2}, True),
        ("length_constraints:number_paragraphs", "a *** *** b", {"num_paragraphs": 2}, False),
        ("detectable_format:title", "<<Title>>\ntext", {}, True),
        ("detectable_format:title", "<< >>", {}, False),
        ("detectable_format:json_format", '```json\n{"a": 1}\n```', {}, True),
        ("detectable_format:json_format", "{a", {}, False),
        ("keywords:palindrome", "a cat", {}, True),
        ("keywords:palindrome", "cat dog", {}, False),
        ("detectable_format:number_bullet_lists", "* a\n- b\n** c", {"num_bullets": 2}, True),
        ("combination:two_responses", "one ****** two", {}, True),
        ("combination:two_responses", "one ****** one", {}, False),
        ("startend:quotation", '"x"', {}, True),
        ("startend:quotation", '"', {}, False),
        ("keywords:forbidden_words", "a withered rose", {"forbidden_words": ["with"]}, True),
        ("detectable_format:square_brackets", "[a] [b]", {}, True),
        ("count:count_unique", "a b a", {}, False),
        ("first_word:first_word_sent", "The cat. The dog.", {"first_word": "the"}, True),
        ("last_word:last_word_answer", "so it is done.", {"last_word": "done"}, True),
        ("punctuation:no_comma", None, {}, False),
        ("change_case:english_capital", "THE CAT AND THE DOG", {}, True),
        ("language:response_language", "le chat et la souris", {"language": "fr"}, True),
        ("keywords:start_end", "Yes it is yes", {}, True),
        ("keywords:no_adjacent_consecutive", "apple banana", {}, False),
        ("detectable_format:bigram_wrapping", "<<a b>> <<c d>>", {}, True),
        ("length_constraints:number_sentences", "Dr. Smith came. He left! Why?", {"num_sentences": 3, "relation": "at least"}, True),
    ],
)
def test_verifiers(spark, name, text, arguments, expected):
    assert check(spark, name, text, **arguments) is expected


def test_constraint_score_needs_an_answer(spark):
    df = spark.createDataFrame([("<think>a,b</think> fine",), ("<think>x</think>",), ("a, b",)], "t string")
    got = [r["s"] for r in df.select(V.constraint_score(F.col("t"), [("punctuation:no_comma", {})]).alias("s")).collect()]
    assert got == [1.0, 0.0, 0.0]


def test_hash_answers(spark):
    df = spark.createDataFrame([("#### 3 then #### 1,234", "1234"), ("it is 7", "7"), ("none", "1"), ("#### 5", "6")], "t string, g string")
    got = [(r["a"], r["b"]) for r in df.select(G.grade_hash(F.col("t"), F.col("g"), format_score=0.1).alias("a"), G.grade_hash(F.col("t"), F.col("g"), "flexible").alias("b")).collect()]
    assert got == [(1.0, 1.0 if "1,234" == "1234" else 0.0), (0.0, 1.0), (0.0, 0.0), (0.1, 0.0)]


def test_boxes_and_equality():
    assert G.last_boxed("x \\boxed{1} y \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}"
    assert G.last_boxed("\\boxed{1") is None and G.last_boxed("") is None
    assert algebra.same_answer("1/2", "0.5") and algebra.same_answer("50\\%", "0.5") and algebra.same_answer("(1, 2)", "(1,2.0)") and not algebra.same_answer("1", "2")


def test_tool_similarity():
    a = [{"name": "f", "parameters": {"x": 1}}]
    assert G.tool_similarity(a, a) == 1.0
    assert G.tool_similarity(a, []) < G.tool_similarity(a, [{"name": "f", "parameters": {"x": 2}}]) < 1.0
    assert G.parse_calls("<tool_call>{bad</tool_call>") == []


def test_question_answers_pay_for_many_tags(spark):
    many = "<answer>x</answer>" * 11 + "<answer>The Cat!</answer>"
    df = spark.createDataFrame([("<answer>the cat</answer>",), (many,), ("cat",)], "t string")
    got = [r["s"] for r in df.select(G.grade_question(F.col("t"), F.array(F.lit("a cat"))).alias("s")).collect()]
    assert got == [1.0, 0.25, 0.0]


def test_judge_scores(spark):
    df = spark.createDataFrame([('```json\n{"score": 7}\n```',), ("Score: 8",), ("I say 9",), ("nothing",), ("score: 42",)], "t string")
    assert [r["s"] for r in df.select(G.judge_score(F.col("t")).alias("s")).collect()] == [7.0, 8.0, 9.0, None, None]


def test_case_scores_stop_at_a_compile_error(spark):
    df = spark.createDataFrame([([1, 1],), ([1, 0],), ([1, -4, 1, 1],), ([],)], "s array<int>")
    got = [(r["a"], r["b"]) for r in df.select(G.case_score(F.col("s")).alias("a"), G.case_score(F.col("s"), True).alias("b")).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.5), (0.0, 0.25), (0.0, 0.0)]


def test_messages(spark):
    df = spark.createDataFrame([("do it now please and more", "now please\tabsent")], "t string, c string")
    assert df.select(Y.strip_constraints(F.col("t"), F.col("c")).alias("x")).first()["x"] == "do it"
    text = 'a <tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call> b <tool_call>bad</tool_call>'
    got = spark.createDataFrame([(text,)], "t string").select(Y.json_calls(F.col("t")).alias("x")).first()["x"]
    assert [c["name"] for c in got["calls"]] == ["f"] and got["content"] == "a  b"
    k = spark.createDataFrame([("a_b_2_7",)], "k string").select(Y.turn_key(F.col("k")).alias("x")).first()["x"]
    assert (k["uid"], k["session"], k["turn"]) == ("a_b", "2", 7)
    parts = spark.createDataFrame([("see <image> here",)], "t string").select(Y.content_parts(F.col("t")).alias("x")).first()["x"]
    assert [p["type"] for p in parts] == ["text", "image", "text"]


def test_anchor_bands(spark):
    rows = [(1.0, 9.0, 1, 10.0, 1, 20.0, 1), (1.0, 15.0, 1, 10.0, 1, 20.0, 1), (1.0, 25.0, 1, 10.0, 1, 20.0, 1), (1.0, 15.0, 1, 20.0, 1, 10.0, 1), (1.0, 15.0, 0, 10.0, 1, 20.0, 1), (1.0, float("inf"), 1, 10.0, 1, 20.0, 1)]
    df = spark.createDataFrame(rows, "reward double, policy_nll double, policy_token_count int, ref0_nll double, ref0_token_count int, ref1_nll double, ref1_token_count int")
    got = [(r["state"], r["shaped"]) for r in S.anchor_band(df).collect()]
    assert got == [("below", 0.0), ("inside", 1.1), ("above", 1.0), ("inverted", 1.0), ("missing", 1.0), ("missing", 1.0)]


def test_queue_drops_the_oldest(spark):
    df = spark.createDataFrame([(i, "q") for i in range(5)], "n long, q string")
    got = Q.drop_oldest(df, 3, "n", ["q"]).orderBy("n").collect()
    assert [r["n"] for r in got] == [2, 3, 4] and {r["dropped"] for r in got} == {2}


def test_queue_stream(spark, tmp_path):
    for i, part in enumerate(([("q", "a"), ("q", "b")], [("q", "c"), ("q", "d")])):
        spark.createDataFrame(part, "queue string, sample_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("queue string, sample_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = Q.bounded_queue_stream(stream, 3).writeStream.outputMode("update").format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("SELECT * FROM held ORDER BY produced DESC").first()
    assert last["produced"] == 4 and last["dropped"] == 1 and len(last["held"]) == 3


def test_token_bucket_goes_into_debt(spark):
    df = spark.createDataFrame([("l", 0, 0.0, 1.0), ("l", 1, 0.0, 10.0), ("l", 2, 0.0, 1.0)], "limiter string, request long, arrival double, need double")
    got = [r["start"] for r in Q.token_bucket(df, 1.0, 2.0).orderBy("request").collect()]
    assert got == [0.0, 1.0, 10.0]


def test_registry(tmp_path):
    r = Registry("thing")
    r.register("a")(len)
    r.register("a")(len)
    with pytest.raises(ValueError):
        r.register("a")(max)
    with pytest.raises(KeyError):
        r.get("b")
    (tmp_path / "f.py").write_text("def f(x, k=1):\n    return x + k\n")
    assert load_function(str(tmp_path / "f.py"), "f", k=5)(1) == 6
    assert len(ADVANTAGES.names()) == 14


def test_controllers_of_the_kl_coefficient(spark, monkeypatch):
    monkeypatch.setattr(B, "RANGE_ROWS", 3)
    steps = [(i, float(k), 10) for i, k in enumerate((6, 60, 0, 6.6, 5.9, 7, 8))]
    df = spark.createDataFrame(steps, "step long, kl double, n_steps int")
    assert {r["coefficient"] for r in X.kl_controller("fixed", 0.3)(df).collect()} == {0.3}
    value, want = 0.2, []
    for _, kl, n in steps:
        value = X.kl_coefficient(value, kl, 6.0, n, 100)
        want.append(value)
    got = X.kl_controller("adaptive", 0.2, 6.0, 100)(df).orderBy("step").collect()
    assert [r["coefficient"] for r in got] == pytest.approx(want)
    for bad in (lambda: X.kl_controller("other", 1.0), lambda: X.kl_controller("adaptive", 1.0, 6.0, 0)):
        with pytest.raises(ValueError):
            bad()


def test_json_is_the_whole_text(spark):
    """What follows a first value makes a text none, also where it would close what it is put into."""
    cases = {"8294846167456848 Inly onhe.": False, "{} x": False, "1, 2": False, "1],[2": False, '1,"b":2': False, "1},{": False, "": False, "[1": False, ' {"a": [1, "x"]} ': True, "7": True, '"a"': True}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["j"] for r in df.select("t", V.verify("detectable_format:json_format", "t").alias("j")).collect()}
    assert got == cases


def test_votes_of_many_answers_are_rows(spark):
    """Draws are rows that are counted once, not arrays that each answer goes through again."""
    import hashlib
    import statistics
    from collections import Counter

    n, rows = 40, [("s", "u", "acc", i, i * 0.5, None if i % 9 == 0 else f"p{i % 9}") for i in range(40)]
    df = spark.createDataFrame(rows, "data_source string, uid string, var_name string, pos int, value double, pred string")
    out = X.validation_metrics(df, resamples=5)
    assert "array_distinct(transform" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["metric"]: r["value"] for r in out.collect()}
    for size in (2, 4, 8, 16, 32, 40):
        made = []
        for b in range(5):
            drawn = [rows[int(hashlib.md5(f"42:s:u:acc:{b}:{k}".encode()).hexdigest()[:8], 16) % n] for k in range(size)]
            votes = Counter(d[5] for d in drawn)  # in the order first drawn
            top = max(votes, key=votes.get)
            made.append((max(d[4] for d in drawn), min(d[4] for d in drawn), next(d[4] for d in drawn if d[5] == top)))
        for name, values in zip(("best", "worst", "maj"), zip(*made)):
            assert math.isclose(got[f"{name}@{size}/mean"], statistics.fmean(values)) and math.isclose(got[f"{name}@{size}/std"], statistics.pstdev(values), abs_tol=1e-12)


@pytest.mark.parametrize("name", ["kl_cov", "clip_cov"])
def test_covariance_losses_choose_exactly_without_a_limit(spark, name):
    """As a sort has it, with ties over rows and tokens; no plan brings the chosen to one task."""
    rng = np.random.default_rng(7)
    rows = [(2**60 + i // 9, i % 9, int(rng.random() < 0.8), -float(rng.integers(0, 5)), -float(rng.integers(0, 5)) / 2, float(rng.integers(-3, 4))) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, t int, mask int, logp double, old_logp double, adv double")
    out = LOSSES.get(name)(df, share=0.1)
    assert "Limit" not in out._jdf.queryExecution().toString() and "TakeOrdered" not in out._jdf.queryExecution().toString()
    named = LOSSES.get(name)(df.withColumn("row_id", F.concat(F.lit("a long name "), F.col("row_id").cast("string"))), share=0.1)
    if name == "kl_cov":  # the draws of clip_cov follow the name
        assert named.agg(F.sum("loss")).first()[0] == pytest.approx(out.agg(F.sum("loss")).first()[0])
    x = L.covariance(df).toPandas()
    n, inside = int(0.1 * x["mask"].sum()), x[(x["mask"] == 1) & ((name == "kl_cov") | (x["cov"] > 1) & (x["cov"] < 5))].copy()
    draw = [r[0] for r in spark.createDataFrame(inside[["row_id", "t"]]).select(X.md5_draw(F.lit("0"), F.col("row_id").cast("string"), F.col("t").cast("string"))).collect()]
    inside["key"] = -inside["cov"] if name == "kl_cov" else draw
    chosen = set(map(tuple, inside.sort_values(["key", "row_id", "t"])[["row_id", "t"]].to_numpy()[:n].tolist()))
    got = {(r["row_id"], r["t"]): r["loss"] for r in out.collect()}
    assert len(chosen) == n and len(got) == 900
    for i, t, _, a, b, v in rows:
        r = math.exp(a - b)
        extra = abs(a - b) if (i, t) in chosen else 0.0
        worse = max(-v * r, -v * min(max(r, 0.8), 1.2))
        want = -v * r + extra if name == "kl_cov" else 0.0 if (i, t) in chosen else worse
        assert got[i, t] == pytest.approx(want)


def test_scalar_times_tokens_is_rounded_as_in_sql(spark):
    """The sum of n copies is another double than n times one, and near ties rounding shows it."""
    import duckdb

    from quillstream.plans.rollout import _times

    rows = [(i, [s * (2.0 - k / m)] * n + [0.0], [1] * n + [0]) for i, (m, k, n, s) in enumerate(product((160, 32, 224), range(1, 400, 7), (3, 5, 7), (1, -1)))]
    got = {r["row_id"]: r["adv"] for r in _times(spark.createDataFrame(rows, "row_id long, advantages array<double>, response_mask array<int>")).collect()}
    want = duckdb.connect().execute("SELECT round(x, 4) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [[a[0] * sum(m) for _, a, m in rows]]).fetchall()
    assert [got[i] for i, *_ in rows] == [x + 0.0 for x, in want]


def test_batch_nll_without_part_keys_is_as_in_sql(spark, tmp_path):
    """Without a part key a token has no log probability: it counts, adds nothing, and alone gives no perplexity."""
    import duckdb

    from quillstream.plans.queries import ORACLES, QUERIES

    items = [(1, 40, "N"), (1, None, "N"), (1, 7, "R"), (2, None, "A"), (2, None, "R"), (3, 5, "R"), (3, None, "R"), (4, -9, "N"), (4, 64, None)]
    x = spark.createDataFrame([(*i, k) for k, i in enumerate(items)], "l_orderkey long, l_partkey long, l_returnflag string, l_linenumber int")
    x = x.withColumns({c: F.lit(1.0) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")} | {"l_suppkey": F.lit(1).cast("long")})
    x.withColumn("l_shipdate", F.lit("2000-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i) for i in range(6)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["batch_nll"]).fetchall())
    assert [w[1:3] for w in want] == [(1.25, 2), (0.0, 1), (0.0, 0), (-0.28125, 2)] and want[1][3] is None
    assert sorted(tuple(r) for r in QUERIES["batch_nll"](spark, str(tmp_path)).collect()) == want


def test_validation_metrics_draw_a_thousand_times(spark, tmp_path):
    """The query makes as many resamples as the metric is defined with; ties, null votes and null values as SQL has them."""
    import duckdb

    from quillstream.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, i % 3 AS user_id, ['a', 'b', NULL][1 + i % 7 % 3] AS event_type, (i * 37 % 11)::DOUBLE AS value FROM range(20) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    assert "range(1000) AS r(b)" in ORACLES["validation_metrics"]
    theirs = {name: value for name, value in con.execute(ORACLES["validation_metrics"]).fetchall()}
    ours = {r["name"]: r["value"] for r in QUERIES["validation_metrics"](spark, str(tmp_path)).collect()}
    assert ours == theirs


def test_resamples_in_blocks(spark, monkeypatch):
    """A group's resamples in blocks are those of one block; null values are left out of best and worst."""
    df = spark.createDataFrame([("s", "u", "acc", i, None if i == 2 else float(i % 4), "ab"[i % 2]) for i in range(9)], "data_source string, uid string, var_name string, pos int, value double, pred string")
    whole = sorted(map(tuple, X.validation_metrics(df, resamples=30).where("metric not like 'mean@%' and metric not like 'std@%'").collect()))
    monkeypatch.setattr(X, "DRAWS", 20)
    assert sorted(map(tuple, X.validation_metrics(df, resamples=30).where("metric not like 'mean@%' and metric not like 'std@%'").collect())) == whole
    assert not any(math.isinf(r[3]) or math.isnan(r[3]) for r in whole)
