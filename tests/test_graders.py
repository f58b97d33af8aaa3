"""Graders on cases written by hand, and the algebra behind equal answers."""

import pytest
from pyspark.sql import functions as F

from quillstream.functions import algebra
from quillstream.functions import graders as G
from quillstream.functions import options


def tagged(*calls: str) -> str:
    return "<think>x</think>\n<tool_call>\n" + "\n".join(calls) + "\n</tool_call>"


A, B, A2 = '{"name": "f", "parameters": {"a": 1, "b": 2}}', '{"name": "g", "parameters": {}}', '{"name": "f", "parameters": {"a": 1, "b": 3}}'


A, B, A2 = '{"name": "f", "parameters": {"a": 1, "b": 2}}', '{"name": "g", "parameters": {}}', '{"name": "f", "parameters": {"a": 1, "b": 3}}'
#: text, truth -> math, equal, geometry
BOXED = [
    (
        "thus \\boxed{\\frac{1}{2}}", "\\frac12", 1.0, 1.0, 0.9
    ), ("thus \\boxed{\\frac{1}{2}}", "0.5", 1.0, 1.0, 0.9), ("<think>a</think> \\boxed{7}", "7", 1.0, 1.0, 1.0), ("\\boxed{3} then \\boxed{4}", "4", 1.0, 1.0, 0.9),
    ("\\boxed{\\sqrt3}", "\\sqrt{3}", 1.0, 1.0, 0.9), (
        "no box, the answer is 12", "12", 0.0, 1.0, 0.0
    ), ("\\boxed{12", "12", 0.0, 0.0, 0.0), ("\\boxed{(1, 2)}", "(1,2)", 1.0, 1.0, 0.9), ("\\boxed{1,000}", "1000", 0.0, 1.0, 0.0),
    ("\\boxed{50\\%}", "50", 1.0, 1.0, 0.9), ("\\boxed{x}", "y", 0.0, 0.0, 0.0), ("\\fbox{a}", "a", 1.0, 1.0, 0.9), ("\\boxed 5$", "5", 1.0, 1.0, 0.9), ("\\boxed{\\{1}", "x", 0.0, 0.0, 0.0), (None, "1", 0.0, 0.0, 0.0),
]
#: answer, truth -> similarity, format, correctness
TOOLS = [
    (tagged(A), tagged(A), 1.0, 1.0, 3.0), (tagged(A2), tagged(A), 0.75, 1.0, 1.5), (tagged(B), tagged(A), 0.0, 1.0, -3.0), (tagged(A, B), tagged(A), 0.875, 1.0, 2.25), (tagged(A), tagged(A, B), 0.7, 1.0, 1.2), ("nothing", tagged(A), 0.0, 0.0, -3.0),
    ("<think>x</think>\n<response>hi</response>", "<response>ho</response>", 1.0, 1.0, 0.0), ("<response>hi</response>", "<response>ho</response>", 1.0, 0.0, 0.0), (
        tagged(A) + "\n<response>ok</response>", tagged(A) + "\n<response>y</response>", 1.0, 1.0, 3.0
    ),
    ("<think>x</think>", "plain", 1.0, 1.0, 0.0), (tagged("not json"), tagged(A), 0.0, 1.0, -3.0),
]
#: text -> without commas, integer, mixed, normal, may be read, interval
EXPRESSIONS = [
    (
        "1,234,567", "1234567", 1234567, "1,234,567", "1234567", True, "1,234,567"
    ), ("(1,2)", "(1,2)", None, "(1,2)", "(1,2)", True, "(1,2)"), ("7 3/4", "7 3/4", None, "7+3/4", "7+3/4", True, "7 3/4"), ("3.0", "3.0", 3, "3.0", "3", True, "3.0"),
    (
        "\\text{Blue}", "\\text{Blue}", None, "\\text{Blue}", "blue", False, "\\text{Blue}"
    ), ("5 meters", "5 meters", None, "5 meters", "5", False, "5 meters"), ("2^{3}", "2^{3}", None, "2^{3}", "2^{3}", False, "2^{3}"), ("x+y", "x+y", None, "x+y", "x+y", True, "x+y"),
    (
        "Interval.open(1, 2)", "Interval.open(1, 2)", None, "Interval.open(1, 2)", "interval.open(1, 2)", False, "(1, 2)"
    ), ("Interval(0, 1)", "Interval(0, 1)", None, "Interval(0, 1)", "interval(0, 1)", False, "[0, 1]"), ("50%", "50%", None, "50%", "50", True, "50%"),
    (
        "Interval.Ropen(a, b)", "Interval.Ropen(a, b)", None, "Interval.Ropen(a, b)", "interval.ropen(a, b)", False, "[a, b)"
    ), ("{8}", "{8}", None, "{8}", "8", True, "{8}"), ("3 million", "3 million", None, "3 million", "3 *10^6", False, "3 million"),
]
#: text -> matched, answer; score, accuracy and prediction of the answer line against 12
STATED = [
    (
        "So the answer is 12. Thanks", True, "12", -1.0, False, "[INVALID]"
    ), ("x\nAnswer: 12", True, "12", 1.0, True, "12"), ("Answer: 13\nAnswer: $12$", True, "$12$", 1.0, True, "12"), ("we get 7", True, "7", -1.0, False, "[INVALID]"), ("nothing here", False, "nothing here", -1.0, False, "[INVALID]"),
    ("12 is the answer", True, "12", -1.0, False, "[INVALID]"), ("\\boxed{9}", True, "\\boxed{9}", -1.0, False, "[INVALID]"), (
        "answer: 1,200 dollars", True, "1,200 dollars", -1.0, False, "1200"
    ),
]
#: judgement -> score
JUDGED = [
    ("Score: 7", 7.0), ('{"score": 9}', 9.0), ("```json\n{\"score\": 3, \"why\": \"x\"}\n```", 3.0), ("<think>Score: 2</think> I say 8.", 8.0),
    ("score=11", None), ("nothing", None), ("10 of 10", 10.0)
]
#: answer, golden -> exact, contained
QUESTIONS = [
    ("<answer>The Cat!</answer>", "cat", 1.0, 1.0), ("<answer>a big cat</answer>", "cat", 0.0, 1.0), ("cat", "cat", 0.0, 0.0),
    ("<answer>x</answer><answer>Cat</answer>", "the cat", 1.0, 1.0), ("<answer>dog</answer>", "cat", 0.0, 0.0)
]


def rows(spark, cases, schema, *columns):
    df = spark.createDataFrame([(i, *c[: schema.count(",") + 1]) for i, c in enumerate(cases)], f"id long, {schema}").orderBy("id")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_boxed_answers(spark):
    t, g = F.col("t"), F.col("g")
    got = rows(spark, BOXED, "t string, g string", G.grade_math(t, g), G.grade_equal(t, g), G.grade_geometry(t, g))
    assert [tuple(round(x or 0.0, 6) for x in r) for r in got] == [c[2:] for c in BOXED]


def test_tool_calls(spark):
    t, g = F.col("t"), F.col("g")
    got = rows(spark, TOOLS, "t string, g string", G.tool_score(t, g), G.tool_total(t, g)["format"], G.tool_total(t, g)["correctness"])
    assert [tuple(round(x, 6) for x in r) for r in got] == [c[2:] for c in TOOLS]


def test_expressions(spark):
    t = F.col("t")
    columns = (G.plain_commas(t), G.whole_number(t), G.mixed_number(t), G.normal_expression(t), G.may_be_read(t), G.interval(t))
    assert rows(spark, EXPRESSIONS, "t string", *columns) == [c[1:] for c in EXPRESSIONS]


def test_stated_answers(spark):
    t = F.col("t")
    s, line = G.stated_answer(t), G.grade_answer_line(t, F.lit("12"))
    assert rows(spark, STATED, "t string", s["matched"], s["answer"], line["score"], line["acc"], line["pred"]) == [c[1:] for c in STATED]


def test_judgements_and_questions(spark):
    assert rows(spark, JUDGED, "t string", G.judge_score(F.col("t"))) == [c[1:] for c in JUDGED]
    t, g = F.col("t"), F.array("g")
    assert rows(spark, QUESTIONS, "t string, g string", G.grade_question(t, g), G.grade_question_substring(t, g)) == [c[2:] for c in QUESTIONS]


SAME = [
    (r"\sqrt3", r"\sqrt{3}"), ("(x+1)^2", "x^2+2x+1"), (r"\frac12", "0.5"), ("50\\%", "50"), ("50%", "0.5"), ("1,000", "1000"), (r"\frac{x^2-1}{x-1}", "x+1"), ("x^2-1", "(x-1)(x+1)"),
    (r"\begin{pmatrix} 1 & 2 \\ 3 & 4 \end{pmatrix}", "[[1,2],[3,4.0]]"), ("Matrix([[1, x+x]])", r"\begin{pmatrix}1&2x\end{pmatrix}"), ("Interval.open(1, 2)", "(1,2)"), ("Interval(0, 1)", "[0,1]"), ("Interval.Ropen(0, 2/2)", "[0,1)"), ("Point(1, 2)", "(1,2)"),
    (r"2\pi", "6.2832"), (r"2\pi", "6.28"), (r"\pi r^2", r"r^2\pi"), (r"\sqrt{3+2\sqrt2}", r"1+\sqrt{2}"), ("7 3/4", "31/4"), (r"\sin^2 x+\cos^2 x", "1"), ("12_8", "12"), ("$5", "5"), (r"\frac{\sqrt{2}}{2}", r"1/\sqrt{2}"), ("3!", "6"),
    (r"\sqrt[3]{-8}", "-2"), ("1,2,3", "1, 2, 3.0"), (r"90^\circ", "90"), ("(x+y)^3", "x^3+3x^2y+3xy^2+y^3"), (r"\frac{1}{x+1}+\frac{1}{x-1}", r"\frac{2x}{x^2-1}"), (r"5\sqrt{x}", "5x^{1/2}"), ("i^2", "-1"), ("|x-y|", "|y-x|"), ("blue", "Blue"), ("(((", "((("),
]
OTHER = [
    ("x", "y"), ("(x+1)^2", "x^2+1"), ("3", "4"), ("(1,2)", "[1,2]"), ("(1,2)", "(2,1)"), ("blue", "lube"), (r"\sqrt{x^2}", "x"), ("1/0", "2"), ("", "a"), ("[[1,2],[3,4]]", r"\begin{pmatrix}1&2\\3&5\end{pmatrix}"), ("[[1,2,3,4]]", r"\begin{pmatrix}1&2\\3&4\end{pmatrix}"),
    ("x^y", "y^x"), ("9^9^9^9", "1"), ("(((", "1"), (None, "1"), ("1", None), ("1,2", "1,2,3"), ("-x", "x"), (r"\sqrt{2}", "1.5"), ("2" * 2000 + "+x", "x"), ("(" * 900 + "x+1", "x+2"), ("x/(y-y)", "x"), ("200!", "1"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same_answers(a, b):
    assert algebra.same_with_pi(a, b) and algebra.same_with_pi(b.replace("Point", ""), b)


@pytest.mark.parametrize("a, b", OTHER)
def test_other_answers(a, b):
    assert not algebra.same_with_pi(a, b)


def test_no_text_is_run(tmp_path):
    mark = tmp_path / "mark"
    for text in (f"__import__('os').system('touch {mark}')", f"[open({str(mark)!r}, 'w')]", "exec(1)"):
        algebra.same_with_pi(text, "1")
        algebra.same_with_pi(f"[[{text}]]", r"\begin{pmatrix}1\end{pmatrix}")
    assert not mark.exists()


def test_every_device_has_its_peak(spark):
    """Longer names are not taken for their beginnings."""
    names = list(options.PEAK)
    df = spark.createDataFrame([(f"NVIDIA {n} 80GB",) for n in names], "d string")
    assert [r[0] for r in df.select(options.peak(F.col("d"))).collect()] == [pytest.approx(options.PEAK[n] / 1e12) for n in names]
    assert tuple(df.limit(1).select(options.peak(F.lit("A100"), "B"), options.peak(F.lit("A100"), "P"), options.peak(F.lit("x"))).first()) == (312e12, 0.312, float("inf"))


def test_commas_of_long_numbers(spark):
    """Four and more groups of thousands; tuples and groups of other sizes stay."""
    cases = [("1,000,391,444", "1000391444"), ("12,345,678,901,234,567", "12345678901234567"), ("(1, 200)", "(1, 200)"), ("1,2345,678", "1,2345678"), ("1,000,39", "1000,39"), ("x,123", "x,123")]
    df = spark.createDataFrame(cases, "t string, w string")
    assert [r[0] for r in df.select(G.plain_commas(F.col("t"))).collect()] == [w for _, w in cases]
    assert df.limit(1).select(G.whole_number(F.col("t"))).first()[0] == 1000391444
