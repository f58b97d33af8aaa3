"""Answer graders: (answer text, ground truth) to a score, as column expressions.

Balanced braces, multiset matching of tool calls and expression equality (``algebra``) need loops;
those are Arrow-batched pandas functions.  Submitted code is never run and no text is evaluated.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions.algebra import same_with_pi

NUMBER = r"(-?[$0-9.,]{2,}|-?[0-9]+)"


def last_chars(t: Column, n: int) -> Column:
    return F.when(F.length(t) > n, F.substring(t, -n, n)).otherwise(t)


def last_match(t: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), F.lit(-1))


def hash_answer(t: Column, method: str = "strict") -> Column:
    """Of the last 300 characters: the last ``#### number`` without commas and dollars, or the last
    number at all; null without one."""
    tail = last_chars(t, 300)
    if method == "strict":
        return F.regexp_replace(last_match(tail, r"#### (-?[0-9.,]+)"), "[,$]", "")
    numbers = F.filter(F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)"), F.lit(1)), lambda x: ~x.isin("", "."))
    return F.try_element_at(numbers, F.lit(-1))


def grade_hash(t: Column, truth: Column, method: str = "strict", score: float = 1.0, format_score: float = 0.0) -> Column:
    a = hash_answer(t, method)
    return F.when(a.isNull(), 0.0).when(a == truth, score).otherwise(format_score)


def last_boxed(text: str | None) -> str | None:
    """Content of the last balanced \\boxed{} or \\fbox{}, or what follows ``\\boxed `` up to a dollar."""
    if not text:
        return None
    at = text.rfind("\\boxed")
    if at < 0:
        at = text.rfind("\\fbox")
    if at < 0:
        return None
    rest = text[at:]
    if rest.startswith("\\boxed "):
        return rest[7:].split("$")[0]
    start = rest.find("{")
    if start < 0:
        return None
    depth = 0
    for i, c in enumerate(rest[start:], start):
        depth += (c == "{") - (c == "}")
        if not depth:
            return rest[start + 1 : i]
    return None


@F.pandas_udf(T.StringType())
def boxed(t: pd.Series) -> pd.Series:
    return t.map(last_boxed)


def normal_math(x: Column) -> Column:
    """A plain form of a LaTeX answer: spacing, sizes, units and degree signs go, fractions and
    roots get braces, 0.5 and a/b become fractions."""
    steps = [
        (r"\n", ""), (r"\\!", ""), (r"\\\\", r"\\"), (r"\\[td]frac", r"\\frac"), (r"\\left|\\right", ""), (r"\^\{?\\circ\}?", ""), (r"\\\$", ""),
        (r"\\text\{ .*$", ""), (r"\\%|%", ""), (r" \.", " 0."), (r"\{\.", "{0."), (r"^\.", "0."), (r"^[a-zA-Z]{1,2}=", ""), (r"\\sqrt(\w)", r"\\sqrt{$1}"), (r" ", ""),
        (r"\\frac(\d)(\d)", r"\\frac{$1}{$2}"), (r"\\frac(\d)\{", r"\\frac{$1}{"), (
            r"\\frac\{([^{}]*)\}(\d)", r"\\frac{$1}{$2}"
        ), (r"^0\.5$", r"\\frac{1}{2}"), (r"^(-?\d+)/(\d+)$", r"\\frac{$1}{$2}"),
    ]
    for a, b in steps:
        x = F.regexp_replace(x, a, b)
    return x


def grade_math(t: Column, truth: Column) -> Column:
    b = boxed(t)
    return F.when(b.isNotNull() & normal_math(b).eqNullSafe(normal_math(truth)), 1.0).otherwise(0.0)


#: What is taken out of, or put in for, parts of a final answer (fixed values).
SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","),
    ("\\text{m}", "\\text{}")
]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits",
    "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}",
    "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots"
]


def normal_final(x: Column) -> Column:
    x = F.element_at(F.split(x, "="), -1)
    for a, b in SUBSTITUTIONS:
        x = F.replace(x, F.lit(a), F.lit(b))
    for a in REMOVED:
        x = F.replace(x, F.lit(a), F.lit(""))
    for a, b in [
        (r"^.*?\$(.*?)\$.*$", "$1"), (r"\\text\{(.*?)\}", "$1"), (r"\\textbf\{(.*?)\}", "$1"), (r"\\overline\{(.*?)\}", "$1"),
        (r"^.*\\boxed\{(.*)\}.*$", "$1"), (r"frac([^{])(.)", "frac{$1}{$2}"), (r"sqrt([^{])", "sqrt{$1}")
    ]:
        x = F.regexp_replace(x, a, b)
    x = F.replace(x, F.lit("$"), F.lit(""))
    plain = F.replace(x, F.lit(","), F.lit(""))
    return F.trim(F.when(plain.rlike(r"^\d+$"), plain).otherwise(x))


def grade_answer_line(t: Column, truth: Column) -> Column:
    """struct(score +-1, acc, pred) by the last ``Answer:`` line of the last 300 characters."""
    found = F.coalesce(last_match(last_chars(t, 300), r"(?i)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]"))
    pred = normal_final(found)
    acc = pred == normal_final(truth)
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def grade_strict_box(t: Column, truth: Column) -> Column:
    pred = boxed(last_chars(t, 100))
    acc = pred.eqNullSafe(truth)
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def normal_question(x: Column) -> Column:
    x = F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(a|an|the)\b", " "), r"\s+", " "))


def tagged_answer(t: Column) -> Column:
    return F.trim(last_match(t, r"(?s)<answer>(.*?)</answer>"))


def grade_question(t: Column, golden: Column, substring: bool = False, score: float = 1.0, format_score: float = 0.0) -> Column:
    """Match with any golden answer; a quarter of the score if more than ten answer tags are open or closed."""
    a = tagged_answer(t)
    hit = F.exists(
        golden, (lambda g: F.contains(normal_question(a), normal_question(g))) if substring else (lambda g: normal_question(a) == normal_question(g))
    )
    tags = F.greatest(F.regexp_count(t, F.lit("<answer>")), F.regexp_count(t, F.lit("</answer>")))
    return F.when(a.isNull(), 0.0).when(hit, F.when(tags > 10, score / 4).otherwise(score)).otherwise(format_score)


def grade_geometry(t: Column, truth: Column, weight: float = 0.1) -> Column:
    form = F.when(t.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)
    return (1 - weight) * grade_math(t, truth) + weight * form


def multiset_similarity(a: list, b: list) -> float:
    """Shared over joint size, with multiplicity; 1 for two empty lists."""
    x, y = Counter(a), Counter(b)
    both = sum((x & y).values())
    total = sum(x.values()) + sum(y.values()) - both
    return both / total if total else 1.0


def tool_similarity(truth: list[dict], got: list[dict]) -> float:
    """Names as multisets, then each true call with the unused call of its name that fits best:
    shared parameter names, and equal values; from 0 to 1."""
    score = multiset_similarity([c.get("name") for c in truth], [c.get("name") for c in got])
    most, free = 1.0, list(got)
    for call in truth:
        params = call.get("parameters", call.get("arguments", {})) or {}
        most += 1 + len(params)
        best, which = -1.0, None
        for i, other in enumerate(free):
            if other.get("name") == call.get("name"):
                theirs = other.get("parameters", other.get("arguments", {})) or {}
                s = multiset_similarity(list(params), list(theirs)) + sum(theirs.get(k) == v for k, v in params.items())
                if s > best:
                    best, which = s, i
        if which is not None:
            score += best
            free.pop(which)
    return score / most


def parse_calls(text: str | None, tag: str = "tool_call") -> list[dict]:
    """JSON objects of the tagged part, one each line or each tag; bad ones are left out."""
    out = []
    for part in re.findall(rf"<{tag}>(.*?)</{tag}>", text or "", re.S):
        for piece in [part] if part.strip().startswith("{") and "\n{" not in part.strip() else part.splitlines():
            try:
                x = json.loads(piece)
            except ValueError:
                continue
            if isinstance(x, dict):
                out.append(x)
    return out


@F.pandas_udf(T.DoubleType())
def tool_score(answer: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([tool_similarity(parse_calls(t), parse_calls(a)) for a, t in zip(answer, truth)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def equal_answers(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_with_pi(x, y) for x, y in zip(a, b)])


def grade_equal(t: Column, truth: Column) -> Column:
    return F.when(equal_answers(F.coalesce(boxed(t), last_match(t, r"(?i)answer is:?\s*([^\n.]+)")), truth), 1.0).otherwise(0.0)


def case_score(statuses: Column, continuous: bool = False, first: int = 10) -> Column:
    """Of test results (true, false, or codes: -1 service, -2 run, -3 time, -4 compile): all passed,
    or the share of the first ten.  A compile error fails all later cases."""
    seen = F.transform(statuses, lambda s, i: F.when(F.exists(F.slice(statuses, 1, i), lambda x: x == -4), F.lit(-4)).otherwise(s))
    cases = F.slice(seen, 1, first) if continuous else seen
    passed = F.size(F.filter(cases, lambda s: s == 1))
    n = F.size(cases)
    return F.when(n == 0, 0.0).otherwise(passed / n if continuous else (passed == n).cast("double"))


GRADERS = {
    "hash": grade_hash, "math": grade_math, "answer_line": lambda t, g: grade_answer_line(t, g)["score"], "geometry": grade_geometry,
    "equal": grade_equal, "question": lambda t, g: grade_question(t, F.array(g))
}


def grade(source: Column, t: Column, truth: Column, rules: dict[str, str]) -> Column:
    """The grader of each source; an unknown source fails the query."""
    out = F.raise_error(F.concat(F.lit("no grader for "), source)).cast("double")
    for name, grader in rules.items():
        out = F.when(source == name, GRADERS[grader](t, truth)).otherwise(out)
    return out


def judge_score(raw: Column) -> Column:
    """1 to 10 from a judgement: a JSON field, fenced or not, ``Score: n``, or any such number."""
    t = F.element_at(F.split(raw, "</think>"), -1)
    body = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    as_json = F.get_json_object(F.when(body != "", body), "$.score").try_cast("double")
    labelled = F.nullif(F.regexp_extract(t, r"(?i)score\s*[:=]\s*(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    bare = F.nullif(F.regexp_extract(t, r"\b(10|[1-9])\b", 1), F.lit("")).try_cast("double")
    value = F.coalesce(as_json, labelled, bare)
    return F.when((value >= 1) & (value <= 10), value)


def grade_question_substring(t: Column, golden: Column, score: float = 1.0, format_score: float = 0.0) -> Column:
    return grade_question(t, golden, True, score, format_score)


def tool_format(t: Column, truth: Column, most: float = 1.0, least: float = 0.0) -> Column:
    """The tags that the truth has, in their order, each once, after the thinking."""
    calls, answer = F.contains(truth, F.lit("<tool_call>")), F.contains(truth, F.lit("<response>"))
    once = lambda tag: (F.regexp_count(t, F.lit(f"<{tag}>")) == 1) & (F.regexp_count(t, F.lit(f"</{tag}>")) == 1)
    think, call, reply = "<think>.*?</think>", "\n<tool_call>\n.*?\n</tool_call>", "\n<response>.*?</response>"
    right = (
        F.when(answer & ~calls, t.rlike(f"(?s)^{think}{reply}$") & once("response"))
        .when(calls & ~answer, t.rlike(f"(?s)^{think}{call}$") & once("tool_call"))
        .when(calls & answer, t.rlike(f"(?s)^{think}{call}{reply}$") & once("tool_call") & once("response"))
        .otherwise(t.rlike(f"(?s)^{think}$"))
    )
    return F.when(right, most).otherwise(least)


def tool_correctness(t: Column, truth: Column, most: float = 3.0, least: float = -3.0) -> Column:
    """The similarity of calls between ``least`` and ``most``; nothing where no call is wanted."""
    wanted = F.contains(truth, F.lit("<tool_call>"))
    readable = F.contains(t, F.lit("<tool_call>"))
    return F.when(~wanted, 0.0).when(~readable, least).otherwise((most - least) * tool_score(t, truth) + least)


def tool_total(t: Column, truth: Column) -> Column:
    """struct(score, format, correctness)."""
    f, c = tool_format(t, truth), tool_correctness(t, truth)
    return F.struct((f + c).alias("score"), f.alias("format"), c.alias("correctness"))


def plain_commas(x: Column) -> Column:
    """Without the commas between thousands, of numbers of any length; those of tuples stay."""
    return F.regexp_replace(x, r"(?<=\d),(?=\d\d\d(?!\d))", "")


def whole_number(x: Column) -> Column:
    """The integer that a text stands for, to 1e-7; null if it is none."""
    value = plain_commas(F.trim(x)).try_cast("double")
    return F.when(F.abs(value - F.round(value)) <= 1e-7, F.round(value).cast("long"))


def mixed_number(x: Column) -> Column:
    """``7 3/4`` as ``7+3/4``."""
    return F.regexp_replace(x, r"([0-9]) +([0-9])", "$1+$2")


#: Units that say nothing about an answer's value (fixed values).
UNITS = (
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"
)


def normal_expression(x: Column) -> Column:
    """An expression in plain letters: wrappers, signs and units go, numbers in words get powers."""
    x = F.regexp_replace(x, r"^\\text\{(.+?)\}$", "$1")
    x = F.regexp_replace(x, r"\\?[%$]", "")
    x = F.regexp_replace(x, r" (or|and) ", " , ")
    for word, power in (("million", "6"), ("trillion", "12"), ("billion", "9")):
        x = F.replace(x, F.lit(word), F.lit(f"*10^{power}"))
    for unit in UNITS:
        x = F.regexp_replace(x, unit + r"(es)?(s)? *(\^[0-9]+)?", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\^ *\\circ", ""), r"^\{(.*)\}$", "$1")
    x = F.lower(mixed_number(F.regexp_replace(F.regexp_replace(x, r",\\! *", ""), r"- *", "-")))
    return F.coalesce(whole_number(x).cast("string"), x)


def may_be_read(x: Column) -> Column:
    """Whether an expression is plain enough to be compared as one: two letters at most, no nested powers."""
    letters = F.array_distinct(F.regexp_extract_all(F.regexp_replace(x, "sqrt|frac", ""), F.lit(r"\p{L}"), F.lit(0)))
    return (F.size(letters) <= 2) & ~F.contains(x, F.lit("^{")) & ~F.contains(x, F.lit("^(")) & ~x.rlike(r"\^[0-9]+\^|\^[0-9][0-9]+")


#: What an answer stands behind, or before, in their order (fixed values).
BEHIND, BEFORE = ("answer:", "answer is", "answers are"), ("is answer", "is the answer", "are answers", "are the answers")
LINKS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")


def find_answer(text: str | None) -> tuple[bool, str]:
    """(found, answer): the part of a response that its markers point at; it must have a digit."""
    x, found = text or "", False
    for markers, keep in ((BEHIND, lambda x, i, m: x[i + len(m) :]), (BEFORE, lambda x, i, m: x[:i])):
        for m in markers:
            if (i := x.lower().rfind(m)) >= 0:
                x, found = keep(x, i, m).strip(), True
    if (box := last_boxed(x)) is not None:
        x, found = f"\\boxed{{{box}}}", True
    if (i := x.rfind(". ")) >= 0:
        x = x[:i].strip()
    for m in LINKS:
        if (i := x.lower().rfind(m)) >= 0:
            x, found = x[i + len(m) :].strip(), True
    return found and any(c.isdigit() for c in x), x


@F.pandas_udf(T.StructType([T.StructField("matched", T.BooleanType()), T.StructField("answer", T.StringType())]))
def stated_answer(t: pd.Series) -> pd.DataFrame:
    """What responses say their answers are.  Each marker cuts what the one before left, which as
    nested expressions would grow with each; so this runs on Arrow batches."""
    return pd.DataFrame([find_answer(x) for x in t], columns=["matched", "answer"])


def interval(x: Column) -> Column:
    """Named intervals in brackets."""
    for name, left, right in (("Interval", "[", "]"), (r"Interval\.Ropen", "[", ")"), (r"Interval\.Lopen", "(", "]"), (r"Interval\.open", "(", ")")):
        x = F.regexp_replace(x, rf"(?s)^{name}\((.*)\)$", f"{left}$1{right}")
    return x


def same_output(lines: Column, expected: Column) -> Column:
    """Printed lines against what was expected, without white space around either."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return strip(F.array_join(lines, "\n")) == strip(expected)


def grade_many(grader, texts: Column, truths: Column) -> Column:
    """A grader of columns on two arrays, one score each."""
    return F.zip_with(texts, truths, lambda t, g: grader(t, g))
