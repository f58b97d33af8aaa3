"""Queries of graders, messages, chats and settings.  What SQL can't parse is written from columns
of the tables in forms whose scores follow from the same columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import graders as G
from quillstream.functions import jagged as J
from quillstream.functions import masked as M
from quillstream.functions import messages as Y
from quillstream.functions import options as O
from quillstream.functions import templates as Z
from quillstream.functions import tokenized as K
from quillstream.functions import verifiers as V
from quillstream.plans.base import query, r6, read, spread


#: A boxed answer in twelve forms, by two digits n and m: text, truth, and the scores as SQL of ``same``.
BOXED = [
    ("'thus \\boxed{\\frac{' || n || '}{7}}'", "'\\frac' || m || '7'", "same", "same", 0), ("'<think>a</think> \\boxed{' || n || '}'", "m", "same", "same", 1),
    ("'\\boxed{0} then \\boxed{' || n || '}'", "m", "same", "same", 0), ("'no box, the answer is ' || n", "m", "0", "same", 0), ("'\\boxed{' || n", "n", "0", "0", 0),
    ("'\\boxed{\\sqrt' || n || '}'", "'\\sqrt{' || m || '}'", "same", "same", 0), ("CAST(NULL AS STRING)", "m", "0", "0", 0), ("'\\boxed{' || n || ',000}'", "m || '000'", "0", "same", 0),
    ("'\\boxed{' || n || '\\%}'", "m", "same", "same", 0), ("'\\boxed{(x+' || n || ')^2}'", "'x^2+' || (2 * m) || 'x+' || (m * m)", "0", "same", 0), ("'\\fbox{a' || n || '}'", "'a' || m", "same", "same", 0),
    ("'\\boxed{[[' || n || ',1],[2,3]]}'", "'\\begin{pmatrix} ' || m || ' & 1 \\\\ 2 & 3 \\end{pmatrix}'", "0", "same", 0),
]


def by_form(forms: list[str], form: str = "f") -> str:
    """SQL: the expression of a row's form."""
    return f"CASE {form} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(forms)) + " END"


def spark_forms(forms: list[str], form: str = "f") -> Column:
    """The same for Spark, whose literals read backslashes as escapes."""
    return F.expr(by_form(forms, form).replace("\\", "\\\\"))


DIGITS = "conv_id, turn, (conv_id * 3 + turn) % 12 AS f, conv_id % 9 + 1 AS n, (conv_id + turn) % 9 + 1 AS m"


@query(
    f"""WITH x AS (SELECT {DIGITS} FROM conversations), y AS (SELECT *, CASE WHEN n = m THEN 1.0::DOUBLE ELSE 0 END AS same FROM x),
    z AS (SELECT conv_id, turn, ({by_form([b[2] for b in BOXED])})::DOUBLE AS math, ({by_form([b[3] for b in BOXED])})::DOUBLE AS equal,
      ({by_form([str(b[4]) for b in BOXED])})::DOUBLE AS form FROM y)
    SELECT conv_id, turn, math, equal, round(0.9 * math + 0.1 * form, 6) AS geometry FROM z"""
)
def grade_boxed(spark, sf):
    """Boxed answers of every turn: as LaTeX text, as equal expressions, and with the form of geometry."""
    x = read(spark, sf, "conversations").selectExpr(*DIGITS.split(", "))
    x = x.withColumns({"t": spark_forms([b[0] for b in BOXED]), "g": spark_forms([f"CAST({b[1]} AS STRING)" for b in BOXED])})
    t, g = F.col("t"), F.col("g")
    geometry = r6(F.coalesce(G.grade_geometry(t, g), F.lit(0.0)))
    return x.select("conv_id", "turn", G.grade_math(t, g).alias("math"), G.grade_equal(t, g).alias("equal"), geometry.alias("geometry"))


#: Two expressions in a and b that are the same whenever the numbers n and m are.
IDENTITIES = [
    ("'(x+' || n || ')(x-' || n || ')'", "'x^2-' || (m * m)"), ("'\\sqrt{' || (n * n * 3) || '}'", "m || '\\sqrt3'"), ("'\\frac{x^2-' || (n * n) || '}{x-' || n || '}'", "'x+' || m"),
    ("'\\sqrt{' || (1 + n) || '+2\\sqrt{' || n || '}}'", "'1+\\sqrt' || m"), ("n || '\\pi'", "(m * 2) || '\\pi/2'"), ("'\\sin^2(' || n || 'x)'", "'1-\\cos^2(' || m || 'x)'"), ("n || ' 1/2'", "'\\frac{' || (2 * m + 1) || '}{2}'"),
    ("'[' || n || ', x+x)'", "'[' || m || ',2x)'"), ("'Interval.open(' || n || ', 20)'", "'(' || m || ',20)'"), ("'\\left(' || n || ', \\frac{1}{2}\\right)'", "'(' || m || ', 0.5)'"), ("'\\sqrt[3]{' || (n * n * n) || '}'", "m"),
    ("'(y+' || n || ')^3'", "'y^3+' || (3 * m) || 'y^2+' || (3 * m * m) || 'y+' || (m * m * m)"), ("'\\frac{1}{x}+\\frac{1}{' || n || '}'", "'\\frac{x+' || m || '}{' || m || 'x}'"), ("'2^{' || n || '}'", "'2\\cdot 2^{' || (m - 1) || '}'"),
]


@query("SELECT doc_id, (doc_id % 9 + 1 = (doc_id + length(coalesce(text, '')) % 3) % 9 + 1) AS equal, false AS twisted FROM documents")
def symbolic_equality(spark, sf):
    """Identities of numbers that are the same where the numbers of a document are; and the same
    two expressions with a term more, which are not."""
    numbers = [f"doc_id % {len(IDENTITIES)} AS f", "doc_id % 9 + 1 AS n", "(doc_id + length(coalesce(text, '')) % 3) % 9 + 1 AS m"]
    x = read(spark, sf, "documents").selectExpr("doc_id", *numbers)
    a, b = (spark_forms([f"CAST({i[k]} AS STRING)" for i in IDENTITIES]) for k in (0, 1))
    more = F.concat(F.lit("(z+1)^2+"), F.regexp_replace(a, r"^.*(\d).*$", "$1"))
    return x.select("doc_id", G.equal_answers(a, b).alias("equal"), G.equal_answers(more, F.lit("z^2+1")).alias("twisted"))


@query(
    """WITH x AS (SELECT conv_id, turn, conv_id % 4 = 0 AS other, turn % 2 AS extra, conv_id % 3 = (conv_id + turn) % 3 AS same, turn % 5 = 4 AS broken FROM conversations),
    y AS (SELECT *, CASE WHEN other THEN 0.0::DOUBLE ELSE (1.0 / (1 + extra) + 2 + CASE WHEN same THEN 1 ELSE 0 END) / 4 END AS s FROM x)
    SELECT conv_id, turn, round(s, 6) AS similarity, CASE WHEN broken THEN 0.0::DOUBLE ELSE 1 END AS format, round(6 * s - 3, 6) AS correctness,
      round(6 * s - 3 + CASE WHEN broken THEN 0 ELSE 1 END, 6) AS total FROM y"""
)
def tool_similarity(spark, sf):
    """Each turn as a tool call, against one that has another name, value, form or a call beside it."""
    c = read(spark, sf, "conversations")
    one = lambda name, a: F.concat(F.lit('{"name": "'), name, F.lit('", "parameters": {"a": '), a.cast("string"), F.lit(', "b": '), (F.col("turn") % 4).cast("string"), F.lit("}}"))
    wrap = lambda body, gap: F.concat(F.lit("<think>x</think>"), gap, F.lit("<tool_call>\n"), body, F.lit("\n</tool_call>"))
    truth = wrap(one(F.lit("f"), F.col("conv_id") % 3), F.lit("\n"))
    got = one(F.when(F.col("conv_id") % 4 == 0, "g").otherwise("f"), (F.col("conv_id") + F.col("turn")) % 3)
    got = F.concat(got, F.when(F.col("turn") % 2 == 1, '\n{"name": "h", "parameters": {}}').otherwise(""))
    x = c.select("conv_id", "turn", wrap(got, F.when(F.col("turn") % 5 == 4, "").otherwise("\n")).alias("t"), truth.alias("g"))
    t, g = F.col("t"), F.col("g")
    total = G.tool_total(t, g)
    return x.select(
        "conv_id", "turn", r6(G.tool_score(t, g)).alias("similarity"), total["format"].alias("format"), r6(total["correctness"]).alias("correctness"), r6(total["score"]).alias("total"),
    )


#: An expression in eight forms of a number n: text, without commas, whole, mixed, normal, readable, brackets.
EXPRESSIONS = [
    ("grouped", "s", "n", "grouped", "s", "true", "grouped"), ("'(' || s || ', 2)'", "'(' || s || ', 2)'", "NULL", "'(' || s || ', 2)'", "'(' || s || ', 2)'", "true", "'(' || s || ', 2)'"),
    ("s || ' 3/4'", "s || ' 3/4'", "NULL", "s || '+3/4'", "s || '+3/4'", "true", "s || ' 3/4'"), ("s || '.0'", "s || '.0'", "n", "s || '.0'", "s", "true", "s || '.0'"),
    ("'\\text{Item ' || s || '}'", "'\\text{Item ' || s || '}'", "NULL", "'\\text{Item ' || s || '}'", "'item ' || s", "false", "'\\text{Item ' || s || '}'"),
    ("s || ' meters'", "s || ' meters'", "NULL", "s || ' meters'", "s", "false", "s || ' meters'"),
    ("'Interval.open(0, ' || s || ')'", "'Interval.open(0, ' || s || ')'", "NULL", "'Interval.open(0, ' || s || ')'", "'interval.open(0, ' || s || ')'", "false", "'(0, ' || s || ')'"),
    ("s || '%'", "s || '%'", "NULL", "s || '%'", "s", "true", "s || '%'"),
]
_EXPRESSION = ["commas", "whole", "mixed", "normal", "readable", "brackets"]


@query(
    f"""WITH x AS (SELECT doc_id, doc_id % 8 AS f, doc_id * 7919 + 12 AS n, CAST(doc_id * 7919 + 12 AS VARCHAR) AS s, format('{{:,}}', doc_id * 7919 + 12) AS grouped FROM documents)
    SELECT doc_id, {", ".join(f"{by_form([e[k] for e in EXPRESSIONS])} AS {c}" for k, c in enumerate(_EXPRESSION, 1))} FROM x"""
)
def expressions(spark, sf):
    """Numbers of documents written in eight ways, in each normal form."""
    n = F.col("doc_id") * 7919 + 12
    x = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 8).alias("f"), n.alias("n"), n.cast("string").alias("s"), F.format_number(n, 0).alias("grouped"))
    x = x.withColumn("t", spark_forms([e[0] for e in EXPRESSIONS]))
    t = F.col("t")
    made = (G.plain_commas(t), G.whole_number(t), G.mixed_number(t), G.normal_expression(t), G.may_be_read(t), G.interval(t))
    return x.select("doc_id", *(c.alias(name) for c, name in zip(made, _EXPRESSION)))


#: A response in seven forms of a number n: text, matched, answer, prediction of the answer line.
STATED = [
    ("'So the answer is ' || n || '. Thanks'", "true", "n", "'[INVALID]'"), ("'x' || lf || 'Answer: ' || n", "true", "n", "n"), ("'Answer: 99' || lf || 'Answer: $' || n || '$'", "true", "'$' || n || '$'", "n"),
    ("'we get ' || n", "true", "n", "'[INVALID]'"), ("n || ' is the answer'", "true", "n", "'[INVALID]'"), ("'nothing here'", "false", "'nothing here'", "'[INVALID]'"), ("'answer: ' || n || ' dollars'", "true", "n || ' dollars'", "n"),
]


@query(
    f"""WITH x AS (SELECT doc_id, doc_id % 7 AS f, CAST((doc_id + length(coalesce(text, ''))) % 30 AS VARCHAR) AS n FROM documents),
    y AS (SELECT doc_id, n, {by_form([e[1] for e in STATED])} AS matched, {by_form([e[2] for e in STATED])} AS answer, {by_form([e[3] for e in STATED])} AS pred FROM x)
    SELECT doc_id, matched, answer, CASE WHEN pred = '12' THEN 1.0::DOUBLE ELSE -1 END AS score, pred = '12' AS acc, pred FROM y"""
)
def stated_answers(spark, sf):
    """What responses of documents' numbers say their answers are, and how they score against 12."""
    n = ((F.col("doc_id") + F.length(F.coalesce("text", F.lit("")))) % 30).cast("string")
    x = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).alias("f"), n.alias("n"), F.lit("\n").alias("lf"))
    x = x.withColumn("t", spark_forms([e[0] for e in STATED]))
    s, line = G.stated_answer(F.col("t")), G.grade_answer_line(F.col("t"), F.lit("12"))
    return x.select(
        "doc_id", s["matched"].alias("matched"), s["answer"].alias("answer"), line["score"].alias("score"), line["acc"].alias("acc"), line["pred"].alias("pred")
    )


JUDGED = ["'Score: ' || s", "'{\"score\": ' || s || '}'", "'```json' || lf || '{\"score\": ' || s || ', \"why\": \"x\"}' || lf || '```'", "'<think>Score: 2</think> I say ' || s || '.'", "'score=' || s", "'nothing'"]


@query("SELECT event_id, CASE WHEN event_id % 13 BETWEEN 1 AND 10 AND event_id % 6 < 5 THEN (event_id % 13)::DOUBLE END AS score FROM events")
def judge_scores(spark, sf):
    """Scores of judgements in JSON, in fences, in words, after thinking, or out of range."""
    e = read(spark, sf, "events")
    x = e.select("event_id", (F.col("event_id") % 6).alias("f"), (F.col("event_id") % 13).cast("string").alias("s"), F.lit("\n").alias("lf"))
    return x.select("event_id", G.judge_score(spark_forms(JUDGED)).alias("score"))


#: An answer in six forms of a source's name: text, exact, contained.
QUESTIONS = [
    ("'<answer>The ' || upper(source) || '!</answer>'", "1", "1"), ("'<answer>a big ' || source || '</answer>'", "0", "1"), ("source", "0", "0"), ("'<answer>x</answer><answer>' || source || '</answer>'", "1", "1"),
    ("'<answer>qqq</answer>'", "0", "0"), ("repeat('<answer>x</answer>', 11) || '<answer>' || source || '</answer>'", "0.25", "0.25"),
]


@query(
    f"""WITH x AS (SELECT doc_id, doc_id % 6 AS f FROM documents WHERE source IS NOT NULL)
    SELECT doc_id, ({by_form([q[1] for q in QUESTIONS])})::DOUBLE AS exact, ({by_form([q[2] for q in QUESTIONS])})::DOUBLE AS contained FROM x"""
)
def grade_substring(spark, sf):
    """Answers that are, or hold, the name of a document's source."""
    d = read(spark, sf, "documents").where("source IS NOT NULL").select("doc_id", "source", (F.col("doc_id") % 6).alias("f"))
    t, g = spark_forms([q[0] for q in QUESTIONS]), F.array("source")
    return d.select("doc_id", G.grade_question(t, g).alias("exact"), G.grade_question_substring(t, g).alias("contained"))


BRACES = 'hi <|tool_call>call:f{a:1,b:<|"|>x, y<|"|>,c:null}<tool_call|> bye'


@query(
    """SELECT conv_id, turn, 'hi ' AS content, 1::BIGINT AS calls, 'f' AS name, CAST(conv_id AS VARCHAR) AS a, role AS b, turn::VARCHAR || ' ' AS tail,
    CASE WHEN turn % 2 = 0 THEN 'get' END AS channel, CASE WHEN turn % 2 = 0 THEN 'p' || conv_id END AS parameter, list_value(7, 8,
    9)[conv_id % 3 + 1:]::VARCHAR AS after_blank, len(regexp_replace(text, '\\s+$', '')) = len(text) AS plain FROM conversations"""
)
def call_formats(spark, sf):
    """Calls in braces, in channels and in XML, and ids from the first that is not blank."""
    c = read(spark, sf, "conversations")
    text = F.concat(
        F.lit("hi <|tool_call>call:f{a:"), F.col("conv_id").cast("string"), F.lit(',b:<|"|>'), F.col("role"), F.lit('<|"|>,c:null}<tool_call|>')
    )
    x = c.withColumn("x", Y.brace_calls(text))
    even = F.col("turn") % 2 == 0
    channel = F.concat(
        F.lit("<|channel|>analysis<|message|>no<|end|><|channel|>commentary to=functions.get <|message|>"),
        F.when(even, F.lit('{"k": 1}')).otherwise("{bad"), F.lit("<|call|>")
    )
    xml = F.concat(
        F.when(even, "<function=f><parameter=k>").otherwise("<function f>"), F.lit("p"), F.col("conv_id").cast("string"),
        F.lit("</parameter></function>")
    )
    x = x.withColumns({"ch": Y.channel_calls(channel), "xm": Y.xml_calls(xml)})
    one = F.get("x.calls", 0)
    ids = Y.skip_blank(
        F.array(*map(F.lit, (7, 8, 9))), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < F.col("conv_id") % 3, " ").otherwise("a"))
    )
    return x.select(
        "conv_id", "turn", F.col("x.content").alias("content"), F.size("x.calls").cast("long").alias("calls"), one["name"].alias("name"), one["arguments"]["a"].alias("a"), one["arguments"]["b"].alias("b"), F.concat(
            F.col("turn").cast("string"), F.lit(" ")
        ).alias("tail"),
        F.get("ch.calls", 0)["name"].alias("channel"), F.get("xm.calls", 0)["arguments"]["k"].alias("parameter"), F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("after_blank"), (
            F.length(F.regexp_replace("text", r"\s+$", "")) == F.length("text")
        ).alias("plain"),
    )


WORD_IDS = "list_transform(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 1000)"
CHAT = "string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)"


def _chats(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m")
    )
    return c.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, text, {WORD_IDS.format(t="'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)")} AS ids
    FROM conversations),
    c AS (SELECT conv_id, {CHAT} AS chat, sum(len(ids)) AS n, sum(CASE WHEN role = 'assistant' THEN len(ids) - 1 ELSE 0 END) AS loss, flatten(list(ids
    ORDER BY turn)) AS ids, string_agg(CASE WHEN role = 'system' THEN '<|im_start|>system' || chr(10) || text || '<|im_end|>' || chr(10) END, ''
    ORDER BY turn) AS sys FROM t GROUP BY 1)
    SELECT conv_id, CAST(n AS BIGINT) AS tokens, CAST(loss AS BIGINT) AS loss_tokens, CAST(list_sum(list_transform(ids, lambda x,
    i: x * i)) AS BIGINT) AS dot, true AS sane, md5(chat || '<|im_start|>assistant' || chr(10)) AS chat,
      md5(chat || '<|im_start|>assistant' || chr(10) || 'ok<|im_end|>' || chr(10)) AS judged, md5(coalesce(sys, '')) AS prefix FROM c"""
)
def sft_rows(spark, sf):
    """Chats written out, encoded turn by turn with their loss masks, and checked against the whole."""
    x = _chats(spark, sf).withColumn("r", Y.sft_row(F.col("messages"), 1000))
    dot = F.aggregate(F.transform("r.input_ids", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return x.select(
        "conv_id", F.size("r.input_ids").cast("long").alias("tokens"), F.aggregate(
            "r.loss_mask", F.lit(0).cast("long"), lambda s, v: s + v
        ).alias("loss_tokens"), dot.alias("dot"), F.col("r.sane").alias("sane"), F.md5(Y.render_chat(F.col("messages"), True)).alias("chat"),
        F.md5(Y.render_chat(Y.with_answer(F.col("messages"), F.lit("ok")))).alias("judged"), F.md5(Y.system_prefix(F.col("messages"))).alias("prefix"),
    )


@query(
    f"""WITH d AS (SELECT doc_id, {WORD_IDS.format(t="text")} AS ids FROM documents
    WHERE text IS NOT NULL), k AS (SELECT *, CASE WHEN len(ids) > 8 THEN ids[len(ids) - 7:] ELSE ids END AS c, list_concat(ids[1:2], ids[3:4],
    [1]) AS ch, list_concat(ids[1:2], ids[5:9], [1]) AS rj FROM d)
    SELECT doc_id, CAST(list_sum(list_transform(list_concat(list_transform(range(greatest(0, 8 - len(c))), lambda x: 0), c), lambda x,
    i: x * i)) AS BIGINT) AS ids, len(c) AS attended,
      CAST(list_sum(list_transform(ch[1:6], lambda x, i: x * i)) AS BIGINT) AS chosen, CAST(list_sum(list_transform(rj[1:6], lambda x,
    i: x * i)) AS BIGINT) AS rejected FROM k"""
)
def encoded_rows(spark, sf):
    """Texts as ids of one width, cut on the left; preference pairs, cut or padded on the right."""
    d = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    x = d.withColumn("e", Y.encoded(F.col("text"), 8, 1000, side="left")).withColumn("w", Y.word_ids(F.col("text"), 1000))
    x = x.withColumn("p", J.preference_rows(F.slice("w", 1, 2), F.slice("w", 3, 2), F.slice("w", 5, 5), 1, 6))
    dot = lambda a: F.aggregate(F.transform(a, lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return x.select(
        "doc_id", dot("e.input_ids").alias("ids"), M.mask_count("e.attention_mask").alias("attended"), dot(F.col("p")[0]).alias("chosen"),
        dot(F.col("p")[1]).alias("rejected")
    )


#: Three chat formats, as templates.
TEMPLATES = {
    "marked": """{% for message in messages %}
{% if loop.first and message['role'] != 'system' %}
{{ '<|im_start|>system\\nYou are helpful.<|im_end|>\\n' }}
{%- endif %}
{{ '<|im_start|>' + message['role'] + '\\n' + message['content'] | trim + '<|im_end|>\\n' }}
{%- endfor %}
{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}""",
    "bracketed": """{% if messages[0].role == 'system' %}{% set system = '<<' ~ messages[0].content ~ '>>' %}{% set rest = messages[1:] %}{% else %}{% set system = '' %}{% set rest = messages %}{% endif %}
{{ bos }}{% for m in rest %}{% if m.role == 'user' %}[INST] {% if loop.index0 == 0 and system %}{{ system }} {% endif %}{{ m.content }} [/INST]{% elif m.role == 'assistant' %} {{ m.content }}{{ eos }}{% else %}({{ m.role | upper }}){% endif %}{% endfor %}""",
    "headed": """{%- for m in messages -%}
    <{{ m.role }} {{ loop.index }}/{{ messages | length }}>
    {{- m.content -}}
    {% if not loop.last %}|{% endif %}
{%- endfor -%}""",
}


@query(
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' AS led,
      first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM conversations)
    SELECT conv_id,
      md5(string_agg(CASE WHEN i = 1 AND role <> 'system' THEN '<|im_start|>system' || chr(10) || 'You are helpful.<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>' || role || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '<|im_end|>' || chr(10), '' ORDER BY turn)
        || CASE WHEN conv_id % 2 = 0 THEN '<|im_start|>assistant' || chr(10) ELSE '' END) AS marked,
      md5('<s>' || coalesce(string_agg(CASE WHEN led AND i = 1 THEN '' WHEN role = 'user' THEN '[INST] ' || CASE WHEN led AND i = 2 THEN '<<' || head || '>> ' ELSE '' END || text || ' [/INST]'
        WHEN role = 'assistant' THEN ' ' || text || '</s>' ELSE '(' || upper(role) || ')' END, '' ORDER BY turn), '')) AS bracketed,
      md5(string_agg('<' || role || ' ' || i || '/' || n || '>' || text || CASE WHEN i < n THEN '|' ELSE '' END, '' ORDER BY turn)) AS headed
    FROM x GROUP BY conv_id"""
)
def chat_templates(spark, sf):
    """Every conversation written by three templates."""
    written = {k: Z.Template(t).render(messages=F.col("messages"), add_generation_prompt=F.col("conv_id") % 2 == 0, bos="<s>", eos="</s>") for k, t in TEMPLATES.items()}
    return _chats(spark, sf).select("conv_id", *[F.md5(c.cast("binary")).alias(k) for k, c in written.items()])


@query(
    """SELECT conv_id, true AS sane, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS chat,
      md5(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text || '<|im_end|>' || chr(10) END, '' ORDER BY turn), '')) AS said FROM conversations GROUP BY 1"""
)
def tokenized_chats(spark, sf):
    """Chats as ids of a tokenizer file: what all ids, and those that the loss is on, decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    x = _chats(spark, sf).repartition(spark.sparkContext.defaultParallelism).withColumn("r", K.chat_row(F.col("messages"), path))
    text = lambda ids: F.md5(K.decoded(ids, path, K.SPECIALS).cast("binary"))
    said = K.said(F.col("r.input_ids"), F.col("r.loss_mask"))
    return x.select("conv_id", F.col("r.sane").alias("sane"), text(F.col("r.input_ids")).alias("chat"), text(said).alias("said"))


@query("SELECT doc_id, md5(text) AS text, 32 AS width, starts_with(text, '') AS starts FROM documents WHERE text IS NOT NULL")
def tokenized_texts(spark, sf):
    """Texts as ids: decoded they are the texts; cut to one width, the first ids are how a text starts."""
    K.small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    d = spread(read(spark, sf, "documents").select("doc_id", "text").where("text IS NOT NULL")).withColumn("ids", K.token_ids(F.col("text"), path))
    d = d.withColumn("e", K.fitted(F.col("ids"), 32))
    kept = F.slice("e.input_ids", 33 - M.mask_count("e.attention_mask").cast("int"), M.mask_count("e.attention_mask").cast("int"))
    begins = F.regexp_replace(K.decoded(kept, path), "\ufffd+$", "")  # a letter may be cut in its bytes
    return d.select("doc_id", F.md5(K.decoded(F.col("ids"), path).cast("binary")).alias("text"), F.size("e.input_ids").alias("width"), F.startswith("text", begins).alias("starts"))


@query(
    """WITH d AS (SELECT doc_id, lang, split_part(text, ' ', 1) AS w, split_part(text, ' ', 2) AS v FROM documents WHERE split_part(text, ' ', 2) <> '')
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 3 END AS parts, 1 AS images, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS videos,
    'see ' || w || ' and ' || v AS plain, w || ' ' || v AS bare,
      2 AS constraints, '{' || w || '}' AS unfenced, 'user:' || chr(10) || w || chr(10) || chr(10) || 'system:' || chr(10) || v AS flat,
    w || '!' AS rewritten, v AS kept, w AS answer, trim(v) AS final FROM d"""
)
def message_functions(spark, sf):
    """Placeholders as typed parts, constraints taken out, fences, rewritten and flattened messages, thinking removed."""
    d = read(spark, sf, "documents").where("text IS NOT NULL").select(
        "doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("w"), F.split_part("text", F.lit(" "), F.lit(2)).alias("v")
    ).where("v <> ''")
    w, v = F.col("w"), F.col("v")
    parts = Y.content_parts(F.concat(F.lit("see <image>"), w, F.lit(" and "), F.when(F.col("doc_id") % 2 == 0, "<video>").otherwise(""), v))
    chat = F.array(F.struct(F.lit("user").alias("role"), w.alias("content")), F.struct(F.lit("system").alias("role"), v.alias("content")))
    changed = Y.rewrite_user(chat, lambda c: F.concat(c, F.lit("!")))
    bare = Y.strip_constraints(F.concat(w, F.lit(" "), v, F.lit(" Use no comma. Be brief.")), F.lit("Be brief.\tUse no comma.\t "))
    return d.select(
        "doc_id", F.size(parts).alias("parts"), F.size(Y.media(parts, "image")).alias("images"), F.size(Y.media(parts, "video")).alias("videos"), Y.content_text(parts).alias("plain"), bare.alias("bare"), F.size(Y.constraint_parts(F.lit("a\tb\t "))).alias("constraints"),
        Y.strip_fence(
            F.concat(F.lit("```json\n{"), w, F.lit("}\n```"))
        ).alias("unfenced"), Y.flatten_prompt(chat).alias("flat"), changed[0]["content"].alias("rewritten"), changed[1]["content"].alias("kept"),
        V.final_answer(
            F.concat(F.lit("<think>a</think><answer>"), w, F.lit("</answer>"))
        ).alias("answer"), V.final_answer(F.concat(F.lit("<|channel>thought\nhm<channel|> "), v)).alias("final"),
    )


DEVICES = "CPU,GB200,B200,MI300X,H100,H800,H200,A100,A800,L40S,L40,A40,L20,H20,910B,Ascend950DT,Ascend910,RTX 3070 Ti,none".split(",")


@query(
    """SELECT event_id, event_type IN ('view', 'click') AS flag, CASE WHEN event_id % 3 = 0 THEN 'no_lower_zero' WHEN event_id % 3 = 1
    THEN 'both' END AS mode, event_id AS step, (event_id + 7) // 8 * 8 AS rounded,
    [448e9, 2.5e15, 2.25e15, 1336e12, 989e12, 989e12, 989e12, 312e12, 312e12, 362.05e12, 181.05e12, 149.7e12, 119.5e12, 148e12, 354e12, 432e12, 354e12, 21.75e12,
      'inf'::DOUBLE][event_id % 19 + 1] / 1e12 AS peak, event_id % 5 <= 2 AND event_id % 2 = 0 AS dump, event_id AS prompt,
    0 AS completion, event_id % 10 AS cached, round(-0.5 * event_id % 7, 6)::DOUBLE AS logp,
    CAST(CAST('0x' || substr(md5(event_type || chr(10) || event_id), 1, 8) AS BIGINT) % 4 AS INTEGER) AS worker FROM events"""
)
def settings(spark, sf):
    """Flags, aliases, steps of paths, multiples, peaks, usage and log probabilities of answers, routing."""
    e = read(spark, sf, "events")
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    word = F.when(F.col("event_type").isin("view", "click"), " Yes ").when(F.col("event_type") == "purchase", "off").otherwise("what")
    mode = F.when(i % 3 == 0, "Upper-Only").when(i % 3 == 1, "").otherwise("nothing")
    body = F.concat(
        F.lit('{"usage": {"prompt_tokens": '), s, F.lit(', "prompt_tokens_details": {"cached_tokens": '), (i % 10).cast("string"), F.lit("}}}")
    )
    probs = F.concat(
        F.when(i % 2 == 0, '{"prompt_logprobs": [').otherwise('{"choices": [{"prompt_logprobs": ['), (-0.5 * (i % 14)).cast("string"),
        F.when(i % 2 == 0, "]}").otherwise("]}]}")
    )
    u = Y.usage(body)
    return e.select(
        "event_id", O.flag(word).alias("flag"), O.band_modes(mode).alias("mode"), O.step_of(F.concat(F.lit("/a/global_step_"), s, F.lit("/"))).alias("step"), O.round_up(i, 8).alias("rounded"), O.peak(F.concat(F.lit("a "), F.element_at(F.array(*map(F.lit, DEVICES)), (i % 19 + 1).cast("int")), F.lit(" card"))).alias("peak"),
        O.may_dump(i % 2 == 0, i % 5, F.lit(2)).alias("dump"), u["prompt"].alias("prompt"), u["completion"].cast("int").alias("completion"), u["cached"].alias("cached"), r6(Y.prompt_log_probs(probs)[0]).alias("logp"), Y.routed(F.col("event_type"), s, 4).alias("worker"),
    )


@query(
    """WITH s AS (SELECT conv_id, list(CASE WHEN conv_id % 4 = 0 AND turn = 2 THEN -4 WHEN turn % 3 = 2 THEN 0 ELSE 1 END ORDER BY turn) AS s
    FROM conversations GROUP BY 1),
    k AS (SELECT conv_id, list_transform(s, lambda x, i: CASE WHEN len(list_filter(s[1:i - 1], lambda y: y = -4)) > 0 THEN -4 ELSE x END) AS k FROM s)
    SELECT conv_id, CASE WHEN len(list_filter(k, lambda x: x = 1)) = len(k) THEN 1.0::DOUBLE ELSE 0 END AS passed, round(len(list_filter(k[1:10],
    lambda x: x = 1)) / len(k[1:10]), 6) AS share, true AS same FROM k"""
)
def case_scores(spark, sf):
    """Test results as a score: all passed, or their share; a compile error fails what follows."""
    c = read(spark, sf, "conversations")
    status = F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 2), -4).when(F.col("turn") % 3 == 2, 0).otherwise(1)
    x = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", status.alias("s")))), lambda e: e["s"]).alias("s"))
    return x.select(
        "conv_id", G.case_score(F.col("s")).alias("passed"), r6(G.case_score(F.col("s"), True)).alias("share"),
        G.same_output(F.array(F.lit(" a"), F.lit("b \n")), F.lit("a\nb")).alias("same")
    )


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CASE WHEN conv_id % 7 = conv_id % 3 THEN 1.0::DOUBLE ELSE 0 END ELSE CASE
    WHEN conv_id % 5 = conv_id % 3 THEN 1.0::DOUBLE ELSE -1 END END AS score,
    CASE WHEN conv_id % 7 = conv_id % 3 THEN 1::BIGINT ELSE 0 END AS hits FROM conversations"""
)
def grade_by_source(spark, sf):
    """The grader of each source, and a grader on arrays."""
    c = read(spark, sf, "conversations")
    k, even = F.col("conv_id"), F.col("turn") % 2 == 0
    text = F.when(even, F.concat(F.lit("#### "), (k % 7).cast("string"))).otherwise(F.concat(F.lit("Answer: "), (k % 5).cast("string")))
    truth = (k % 3).cast("string")
    score = G.grade(F.when(even, "hashes").otherwise("lines"), text, truth, {"hashes": "hash", "lines": "answer_line"})
    many = G.grade_many(G.grade_hash, F.array(F.concat(F.lit("#### "), (k % 7).cast("string")), F.lit("none")), F.array(truth, truth))
    return c.select("conv_id", "turn", score.alias("score"), M.array_sum(many).cast("long").alias("hits"))
