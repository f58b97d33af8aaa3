"""Chat templates against what they should write, by hand."""

import pytest
from pyspark.sql import functions as F

from quillstream.functions.templates import Template, Value
from quillstream.plans.texts import TEMPLATES

CHAT = "m array<struct<role:string,content:string>>, flag boolean, k int"
CHATS = [
    ([("system", "Be brief."), ("user", " Hi? "), ("assistant", "Hello.")], True, 2), ([("user", "a"), ("tool", "b"), ("user", "c")], False, 0), ([("assistant", None)], None, None), ([], True, 1),
]


def marked(chat, flag):
    out = "" if not chat or chat[0][0] == "system" else "<|im_start|>system\nYou are helpful.<|im_end|>\n"
    return out + "".join(f"<|im_start|>{r}\n{(c or '').strip()}<|im_end|>\n" for r, c in chat) + ("<|im_start|>assistant\n" if flag else "")


def bracketed(chat, flag):
    led = bool(chat) and chat[0][0] == "system"
    system, rest, out = f"<<{chat[0][1]}>>" if led else "", chat[1:] if led else chat, "<s>"
    for i, (r, c) in enumerate(rest):
        out += f"[INST] {system + ' ' if i == 0 and system else ''}{c or ''} [/INST]" if r == "user" else f" {c or ''}</s>" if r == "assistant" else f"({r.upper()})"
    return out


def headed(chat, flag):
    return "|".join(f"<{r} {i}/{len(chat)}>{c or ''}" for i, (r, c) in enumerate(chat, 1))


@pytest.mark.parametrize("name", ["marked", "bracketed", "headed"])
def test_templates_write_what_plain_code_writes(spark, name):
    df = spark.createDataFrame(CHATS, CHAT).coalesce(1)
    made = Template(TEMPLATES[name]).render(messages=F.col("m"), add_generation_prompt=F.col("flag"), bos="<s>", eos="</s>")
    assert [r[0] for r in df.select(made).collect()] == [globals()[name](chat, flag) for chat, flag, _ in CHATS]


@pytest.mark.parametrize("source, want", [
    ("a {{ 'b' ~ 1 + 2 }} c", "a b12 c"), ("{{ 1 + 2 }}", "3"), ("{% if k == 2 and not flag or 'x' in 'axb' %}y{% else %}n{% endif %}", "y"), ("{% if nothing is defined %}y{% elif k is not none %}k{{ k }}{% endif %}", "k2"),
    ("{% set x = 'a' %}{% if k %}{% set x = x + 'b' %}{% endif %}{{ x }}", "ab"), ("{% for m in m[1:] %}{% set y = m.role | upper %}{{ y }}{{ loop.last }}{% endfor %}{{ y }}", "USERfalseASSISTANTtrue"), ("{{ m[-1]['role'] }}{{ m | length }}{{ (m | first).role }}", "assistant3system"),
    ("{# note #}x{% if false %}y{% endif %}\n  {% if true %}\nz\n  {%- endif %}\n", "xz"), ("{{ 'it\\'s\\n' }}", "it's\n"), ("{{ \"a|b\" | trim }}{{ nothing }}", "a|b"), ("{% if m[0].role not in ['x'] %}{% endif %}", ValueError), ("{{ x ", ValueError), ("{% for a in m %}", ValueError),
    ("{% endif %}", ValueError), ("{{ a $ b }}", ValueError), ("{{ a | what }}", ValueError), ("{{ a b }}", ValueError), ("{% while x %}", ValueError),
    ("{% for a in m %}{% for b in m %}{{ loop.index0 }}{% endfor %},{% endfor %}", "012,012,012,"), ("{% if flag != true %}a{% else %}b{% endif %}", "b"),
])
def test_what_templates_know(spark, source, want):
    df = spark.createDataFrame(CHATS[:1], CHAT)
    names = {"m": Value(F.col("m"), "list"), "k": F.col("k"), "flag": F.col("flag")}
    if want is ValueError:
        with pytest.raises(ValueError):
            df.select(Template(source).render(**names)).collect()
    else:
        assert df.select(Template(source).render(**names)).first()[0] == want


def test_a_template_may_refuse(spark):
    df = spark.createDataFrame(CHATS[:2], CHAT).coalesce(1)
    refuse = Template("{% if messages[0].role != 'system' %}{{ raise_exception('no system: ' ~ messages[0].role) }}{% endif %}ok").render(messages=F.col("m"))
    assert df.limit(1).select(refuse).first()[0] == "ok"
    with pytest.raises(Exception, match="no system: user"):
        df.select(refuse).collect()
