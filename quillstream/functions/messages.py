"""Chat messages and tool calls: arrays of (role, content), constraint texts, tagged calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.registry import TOOL_PARSERS


def constraint_parts(constraint: Column) -> Column:
    """Tab-separated constraints, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(constraint, "\t"), lambda x: F.trim(x)), lambda x: x != "")


def strip_constraints(text: Column, constraint: Column) -> Column:
    """The text up to the earliest constraint in it; if none is found, the text without them,
    longest first, and without doubled spaces."""
    parts = constraint_parts(constraint)
    places = F.filter(F.transform(parts, lambda x: F.instr(text, x)), lambda p: p > 1)
    cut = F.array_min(places)
    ordered = F.array_sort(parts, lambda a, b: F.length(b) - F.length(a))
    removed = F.aggregate(ordered, text, lambda s, x: F.replace(s, x, F.lit("")))
    return F.when(cut.isNotNull(), F.trim(F.substr(text, F.lit(1), cut - 1))).otherwise(F.trim(F.regexp_replace(removed, " +", " ")))


def rewrite_user(messages: Column, f) -> Column:
    """Change the content of user messages only."""
    return F.transform(
        messages,
        lambda m: F.when(
            m["role"] == "user", F.struct(m["role"].alias("role"), f(m["content"]).alias("content"))
        ).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content")))
    )


def flatten_prompt(messages: Column) -> Column:
    """One message is its content; more are role and content, with a blank line between them."""
    many = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":\n"), m["content"])), "\n\n")
    return F.when(F.size(messages) == 1, F.element_at(messages, 1)["content"]).otherwise(many)


def content_parts(text: Column) -> Column:
    """Text with <image>, <video> or <audio> in it as typed parts, in order."""
    marks = F.regexp_extract_all(text, F.lit("<(image|video|audio)>"), F.lit(1))
    pieces = F.split(text, "<(?:image|video|audio)>")
    both = F.flatten(
        F.transform(
            pieces,
            lambda p, i: F.array(
                F.struct(F.lit("text").alias("type"), p.alias("text")),
                F.struct(F.try_element_at(marks, i + 1).alias("type"), F.lit("").alias("text"))
            )
        )
    )
    return F.filter(both, lambda x: x["type"].isNotNull() & ((x["type"] != "text") | (x["text"] != "")))


def content_text(parts: Column) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")


def strip_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def _calls(text: Column, pattern: str) -> Column:
    found = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        lambda x: F.when(
            F.try_parse_json(x).isNotNull(),
            F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.arguments").alias("arguments"))
        )
    )
    return F.struct(F.filter(found, lambda c: c["name"].isNotNull()).alias("calls"), F.trim(F.regexp_replace(text, pattern, "")).alias("content"))


@TOOL_PARSERS.register("json")
def json_calls(text: Column) -> Column:
    """struct(calls, content) of <tool_call>{...}</tool_call>; bad JSON is left out."""
    return _calls(text, r"(?s)<tool_call>\s*(.*?)\s*</tool_call>")


@TOOL_PARSERS.register("channel")
def channel_calls(text: Column) -> Column:
    """Calls in a commentary channel, once analysis blocks are gone."""
    plain = F.regexp_replace(text, r"(?s)<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")
    pattern = r"(?s)<\|channel\|>commentary to=functions\.(\w+).*?<\|message\|>(.*?)<\|call\|>"
    names, bodies = F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2))
    calls = F.zip_with(names, bodies, lambda n, b: F.when(F.try_parse_json(b).isNotNull(), F.struct(n.alias("name"), b.alias("arguments"))))
    return F.struct(F.filter(calls, lambda c: c.isNotNull()).alias("calls"), F.trim(F.regexp_replace(plain, pattern, "")).alias("content"))


@TOOL_PARSERS.register("xml")
def xml_calls(text: Column) -> Column:
    """<function=name> with <parameter=key> values, all as text: types come from ``typed``."""
    pattern = r"(?s)<function=(\w+)>(.*?)</function>"
    names, bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    inner = r"(?s)<parameter=(\w+)>\s*(.*?)\s*</parameter>"
    calls = F.zip_with(
        names, bodies,
        lambda n, b: F.struct(
            n.alias("name"),
            F.map_from_arrays(F.regexp_extract_all(b, F.lit(inner), F.lit(1)), F.regexp_extract_all(b, F.lit(inner), F.lit(2))).alias("arguments")
        )
    )
    return F.struct(calls.alias("calls"), F.trim(F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>|" + pattern[4:], "")).alias("content"))


def typed(value: Column, kind: str) -> Column:
    """A parameter's text by its declared type; what doesn't fit is null.  Text is never evaluated."""
    if kind in ("int", "integer", "long"):
        return value.try_cast("bigint")
    if kind in ("number", "float", "double"):
        return value.try_cast("double")
    if kind in ("bool", "boolean"):
        return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
    return value


def subsequence(ids: Column, pattern: list[int]) -> Column:
    """0-based place of the first occurrence of a pattern, -1 without one."""
    p, n = F.array(*map(F.lit, pattern)), len(pattern)
    places = F.filter(F.transform(ids, lambda x, i: i), lambda i: (F.slice(ids, i + 1, n) == p) & (i + n <= F.size(ids)))
    return F.coalesce(F.array_min(places), F.lit(-1))


def metric_key(name: Column) -> Column:
    """A key that trackers accept: @ spelled out, slashes joined, other marks as underscores."""
    x = F.regexp_replace(F.regexp_replace(name, "@", "_at_"), "/+", "/")
    return F.regexp_replace(x, r"[^\w./ \-]", "_")


def turn_key(key: Column) -> Column:
    """struct(uid, session, turn) of ``uid_session_turn``; a uid may have underscores itself."""
    m = lambda i, c: F.regexp_extract(key, r"^(.*)_([^_]*)_([^_]*)$", i).cast(c)
    return F.struct(m(1, "string").alias("uid"), m(2, "string").alias("session"), m(3, "int").alias("turn"))


@TOOL_PARSERS.register("brace")
def brace_calls(text: Column) -> Column:
    """struct(calls, content) of ``<|tool_call>call:name{key:value,...}<tool_call|>``: texts stand
    between ``<|"|>`` marks, other values are plain; arguments are given as a map of texts."""
    pattern = r"(?s)<\|tool_call>call:(\w+)\{(.*?)\}<tool_call\|>"
    names, bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    inner = r'(?s)(\w+):(?:<\|"\|>(.*?)<\|"\|>|([^,}]*))'

    def arguments(b):
        keys, quoted, bare = (F.regexp_extract_all(b, F.lit(inner), F.lit(g)) for g in (1, 2, 3))
        values = F.zip_with(quoted, bare, lambda q, p: F.when(q != "", q).otherwise(F.trim(p)))
        return F.map_from_arrays(keys, F.transform(values, lambda v: F.when(F.lower(v) != "null", v)))

    calls = F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), arguments(b).alias("arguments")))
    return F.struct(calls.alias("calls"), F.regexp_replace(text, r"(?s)<\|tool_call>.*$", "").alias("content"))


#: How a chat is written out (fixed values of the format).
TURN, END_OF_TURN = "<|im_start|>", "<|im_end|>"


def render_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit("\n"), content, F.lit(f"{END_OF_TURN}\n"))


def render_chat(messages: Column, generation: bool = False) -> Column:
    """Messages in the chat format, and the prompt for an answer if one is to be generated."""
    text = F.array_join(F.transform(messages, lambda m: render_turn(m["role"], m["content"])), "")
    return F.concat(text, F.lit(f"{TURN}assistant\n")) if generation else text


def generation_prompt() -> Column:
    return F.lit(f"{TURN}assistant\n")


def system_prefix(messages: Column) -> Column:
    """What the format writes before the first message that is not the system's."""
    first = F.filter(messages, lambda m: m["role"] == "system")
    return F.when(F.size(first) > 0, render_chat(F.slice(first, 1, 1))).otherwise("")


def with_answer(messages: Column, answer: Column) -> Column:
    """The chat with an answer as its last turn, for a model that scores it."""
    return F.concat(messages, F.array(F.struct(F.lit("assistant").alias("role"), answer.alias("content"))))


def media(parts: Column, kind: str) -> Column:
    """The parts of a kind (image, video, audio), in order."""
    return F.filter(parts, lambda p: p["type"] == kind)


def word_ids(text: Column, size: int) -> Column:
    """Ids of white-space separated words by their md5: a tokenizer without a vocabulary file."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % size).cast("long"))


def encoded(text: Column, width: int, size: int, pad: int = 0, side: str = "right") -> Column:
    """struct(input_ids, attention_mask) of ``width``: cut on a side, or padded on the left."""
    from quillstream.functions.jagged import pad_left
    from quillstream.functions.masked import truncate

    ids = truncate(word_ids(text, size), width, side)
    mask = pad_left(F.array_repeat(F.lit(1), F.size(ids)), width, 0)
    return F.struct(pad_left(ids, width, pad).alias("input_ids"), mask.alias("attention_mask"))


def sft_row(messages: Column, size: int) -> Column:
    """struct(input_ids, loss_mask, sane): turns written and encoded one by one, loss on what the
    assistant says, header left out; sane if they make up the chat encoded as a whole."""
    turns = F.transform(
        messages, lambda m: F.struct((m["role"] == "assistant").alias("own"), word_ids(render_turn(m["role"], m["content"]), size).alias("ids"))
    )
    ids = F.flatten(F.transform(turns, lambda t: t["ids"]))
    mask = F.flatten(F.transform(turns, lambda t: F.transform(t["ids"], lambda _, i: F.when(t["own"] & (i > 0), 1).otherwise(0))))
    return F.struct(ids.alias("input_ids"), mask.alias("loss_mask"), (ids == word_ids(render_chat(messages), size)).alias("sane"))


def skip_blank(ids: Column, texts: Column) -> Column:
    """Ids from the first whose text is not blank."""
    first = F.array_min(F.filter(F.transform(texts, lambda t, i: F.when(F.trim(t) != "", i)), lambda i: i.isNotNull()))
    return F.when(first.isNull(), F.slice(ids, 1, 0)).otherwise(F.slice(ids, first + 1, F.size(ids)))


def usage(response: Column) -> Column:
    """struct(prompt, completion, cached) tokens of a service's JSON answer, 0 where not told."""
    get = lambda p: F.coalesce(F.get_json_object(response, f"$.usage.{p}").try_cast("long"), F.lit(0).cast("long"))
    return F.struct(
        get("prompt_tokens").alias("prompt"), get("completion_tokens").alias("completion"), get("prompt_tokens_details.cached_tokens").alias("cached")
    )


def prompt_log_probs(response: Column) -> Column:
    """Log probabilities of a prompt, wherever a service's JSON answer has them."""
    places = ("$.prompt_logprobs", "$.choices[0].prompt_logprobs", "$.choices[0].logprobs.token_logprobs")
    return F.from_json(F.coalesce(*[F.get_json_object(response, p) for p in places]), "array<double>")


def routed(prompt: Column, response: Column, n: int) -> Column:
    """A worker for a row, by the md5 of both texts."""
    return (F.conv(F.substring(F.md5(F.concat(prompt, F.lit("\n"), response)), 1, 8), 16, 10).cast("long") % n).cast("int")
