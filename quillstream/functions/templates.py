"""Chat templates as column expressions.

A template of the usual kind (text, ``{{ … }}``, ``for``, ``if``, ``set``) is read once on the driver and
becomes one expression over an array of messages: loops are transforms that are joined, conditions
are cases, filters are functions.  Rows never leave the engine.

What is known: names, strings, whole numbers, ``true``, ``false``, ``none``; ``x.name``, ``x['name']``, ``x[0]``, ``x[-1]``,
``x[1:]``; ``+`` and ``~`` on strings, ``+`` on numbers, ``==``, ``!=``, ``and``, ``or``, ``not``, ``in``, ``is (not) defined``, ``is (not) none``; the
filters trim, upper, lower, length, first, last; ``loop.first``, ``last``, ``index``, ``index0``; ``raise_exception(…)``.
Lines that hold only a tag leave nothing behind.  What is null or not there is written as nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[-+~|.\[\]():,]))")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Value:
    """A column and what it holds: text, number, truth, list, or something that a name gave (any)."""

    column: Column
    kind: str

    def text(self) -> Column:
        return F.coalesce(self.column.cast("string"), F.lit(""))

    def true(self) -> Column:
        if self.kind == "truth":
            return F.coalesce(self.column, F.lit(False))
        if self.kind == "number":
            return F.coalesce(self.column != 0, F.lit(False))
        if self.kind == "list":
            return F.coalesce(F.size(self.column) > 0, F.lit(False))
        if self.kind == "text":
            return self.text() != ""
        kind, text = F.typeof(self.column), self.text()  # known when the plan is made
        return F.when(kind == "boolean", text == "true").when(kind.isin("int", "bigint"), ~text.isin("", "0")).otherwise(text != "")


def value(x: object) -> Value:
    if isinstance(x, Value):
        return x
    if isinstance(x, bool):
        return Value(F.lit(x), "truth")
    if isinstance(x, int):
        return Value(F.lit(x), "number")
    return Value(F.lit(x), "text") if isinstance(x, str) or x is None else Value(x, "any")


class Expression:
    """Reads one expression, by the usual precedence, into a function of the names around it."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = TOKEN.match(source, at)
            if not m:
                raise ValueError(f"cannot read {source!r} from {source[at:]!r}")
            kind = next(k for k in range(1, 5) if m[k] is not None)
            self.tokens.append((("string", "number", "name", "sign")[kind - 1], m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and (self.peek() in wanted and self.tokens[self.at][0] != "string" or not wanted):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def must(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"{sign!r} expected, not {self.peek()!r}")

    def whole(self, names: dict) -> Value:
        self.at = 0
        out = self.either(names)
        if self.at < len(self.tokens):
            raise ValueError(f"cannot read {self.peek()!r} here")
        return out

    def either(self, n: dict) -> Value:
        out = self.both(n)
        while self.take("or"):
            out = Value(out.true() | self.both(n).true(), "truth")
        return out

    def both(self, n: dict) -> Value:
        out = self.negated(n)
        while self.take("and"):
            out = Value(out.true() & self.negated(n).true(), "truth")
        return out

    def negated(self, n: dict) -> Value:
        return Value(~self.negated(n).true(), "truth") if self.take("not") else self.compared(n)

    def compared(self, n: dict) -> Value:
        a = self.added(n)
        while op := self.take("==", "!=", "in", "is", "not"):
            if op == "is":
                no, what = bool(self.take("not")), self.take("defined", "none")
                there = a.column.isNotNull()
                a = Value(there if (what == "defined") != no else ~there, "truth")
                continue
            if op == "not":
                self.must("in")
            b = self.added(n)
            if op in ("in", "not"):
                inside = F.array_contains(b.column, a.column) if b.kind == "list" else F.contains(b.text(), a.text())
                a = Value(inside if op == "in" else ~inside, "truth")
            else:
                same = a.column.eqNullSafe(b.column) if a.kind == b.kind else a.text() == b.text()
                a = Value(same if op == "==" else ~same, "truth")
        return a

    def added(self, n: dict) -> Value:
        out = self.filtered(n)
        while op := self.take("+", "~"):
            b = self.filtered(n)
            out = Value(out.column + b.column, "number") if op == "+" and out.kind == b.kind == "number" else Value(F.concat(out.text(), b.text()), "text")
        return out

    def filtered(self, n: dict) -> Value:
        out = self.part(n)
        while self.take("|"):
            name = self.take()
            if name in ("trim", "upper", "lower"):
                made = {"trim": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), "upper": F.upper, "lower": F.lower}[name]
                out = Value(made(out.text()), "text")
            elif name == "length":
                out = Value(F.size(out.column) if out.kind == "list" else F.length(out.text()), "number")
            elif name in ("first", "last"):
                out = Value(F.try_element_at(out.column, F.lit(1 if name == "first" else -1)), "any")
            else:
                raise ValueError(f"unknown filter: {name}")
        return out

    def part(self, n: dict) -> Value:
        out = self.plain(n)
        while sign := self.take(".", "["):
            if sign == ".":
                out = self.member(out, self.take())
                continue
            first = self.index()
            if self.take(":"):
                last = self.index()
                first = first or 0
                size = F.size(out.column)
                end = size if last is None else F.lit(last) if last >= 0 else size + last
                out = Value(F.slice(out.column, F.lit(first + 1), F.greatest(end - first, F.lit(0))), "list")
            elif isinstance(first, str):
                out = self.member(out, first)
            else:
                out = Value(F.try_element_at(out.column, F.lit(first + 1 if first >= 0 else first)), "any")
            self.must("]")
        return out

    def index(self) -> str | int | None:
        if self.peek() in (":", "]"):
            return None
        sign = -1 if self.take("-") else 1
        kind = self.tokens[self.at][0]
        return unquoted(self.take()) if kind == "string" else sign * int(self.take())

    @staticmethod
    def member(of: Value | dict, name: str) -> Value:
        return of[name] if isinstance(of, dict) else Value(of.column[name], "any")

    def plain(self, n: dict) -> Value:
        if self.at >= len(self.tokens):
            raise ValueError("an expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return value(unquoted(text))
        if kind == "number":
            return value(int(text))
        if text == "(":
            out = self.either(n)
            self.must(")")
            return out
        if text in ("true", "True", "false", "False", "none", "None"):
            return value({"t": True, "f": False, "n": None}[text[0].lower()])
        if text == "raise_exception":
            self.must("(")
            out = Value(F.raise_error(self.either(n).text()).cast("string"), "text")
            self.must(")")
            return out
        if kind != "name":
            raise ValueError(f"cannot read {text!r} here")
        return n[text] if isinstance(n.get(text), dict) else value(n.get(text))


def unquoted(literal: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), literal[1:-1], flags=re.S)


class Template:
    def __init__(self, source: str):
        parts = TAG.split(source)
        for i in range(1, len(parts), 2):  # a tag alone on its line: what is before it on the line goes
            if parts[i].startswith(("{%-", "{{-")):
                parts[i - 1] = parts[i - 1].rstrip()
            elif parts[i].startswith("{%") and ("\n" in parts[i - 1] or i == 1):
                parts[i - 1] = re.sub(r"(\n|\A)[ \t]+\Z", r"\1", parts[i - 1])
        for i in range(1, len(parts), 2):  # and the end of the line
            if parts[i].endswith(("-%}", "-}}")):
                parts[i + 1] = parts[i + 1].lstrip()
            elif parts[i].endswith("%}"):
                parts[i + 1] = parts[i + 1].removeprefix("\n")
        self.parts = [p for p in parts if p and not p.startswith("{#")]
        self.at = 0
        self.body = self.block()
        if self.at < len(self.parts):
            raise ValueError(f"nothing to end: {self.parts[self.at]}")

    def block(self, *ends: str) -> list[tuple]:
        """Nodes up to a tag that begins with one of ``ends``, which is left to be read."""
        out: list[tuple] = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            if not part.startswith(("{{", "{%")):
                out.append(("text", part))
                self.at += 1
                continue
            inside = part[2:-2].strip("-").strip()
            if part.startswith("{{"):
                out.append(("out", Expression(inside)))
                self.at += 1
                continue
            word = inside.split()[0]
            if word in ("endif", "endfor", "else", "elif"):
                if word not in ends:
                    raise ValueError(f"nothing to end: {part}")
                return out
            self.at += 1
            out.append(self.tag(word, inside))
        if ends:
            raise ValueError(f"{ends[0]} is missing")
        return out

    def tag(self, word: str, inside: str) -> tuple:
        if m := re.fullmatch(r"set\s+(\w+)\s*=(.*)", inside, re.S):
            return ("set", m[1], Expression(m[2]))
        if m := re.fullmatch(r"for\s+(\w+)\s+in\s+(.*)", inside, re.S):
            body = self.block("endfor")
            self.at += 1
            return ("for", m[1], Expression(m[2]), body)
        if word != "if":
            raise ValueError(f"unknown tag: {word}")
        cases, other, test = [], [], inside[2:]
        while True:
            cases.append((Expression(test), self.block("endif", "elif", "else")))
            end = self.parts[self.at][2:-2].strip("-").strip()
            self.at += 1
            if end.startswith("elif"):
                test = end[4:]
                continue
            if end.startswith("else"):
                other = self.block("endif")
                self.at += 1
            return ("if", cases, other)

    def render(self, **names) -> Column:
        """The text for each row: ``names`` are columns, strings, numbers or truths; arrays are columns
        given as ``Value(column, "list")``, but for ``messages``, which is one."""
        known = {k: Value(v, "list") if k == "messages" and isinstance(v, Column) else value(v) for k, v in names.items()}
        return self._write(self.body, known)

    def _write(self, nodes: list[tuple], names: dict) -> Column:
        """Text of nodes; ``names`` takes what they set."""
        out = [F.lit("")]
        for node in nodes:
            if node[0] == "text":
                out.append(F.lit(node[1]))
            elif node[0] == "out":
                out.append(node[1].whole(names).text())
            elif node[0] == "set":
                names[node[1]] = node[2].whole(names)
            elif node[0] == "for":
                out.append(self._loop(node, names))
            else:
                out.append(self._choose(node[1], node[2], names))
        return F.concat(*out)

    def _loop(self, node: tuple, names: dict) -> Column:
        of = node[2].whole(names).column

        def one(x: Column, i: Column) -> Column:
            loop = {"first": Value(i == 0, "truth"), "last": Value(i == F.size(of) - 1, "truth"), "index0": Value(i, "number"), "index": Value(i + 1, "number")}
            return self._write(node[3], names | {node[1]: Value(x, "any"), "loop": loop})  # what a turn sets ends with it

        return F.coalesce(F.array_join(F.transform(of, one), ""), F.lit(""))

    def _choose(self, cases: list[tuple], other: list[tuple], names: dict) -> Column:
        tests = [test.whole(names).true() for test, _ in cases]
        branches = [dict(names) for _ in range(len(cases) + 1)]
        texts = [self._write(body, branch) for (_, body), branch in zip([*cases, (None, other)], branches)]

        def pick(found: list[Column]) -> Column:
            out = found[-1]
            for test, x in zip(reversed(tests), reversed(found[:-1])):
                out = F.when(test, x).otherwise(out)
            return out

        for name in {k for b in branches for k in b if b[k] is not names.get(k)}:
            values = [b.get(name) or value(None) for b in branches]
            kinds = {v.kind for v in values}
            names[name] = Value(pick([v.column for v in values]), kinds.pop() if len(kinds) == 1 else "list" if "list" in kinds else "any")
        return pick(texts)
