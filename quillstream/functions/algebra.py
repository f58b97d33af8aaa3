"""Equality of mathematical answers: expressions as trees, compared as numbers or as identities.

Two expressions without variables are compared as numbers.  Two rational ones with variables are
evaluated at seeded points of a prime field: unequal ones agree at such a point with a chance of
their degree over 2^61, so four points decide.  Others (roots and functions of variables) are
evaluated at seeded complex points.  No text is run as code.
"""

from __future__ import annotations

import cmath
import math
import random
import re
from fractions import Fraction
from functools import lru_cache

PRIME, POINTS, SEED = (1 << 61) - 1, 4, 7
#: Answers are read up to so many characters, as numbers to such a part of their value.
LONGEST, TOLERANCE = 1000, 1e-4
#: Distinct letters of an expression at most, and letters side by side: more is a word.
LETTERS, WORD = 4, 4
#: A power is worked out for exponents up to this; a larger one is a number that no answer has.
POWER = 10_000
FUNCTIONS = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "exp": cmath.exp, "ln": cmath.log, "log": cmath.log, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan,
    "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x),
}
CLEAN = [
    (r"\\left|\\right|\\displaystyle|\\[!,;: ]|~|\$", ""), (r"\\[dtc]frac", r"\\frac"), (r"\\(cdot|times|ast)\b|×|·|\*\*(?!\*)", lambda m: "^" if m[0] == "**" else "*"),
    (r"\\div\b|÷", "/"), (r"\^\s*\{?\\circ\}?|\\degree|°", ""), (r"\\?%", ""), (r"\\(text|mathrm|mbox)\{([^{}]*)\}", r" \2 "), (r"−", "-"), (r"(?<=\d)(,|\{,\})(?=\d{3}(?!\d))", ""),
    (r"(\d) +(\d)", r"\1+\2"), (r"√", r"\\sqrt"), (r"π", r"\\pi"),
]
TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|\\?(" + "|".join(sorted(FUNCTIONS, key=len, reverse=True)) + r"|sqrt|frac|pi|infty|oo)(?![a-z])|([a-zA-Z])|(\\[a-z]+)|(.))")


class Unreadable(ValueError):
    pass


class Irrational(ValueError):
    pass


class Reader:
    """A tree of tuples: (number,), (letter,), or an operation and its parts."""

    def __init__(self, text: str):
        for pattern, new in CLEAN:
            text = re.sub(pattern, new, text)
        self.tokens = []
        for m in TOKEN.finditer(text.strip()):
            kind = next(k for k in range(1, 6) if m[k] is not None)
            self.tokens.append(("?number name letter command sign".split()[kind - 1].lstrip("?"), m[kind]))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> str:
        kind, text = self.peek()
        if sign is not None and text != sign or kind == "end":
            raise Unreadable
        self.at += 1
        return text

    def whole(self) -> tuple:
        out = self.sum()
        if self.peek()[0] != "end":
            raise Unreadable
        return out

    def sum(self) -> tuple:
        out = self.product()
        while self.peek()[1] in ("+", "-"):
            out = (self.take(), out, self.product())
        return out

    def product(self) -> tuple:
        out = self.signed()
        while True:
            kind, text = self.peek()
            if text in ("*", "/"):
                out = (self.take(), out, self.signed())
            elif kind in ("number", "name", "letter") or text in ("(", "{"):
                out = ("*", out, self.power())
            else:
                return out

    def signed(self) -> tuple:
        if self.peek()[1] in ("+", "-"):
            return ("-", (Fraction(0),), self.signed()) if self.take() == "-" else self.signed()
        return self.power()

    def power(self) -> tuple:
        base = self.atom()
        while self.peek()[1] == "!":
            self.take()
            base = ("!", base)
        if self.peek()[1] == "^":
            self.take()
            return ("^", base, self.signed() if self.peek()[1] != "{" else self.group("{", "}"))
        return base

    def group(self, left: str, right: str) -> tuple:
        self.take(left)
        out = self.sum()
        self.take(right)
        return out

    def argument(self) -> tuple:
        """What a command takes: a group, or one digit or letter."""
        kind, text = self.peek()
        if text == "{":
            return self.group("{", "}")
        if kind == "number" and len(text) > 1:
            self.tokens[self.at : self.at + 1] = [("number", text[0]), ("number", text[1:])]
        return self.atom()

    def atom(self) -> tuple:
        kind, text = self.peek()
        if kind == "number":
            return (Fraction(self.take().rstrip(".")),)
        if kind == "letter":
            return (self.take(),)
        if text in ("(", "{"):
            return self.group(text, ")" if text == "(" else "}")
        if text == "|":
            self.take()
            out = ("abs", self.sum())
            self.take("|")
            return out
        if kind != "name":
            raise Unreadable
        self.take()
        if text == "frac":
            return ("/", self.argument(), self.argument())
        if text == "sqrt":
            if self.peek()[1] == "[":
                self.take()
                n = self.sum()
                self.take("]")
                return ("^", self.argument(), ("/", (Fraction(1),), n))
            return ("^", self.argument(), (Fraction(1, 2),))
        if text in ("pi", "infty", "oo"):
            return ("pi",) if text == "pi" else ("oo",)
        if self.peek()[1] == "^":  # \sin^2 x
            self.take()
            n = self.argument()
            return ("^", (text, self.power()), n)
        return (text, self.power())


@lru_cache(1 << 14)
def read(text: str) -> tuple | None:
    """The tree of an expression, or None where there is none or it is a text in words."""
    bare = re.sub(r"\\[a-z]+|" + "|".join(FUNCTIONS) + "|sqrt|frac|pi|oo", " ", text)
    if len(text) > LONGEST or re.search(rf"[a-zA-Z]{{{WORD},}}", bare) or len(set(re.findall("[a-zA-Z]", bare))) > LETTERS:
        return None
    try:
        return Reader(text).whole()
    except (Unreadable, RecursionError):
        return None


def letters(tree: tuple) -> set[str]:
    if len(tree) == 1:
        return {tree[0]} if isinstance(tree[0], str) and len(tree[0]) == 1 else set()
    return set().union(*(letters(x) for x in tree[1:]))


def in_field(tree: tuple, at: dict[str, int]) -> int:
    """The value of a rational expression in the prime field; a pole gives ZeroDivisionError."""
    if len(tree) == 1:
        x = tree[0]
        if isinstance(x, Fraction):
            return x.numerator * inverse(x.denominator) % PRIME
        if x in at:
            return at[x]
        raise Irrational
    op = tree[0]
    if op == "^":
        n = tree[2]
        if len(n) != 1:
            n = (exact(n),)
        if not isinstance(n[0], Fraction) or n[0].denominator != 1:
            raise Irrational
        base, n = in_field(tree[1], at), int(n[0])
        return pow(base if n >= 0 else inverse(base), abs(n), PRIME)
    if op not in "+-*/":
        raise Irrational
    a, b = in_field(tree[1], at), in_field(tree[2], at)
    return (a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a * inverse(b)) % PRIME


def inverse(x: int) -> int:
    if x % PRIME == 0:
        raise ZeroDivisionError
    return pow(x, -1, PRIME)


def exact(tree: tuple) -> Fraction | None:
    """The value of an expression of numbers only, None for others."""
    if len(tree) == 1:
        return tree[0] if isinstance(tree[0], Fraction) else None
    if tree[0] not in "+-*/" or None in (parts := [exact(x) for x in tree[1:]]) or tree[0] == "/" and not parts[1]:
        return None
    a, b = parts
    return a + b if tree[0] == "+" else a - b if tree[0] == "-" else a * b if tree[0] == "*" else a / b


def numeric(tree: tuple, at: dict[str, complex], pi: float = math.pi) -> complex:
    if len(tree) == 1:
        x = tree[0]
        return complex(x) if isinstance(x, Fraction) else pi if x == "pi" else math.inf if x == "oo" else at[x]
    op, a = tree[0], numeric(tree[1], at, pi)
    if op in FUNCTIONS:
        return FUNCTIONS[op](a)
    if op == "abs":
        return abs(a)
    if op == "!":
        if a.imag or a.real < 0 or a.real != int(a.real) or a.real > 170:
            raise ValueError
        return math.factorial(int(a.real))
    b = numeric(tree[2], at, pi)
    if op == "^":
        if abs(b) > POWER:
            raise ValueError
        if a.imag == 0 and a.real < 0 and b.imag == 0 and (n := exact(tree[2])) is not None and n.denominator % 2 and n.denominator > 1:
            return (-1 if n.numerator % 2 else 1) * (-a.real) ** b.real  # odd roots of negative numbers are real
        return a**b
    return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b


def close(a: complex, b: complex, tolerance: float) -> bool:
    return a == b or cmath.isfinite(a) and cmath.isfinite(b) and abs(a - b) <= tolerance * max(abs(a), abs(b), 1e-300)


def same_expression(a: str, b: str, tolerance: float = TOLERANCE, pi: float = math.pi) -> bool:
    """Whether two expressions are the same number, or the same function of their letters."""
    x, y = read(a), read(b)
    if x is None or y is None:
        return False
    names = sorted(letters(x) | letters(y))
    try:
        if not names or names == ["i"]:
            return close(numeric(x, {"i": 1j}, pi), numeric(y, {"i": 1j}, pi), tolerance)
        rng, seen = random.Random(SEED), 0
        for _ in range(8 * POINTS):
            try:
                at = {n: rng.randrange(1, PRIME) for n in names}
                if in_field(x, at) != in_field(y, at):
                    return False
                seen += 1
            except ZeroDivisionError:
                continue
            except Irrational:
                break
            if seen == POINTS:
                return True
        return same_at_points(x, y, names, pi)
    except (ArithmeticError, ValueError, RecursionError):
        return False


def same_at_points(x: tuple, y: tuple, names: list[str], pi: float) -> bool:
    """Roots and functions of letters: at points off the axes, and at real ones of either sign."""
    rng, seen = random.Random(SEED), 0
    for k in range(8 * POINTS):
        at = {n: complex(rng.uniform(0.1, 3) * (-1 if k % 4 == 2 else 1), rng.uniform(-2, 2) if k % 2 else 0) for n in names}
        try:
            a, b = numeric(x, at, pi), numeric(y, at, pi)
        except (ArithmeticError, ValueError):
            continue
        if not close(a, b, 1e-9) and abs(a - b) > 1e-12:
            return False
        seen += 1
        if seen == 2 * POINTS:
            return True
    return False


# Answers

NAMED = (("Interval.Ropen", "[", ")"), ("Interval.Lopen", "(", "]"), ("Interval.open", "(", ")"), ("Interval", "[", "]"))


def digits(text: str) -> float | None:
    try:
        return float(text.replace("{,}", "").replace(",", "")) if re.search(r"\d", text) else None
    except ValueError:
        return None


def plain(text: str) -> str:
    """Without the sign of a sum of money, of a percentage, or the base of a number."""
    if re.match(r"\$\d+(\.\d+)?", text):
        return text[1:]
    if re.fullmatch(r"\d+(\.\d+)?\\?%", text):
        return text.replace("\\", "").replace("%", "")
    if (m := re.fullmatch(r"(-?\d+(?:\.\d+)?)_\{?\w+\}?", text)) and float(m[1]).is_integer():
        return str(int(float(m[1])))
    return text


def parts(text: str) -> list[str]:
    """Cut at the commas that no bracket holds."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, text[start:]]]


def matrix(text: str) -> list[list[str]] | None:
    """Rows of cells of a matrix, written in an environment or in brackets."""
    s = text.strip()
    if m := re.fullmatch(r"\\{1,2}begin\{([pbvB]?matrix|array)\}(?:\{[lcr|]*\})?(.*)\\{1,2}end\{\1\}", s, re.S):
        rows = [r for r in re.split(r"\\\\(?:\[[^\]]*\])?|\\(?=\s|-?\d)", m[2]) if r.strip()]
        return [[c.strip() for c in r.split("&")] for r in rows]
    s = re.sub(r"^Matrix\((.*)\)$", r"\1", s, flags=re.S).strip()
    if s.startswith("[") and s.endswith("]") and "[" in s[1:]:
        rows = parts(s[1:-1])
        return [parts(r[1:-1]) for r in rows] if all(r.startswith("[") and r.endswith("]") for r in rows) else None
    return None


def same_answer(a: str | None, b: str | None, percentages: bool = True, tolerance: float = TOLERANCE, pi: float = math.pi) -> bool:
    """Whether an answer is the expected one: as text, as a number (also a hundredth and a hundred
    times it), as an interval, list, point or matrix part by part, or as an expression."""
    if a is None or b is None:
        return False
    a, b = plain(a.strip())[:LONGEST], plain(b.strip())
    if a.lower() == b.lower() or a.replace(" ", "") == b.replace(" ", ""):
        return True
    x, y = digits(a), digits(b)
    if x is not None and y is not None:
        return any(math.isclose(v, x, rel_tol=tolerance) for v in ((y / 100, y, y * 100) if percentages else (y,)))
    if not a or not b:
        return False
    same = lambda u, v: same_answer(u, v, percentages, tolerance, pi)
    m, n = matrix(a), matrix(b)
    if m is not None and n is not None:
        return [len(r) for r in m] == [len(r) for r in n] and all(same(u, v) for r, s in zip(m, n) for u, v in zip(r, s))
    for name, left, right in NAMED:
        if a.startswith(f"{name}(") and a.endswith(")"):
            a = left + a[len(name) + 1 : -1] + right
            break
    a, b = (re.sub(r"\\left|\\right|\\!|\\,|\\ ", "", s).strip() for s in (a, b))
    if a[:1] == "[" and a[-1:] == "]" and b[:1] != "(" or a[:1] == "(" and a[-1:] == ")" and b[:1] != "[":
        bare = [re.sub(r"[{}()]", "", s.strip("[]()")) for s in (a, b)]
    else:
        bare = [re.sub(r"[{}()]", "", s) for s in (a, b)]
    if bare[0] == bare[1]:
        return True
    a = a.removeprefix("Point")
    if a[:1] in ("(", "[") and a[-1:] in (")", "]") and a[:1] == b[:1] and a[-1:] == b[-1:]:
        u, v = parts(a[1:-1]), parts(b[1:-1])
        if len(u) == len(v) > 1:
            return all(map(same, u, v))
    u, v = parts(a), parts(b)
    if len(u) > 1 and len(v) > 1:
        return len(u) == len(v) and all(map(same, u, v))
    return same_expression(a, b, tolerance, pi)


def same_with_pi(a: str | None, b: str | None) -> bool:
    """As above; where pi is written, it may have been taken as 3.14."""
    if same_answer(a, b):
        return True
    return a is not None and b is not None and "pi" in a + b and same_answer(a, b, pi=3.14)
