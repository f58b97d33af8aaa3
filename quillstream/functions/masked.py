"""Aggregates of token arrays under masks, as higher-order column expressions: no shuffle, no explode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_sum(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def masked(v: Column | str, m: Column | str) -> Column:
    """Values, 0 where the mask is 0, whatever the value is there."""
    return F.zip_with(col(v), col(m), lambda x, k: F.when(k == 1, x).otherwise(0.0))


def masked_sum(v, m) -> Column:
    return array_sum(masked(v, m))


def mask_count(m) -> Column:
    return F.aggregate(col(m), F.lit(0).cast("long"), lambda s, x: s + x)


def masked_mean(v, m) -> Column:
    """Sum over mask count plus 1e-8: the constant is part of the result."""
    return masked_sum(v, m) / (mask_count(m) + EPS)


def masked_var(v, m) -> Column:
    """Variance about the masked mean with the n / (n - 1) factor; null where fewer than two are
    in the mask."""
    n = mask_count(m)
    mean = masked_mean(v, m)
    squares = F.zip_with(col(v), col(m), lambda x, k: F.when(k == 1, (x - mean) * (x - mean)).otherwise(0.0))
    return F.when(n > 1, array_sum(squares) / (n + EPS) * n / (n - 1))


def zip3(a, b, c, f) -> Column:
    return F.transform(F.arrays_zip(col(a).alias("a"), col(b).alias("b"), col(c).alias("c")), lambda x: f(x["a"], x["b"], x["c"]))


def reverse_cumsum(a) -> Column:
    """Sum of each entry and all later ones."""
    empty = F.array().cast("array<double>")
    done = F.aggregate(
        F.reverse(col(a)), F.struct(F.lit(0.0).alias("s"), empty.alias("o")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(F.array(acc["s"] + x), acc["o"]).alias("o"))
    )
    return done["o"]


def discounted_returns(r, m, gamma: float) -> Column:
    """Reverse scan R = r + gamma * R, set to 0 after each masked step."""
    empty = F.array().cast("array<double>")
    pairs = F.reverse(F.arrays_zip(col(r).alias("r"), col(m).alias("m")))

    def step(acc, x):
        now = x["r"] + gamma * acc["s"]
        return F.struct((now * x["m"]).alias("s"), F.concat(F.array(now), acc["o"]).alias("o"))

    return F.aggregate(pairs, F.struct(F.lit(0.0).alias("s"), empty.alias("o")), step)["o"]


def gae(r, v, m, gamma: float, lam: float) -> Column:
    """Array of (advantage) by the reverse recurrence; masked steps carry the state through."""
    empty = F.array().cast("array<double>")
    triples = F.reverse(F.arrays_zip(col(r).alias("r"), col(v).alias("v"), col(m).alias("m")))

    def step(acc, x):
        delta = x["r"] + gamma * acc["next"] - x["v"]
        adv = delta + gamma * lam * acc["last"]
        on = x["m"] == 1
        last = F.when(on, adv).otherwise(acc["last"])
        return F.struct(F.when(on, x["v"]).otherwise(acc["next"]).alias("next"), last.alias("last"), F.concat(F.array(last), acc["o"]).alias("o"))

    return F.aggregate(triples, F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), empty.alias("o")), step)["o"]


def response_mask_from_eos(ids, eos) -> Column:
    """1 up to the first end token, that token included; all ones without one."""
    at = F.array_position(col(ids), F.lit(eos))
    return F.transform(col(ids), lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def pad_right(a, width: int, pad) -> Column:
    a = col(a)
    return F.concat(F.slice(a, 1, width), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(width) - F.size(a)).cast("int")))


def truncate(a, width: int, side: str = "right") -> Column:
    """Keep ``width`` entries: of the front (``right`` is cut), the back (``left``) or both (``middle``)."""
    a = col(a)
    if side == "right":
        return F.slice(a, 1, width)
    if side == "left":
        return F.when(F.size(a) > width, F.slice(a, F.size(a) - width + 1, width)).otherwise(a)
    if side == "middle":
        front = width // 2
        return F.when(F.size(a) > width, F.concat(F.slice(a, 1, front), F.slice(a, F.size(a) - (width - front) + 1, width - front))).otherwise(a)
    if side == "error":
        return F.when(F.size(a) <= width, a).otherwise(F.raise_error(F.lit(f"longer than {width}")))
    raise ValueError(f"unknown side {side!r}")


def shift_left_by_one(a, response_length) -> Column:
    """The response's part of an array over prompt and response, where entry t - 1 predicts t."""
    a = col(a)
    n = col(response_length)
    return F.slice(a, F.size(a) - n, n)


def place_at_last(score, length) -> Column:
    """An array of ``length`` zeros with the score at its last place."""
    return F.when(
        length > 0, F.transform(F.sequence(F.lit(1), length), lambda i: F.when(i == length, score).otherwise(0.0))
    ).otherwise(F.array().cast("array<double>"))


def entropy(logits) -> Column:
    """logsumexp(z) - sum(p * z), shifted by the largest logit."""
    z = F.transform(col(logits), lambda x: x.cast("double"))
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    total = array_sum(e)
    return top + F.log(total) - array_sum(F.zip_with(e, z, lambda p, x: p * x)) / total


def log_prob(logits, label) -> Column:
    z = F.transform(col(logits), lambda x: x.cast("double"))
    top = F.array_max(z)
    return F.element_at(z, (col(label) + 1).cast("int")) - top - F.log(array_sum(F.transform(z, lambda x: F.exp(x - top))))


def sum_pi_squared(logits) -> Column:
    z = F.transform(col(logits), lambda x: x.cast("double"))
    top = F.array_max(z)
    one = array_sum(F.transform(z, lambda x: F.exp(x - top)))
    return array_sum(F.transform(z, lambda x: F.exp(2 * (x - top)))) / (one * one)


def kl(logp, ref, kind: str = "kl") -> Column:
    """Scalar KL estimators; a trailing + (straight-through) has the same value."""
    kind = kind.rstrip("+")
    d = logp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        x = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), ref - logp))
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(x) - x - 1))
    raise ValueError(f"unknown KL estimator {kind!r}")


def topk_forward_kl(teacher_ids, teacher_logp, student_ids, student_logp) -> Column:
    """Sum over the teacher's ids of p (log p - log q), at least 0; ids the student lacks count
    with its least log probability."""
    q = F.map_from_arrays(col(student_ids), col(student_logp))
    least = F.array_min(col(student_logp))
    terms = F.zip_with(col(teacher_ids), col(teacher_logp), lambda i, p: F.exp(p) * (p - F.coalesce(F.try_element_at(q, i), least)))
    return F.greatest(F.lit(0.0), array_sum(terms))
