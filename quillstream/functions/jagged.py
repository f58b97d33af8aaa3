"""Padded and ragged token arrays: masks, padding, shifts, and what is computed over logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import masked as M
from quillstream.functions.masked import array_sum, col


def response_mask(attention: Column | str, width: int) -> Column:
    """The mask of the response: the last ``width`` entries of that of prompt and response."""
    a = col(attention)
    return F.slice(a, F.greatest(F.size(a) - width, F.lit(0)) + 1, width)


def compact(values: Column | str, mask: Column | str) -> Column:
    """Ragged from padded: the values where the mask is 1, in order."""
    pairs = F.arrays_zip(col(values).alias("v"), col(mask).alias("m"))
    return F.transform(F.filter(pairs, lambda x: x["m"] == 1), lambda x: x["v"])


def scatter(values: Column | str, mask: Column | str, pad: float) -> Column:
    """Padded from ragged: the next value where the mask is 1, ``pad`` elsewhere."""
    v, m = col(values), col(mask)
    ones = F.transform(m, lambda k, i: F.when(k == 1, i))
    places = F.filter(ones, lambda i: i.isNotNull())
    return F.transform(m, lambda k, i: F.when(k == 1, F.get(v, F.array_position(places, i).cast("int") - 1)).otherwise(F.lit(pad)))


def pad_left(values: Column | str, width: int, pad: float) -> Column:
    """The last ``width`` values, with ``pad`` before them."""
    v = col(values)
    return F.concat(
        F.array_repeat(F.lit(pad), F.greatest(F.lit(0), width - F.size(v)).cast("int")),
        F.slice(v, F.greatest(F.size(v) - width, F.lit(0)) + 1, width)
    )


def strip_left(ids: Column | str, mask: Column | str) -> Column:
    """The ids after the padding in front: as many from the end as the mask has ones."""
    a, n = col(ids), M.mask_count(mask).cast("int")
    return F.slice(a, F.size(a) - n + 1, n)


def ones(length: Column | str) -> Column:
    return F.array_repeat(F.lit(1), col(length).cast("int"))


def expand(value: Column | str, length: Column | str) -> Column:
    """A row's scalar for each of its tokens."""
    return F.array_repeat(col(value), col(length).cast("int"))


def response_of(values: Column | str, length: Column | str) -> Column:
    """The response's part of values over prompt and response, where entry t - 1 is of token t:
    ``length`` values, less the last one of all."""
    a, n = col(values), col(length).cast("int")
    return F.slice(a, F.greatest(F.size(a) - n, F.lit(1)), n)


def flat_offsets(df: DataFrame, mask: str, order: str = "row_id") -> DataFrame:
    """Add ``n``, the valid tokens of a row, and ``start``, where they begin once all valid tokens
    are laid end to end."""
    from quillstream.operators.frame import running_sum

    x = running_sum(df.withColumn("n", M.mask_count(mask)), "n", order, "_to")
    return x.withColumn("start", F.col("_to") - F.col("n")).drop("_to")


def flatten_valid(df: DataFrame, values: str, mask: str, order: str = "row_id") -> DataFrame:
    """(order, t, place, value): the valid tokens of all rows, end to end."""
    x = flat_offsets(df, mask, order)
    places = F.filter(F.transform(col(mask), lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())
    x = x.select(order, "start", values, F.posexplode(places).alias("k", "t"))
    return x.select(order, F.col("t").cast("long").alias("t"), (F.col("start") + F.col("k")).alias("place"), F.get(values, F.col("t")).alias("value"))


def tempered(logits: Column | str, temperature: float) -> Column:
    return F.transform(col(logits), lambda x: x / temperature)


def probabilities(logits: Column | str) -> Column:
    z = F.transform(col(logits), lambda x: x.cast("double"))
    top = F.array_max(z)
    shifted = F.transform(z, lambda x: F.exp(x - top))
    return F.aggregate(
        F.array(shifted), F.array().cast("array<double>"),
        lambda _, e: F.aggregate(e, F.lit(0.0), lambda s, v: s + v, lambda s: F.transform(e, lambda v: v / s))
    )


def response_log_probs(logits: Column | str, ids: Column | str, length: Column | str) -> Column:
    """Log probabilities of the last ``length`` ids, each by the logits of the place before it."""
    n = col(length).cast("int")
    before, last = response_of(logits, n), F.slice(col(ids), F.size(col(ids)) - n + 1, n)
    return F.zip_with(before, last, lambda z, i: M.log_prob(z, i))


def forward_kl(p_log: Column | str, q_log: Column | str) -> Column:
    """Sum of p (log p - log q)."""
    return array_sum(F.zip_with(col(p_log), col(q_log), lambda p, q: F.exp(p) * (p - q)))


def entropy_and_variance(p: Column) -> Column:
    """struct(h, v): entropy of a distribution, and variance of its log probabilities."""
    h = -array_sum(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))
    second = array_sum(F.transform(p, lambda x: F.when(x > 0, x * F.log(x) * F.log(x)).otherwise(0.0)))
    return F.struct(h.alias("h"), (second - h * h).alias("v"))


def truncated(p: Column, top_k: int, top_p: float) -> Column:
    """The distribution of the ``top_k`` likeliest, of these those with less than ``top_p`` before
    them, with a sum of 1 again; likeliest first."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("kept"))

    def scale(a: Column) -> Column:
        """Divided by its sum, which is made once."""
        return F.aggregate(
            F.array(a), F.array().cast("array<double>"),
            lambda _, x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v, lambda s: F.transform(x, lambda v: v / s))
        )

    def step(acc, x):
        return F.struct(
            (acc["sum"] + x).alias("sum"), F.when(acc["sum"] < top_p, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept")
        )

    best = scale(F.slice(F.reverse(F.array_sort(p)), 1, top_k))
    return scale(F.aggregate(best, start, step, lambda acc: acc["kept"]))


def preference_rows(prompt: Column, chosen: Column, rejected: Column, end: int, width: int, pad: int = 0) -> Column:
    """Two arrays of ``width``: ids of prompt and answer and an end, cut or padded on the right."""
    whole = lambda a: M.pad_right(F.concat(prompt, a, F.array(F.lit(end))), width, pad)
    return F.array(whole(chosen), whole(rejected))
