"""Token losses in long form: one row for each token, with row_id, mask, logp, old_logp, adv.

A loss is a column expression over tokens (some need aggregates of a row first), and
``agg_loss`` brings tokens to one number by one or two levels of aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.functions.masked import EPS, kl
from quillstream.operators.metrics import md5_draw
from quillstream.registry import LOSSES


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# columns can't be made before there is a session, so these are functions
def logr() -> Column:
    return clamp(F.col("logp") - F.col("old_logp"), -20.0, 20.0)


def ratio() -> Column:
    return F.exp(logr())


def adv() -> Column:
    return F.col("adv")


def mask() -> Column:
    return F.col("mask")


def agg_loss(df: DataFrame, loss: Column | str = "loss", mode: str = "token-mean", factor: float | None = None) -> DataFrame:
    """One row, ``loss``: over masked tokens, or over rows that have any."""
    x = F.col(loss) if isinstance(loss, str) else loss
    if mode == "token-mean":
        return df.agg((F.sum(x * mask()) / F.sum(mask())).alias("loss"))
    rows = df.groupBy("row_id").agg(F.sum(x * mask()).alias("s"), F.sum(mask()).alias("n")).where("n > 0")
    if mode == "seq-mean-token-sum":
        return rows.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        if factor is None:
            raise ValueError("a factor is needed")
        return rows.agg((F.sum("s") / factor).alias("loss"))
    if mode == "seq-mean-token-mean":
        return rows.agg(F.avg(F.col("s") / (F.col("n") + EPS)).alias("loss"))
    raise ValueError(f"unknown mode {mode!r}")


@LOSSES.register("vanilla")
def vanilla(df: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """Clipped surrogate with a dual clip where the advantage is negative; with clip indicators."""
    plain, clipped = -adv() * ratio(), -adv() * clamp(ratio(), 1 - low, 1 + high)
    worse = F.greatest(plain, clipped)
    out = F.when(adv() < 0, F.least(-adv() * dual, worse)).otherwise(worse)
    return df.withColumns(
        {
            "loss": out, "clipped": (clipped > plain).cast("double"),
            "clipped_low": F.when((adv() < 0) & (worse > -adv() * dual), 1.0).otherwise(0.0), "kl": -logr()
        }
    )


@LOSSES.register("dppo_tv")
def dppo_tv(df: DataFrame, low: float = 0.2, high: float = 0.2, cap: float = 20.0) -> DataFrame:
    d = F.exp("logp") - F.exp("old_logp")
    keep = F.when(adv() > 0, d <= high).otherwise(d >= -low)
    return df.withColumn("loss", F.when(keep, -adv() * F.least(ratio(), F.lit(cap))).otherwise(0.0))


@LOSSES.register("dppo_kl")
def dppo_kl(df: DataFrame, bound: float = 0.05, cap: float = 20.0) -> DataFrame:
    p, q = F.exp("old_logp"), F.exp("logp")
    tiny = F.lit(1e-12)
    d = p * (F.col("old_logp") - F.col("logp")) + (1 - p) * (F.log(F.greatest(1 - p, tiny)) - F.log(F.greatest(1 - q, tiny)))
    keep = F.when(adv() > 0, (q <= p) | (d <= bound)).otherwise((q >= p) | (d <= bound))
    return df.withColumn("loss", F.when(keep, -adv() * F.least(ratio(), F.lit(cap))).otherwise(0.0))


@LOSSES.register("gspo")
def gspo(df: DataFrame, low: float = 3e-4, high: float = 4e-4) -> DataFrame:
    """One ratio for a row: exp of its masked mean log ratio, whose log is at most 10."""
    mean = F.sum((F.col("logp") - F.col("old_logp")) * mask()).over(W.partitionBy("row_id")) / F.greatest(
        F.sum(mask()).over(W.partitionBy("row_id")), F.lit(1)
    )
    r = F.exp(F.least(mean, F.lit(10.0)))
    return df.withColumn("loss", F.greatest(-adv() * r, -adv() * clamp(r, 1 - low, 1 + high)))


@LOSSES.register("sapo")
def sapo(df: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05) -> DataFrame:
    tau = F.when(adv() > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
    return df.withColumn("loss", -adv() * 4 / tau / (1 + F.exp(-tau * (ratio() - 1))))


@LOSSES.register("gpg")
def gpg(df: DataFrame) -> DataFrame:
    return df.withColumn("loss", -F.col("logp") * adv())


def covariance(df: DataFrame) -> DataFrame:
    """Add ``cov``: (adv() - mean adv())(logp - mean logp), the means over masked tokens."""
    means = df.agg((F.sum(adv() * mask()) / F.sum(mask())).alias("_a"), (F.sum(F.col("logp") * mask()) / F.sum(mask())).alias("_l"))
    return df.join(F.broadcast(means)).withColumn("cov", (adv() - F.col("_a")) * (F.col("logp") - F.col("_l"))).drop("_a", "_l")


#: Spans that counts of values are summed up in at once, in the search for a cut.
SPANS = 4096


def kth(counts: DataFrame, k: int) -> tuple:
    """(the k-th smallest of the values ``v``, which occur ``n`` times each; rows below it; rows of it).

    Values are summed up in equal spans, then those of the span with the k-th in spans of their own, until one
    value is left: the driver sees SPANS rows at a time, and no task orders the values."""
    low, high = counts.agg(F.min("v"), F.max("v")).first()
    below = 0
    while True:
        span = F.lit(0) if low == high else F.floor((F.col("v") - F.lit(low)) / (F.lit(high) - F.lit(low)) * SPANS)
        sums = counts.where(F.col("v").between(low, high)).groupBy(span.alias("s")).agg(F.sum("n"), F.min("v"), F.max("v")).collect()
        for _, n, least, most in sorted(sums, key=lambda r: r[0]):
            if below + n >= k:
                break
            below += n
        if least == most:
            return least, below, n
        low, high = least, most


def first_rows(df: DataFrame, keys: list[Column], k: int) -> Column:
    """Whether a row is of the first k by numeric keys, none null, which tell rows apart: a condition on values that
    are found by counts, key by key, so that no task has the k rows.  All rows are, if there are no more."""
    out, same = F.lit(False), F.lit(True)
    for key in keys:
        counts = df.where(same).groupBy(key.alias("v")).agg(F.count("*").alias("n")).persist()
        try:
            total = counts.agg(F.sum("n")).first()[0] or 0
            if total <= k:
                return out | same
            v, below, n = kth(counts, k)
        finally:
            counts.unpersist()
        out, same, k = out | (same & (key < F.lit(v))), same & (key == F.lit(v)), k - below
        if n == k:
            break
    return out | same


def numbers_of(df: DataFrame, name: str) -> list[Column]:
    """Numbers that order a column as it is: its own, or those of seven bytes of text each, and the length."""
    if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint"):
        return [F.col(name).cast("long")]
    text = F.col(name).cast("string").cast("binary")
    most = df.agg(F.max(F.octet_length(text))).first()[0] or 0
    part = lambda i: F.conv(F.rpad(F.hex(F.substring(text, i, 7)), 14, "0"), 16, 10).cast("long")
    return [*map(part, range(1, most + 1, 7)), F.octet_length(text).cast("long")]


def first_tokens(df: DataFrame, among: Column, key: Column, k: int) -> Column:
    """Whether a token is of the first k among some by a numeric key, row_id and t."""
    df = df.where(among)
    return among & first_rows(df, [key, *numbers_of(df, "row_id"), *numbers_of(df, "t")], k)


@LOSSES.register("clip_cov")
def clip_cov(df: DataFrame, share: float = 2e-4, low: float = 1.0, high: float = 5.0, seed: int = 0, clip: float = 0.2) -> DataFrame:
    """Of tokens whose covariance is within (low, high), a seeded few give no loss."""
    df = covariance(df)
    k = max(1, int(share * df.where("mask = 1").count()))
    inside = (mask() == 1) & (F.col("cov") > low) & (F.col("cov") < high)
    draw = md5_draw(F.lit(str(seed)), F.col("row_id").cast("string"), F.col("t").cast("string"))
    off = first_tokens(df, inside, draw, k)
    worse = F.greatest(-adv() * ratio(), -adv() * clamp(ratio(), 1 - clip, 1 + clip))
    return df.withColumn("loss", F.when(off, 0.0).otherwise(worse))


@LOSSES.register("kl_cov")
def kl_cov(df: DataFrame, share: float = 2e-4, beta: float = 1.0) -> DataFrame:
    """The tokens of the largest covariance pay beta times the absolute KL."""
    df = covariance(df)
    k = max(1, int(share * df.where("mask = 1").count()))
    # largest first, as an order by the covariance has it: what is no number, then the infinite
    largest = -F.when(F.isnan("cov"), 8e307).otherwise(clamp(F.coalesce("cov", F.lit(-8e307)), -4e307, 4e307))
    top = first_tokens(df, mask() == 1, largest, k)
    return df.withColumn("loss", -adv() * ratio() + F.when(top, beta * F.abs(logr())).otherwise(0.0))


@LOSSES.register("geo_mean")
def geo_mean(df: DataFrame, low: float = 0.4, high: float = 0.4) -> DataFrame:
    """One row for each sequence: exp of its masked mean clipped log ratio, times its mean advantage."""
    sign = F.signum(adv())
    d = F.col("logp") - F.col("old_logp")
    clipped = F.when(sign > 0, F.least(d, F.lit(high))).otherwise(F.greatest(d, F.lit(-low)))
    rows = df.groupBy("row_id").agg(F.sum(clipped * mask()).alias("d"), F.sum(adv() * mask()).alias("a"), F.sum(mask()).alias("n"))
    return rows.select("row_id", F.lit(1).alias("mask"), (-F.exp(F.col("d") / (F.col("n") + EPS)) * F.col("a") / (F.col("n") + EPS)).alias("loss"))


@LOSSES.register("cispo")
def cispo(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    return df.withColumn("loss", -clamp(ratio(), 1 - low, 1 + high) * adv() * F.col("logp"))


@LOSSES.register("reinforce")
def reinforce(df: DataFrame, weight: str | None = None) -> DataFrame:
    return df.withColumn("loss", -adv() * F.col("logp") * (F.col(weight) if weight else F.lit(1.0)))


@LOSSES.register("bypass_mode")
def bypass_mode(df: DataFrame, threshold: float = 2.0, loss: str = "reinforce") -> DataFrame:
    """Importance weights of the sampling policy inline, truncated, then one of two losses."""
    w = F.least(F.exp(clamp(F.col("logp") - F.col("rollout_logp"), -20.0, 20.0)), F.lit(threshold))
    if loss == "reinforce":
        return reinforce(df.withColumn("_is", w), "_is").drop("_is")
    return vanilla(df.withColumn("old_logp", F.col("rollout_logp")))


def value_loss(df: DataFrame, clip: float = 0.5) -> DataFrame:
    """Half the larger of the clipped and plain squared errors; needs vpred, value, ret."""
    v = F.greatest(F.col("value") - clip, F.least(F.col("value") + clip, F.col("vpred")))
    a, b = (F.col("vpred") - F.col("ret")) ** 2, (v - F.col("ret")) ** 2
    return df.withColumns({"loss": 0.5 * F.greatest(a, b), "clipped": (b > a).cast("double")})


def kl_loss(df: DataFrame, kind: str = "low_var_kl") -> DataFrame:
    return df.withColumn("loss", kl(F.col("logp"), F.col("ref_logp"), kind))


def sft_loss(df: DataFrame, ranks: int = 1) -> DataFrame:
    return df.agg((-F.sum(F.col("logp") * mask()) / F.sum(mask()) * ranks).alias("loss"))


def ppo_composite(
    df: DataFrame, policy: str = "vanilla", entropy_coef: float = 0.0, kl_coef: float = 0.0, kind: str = "low_var_kl", mode: str = "token-mean"
) -> DataFrame:
    """policy - entropy_coef * entropy + kl_coef * KL, each aggregated in the same mode."""
    out = LOSSES.get(policy)(df)
    total = F.col("loss")
    if entropy_coef:
        total = total - entropy_coef * F.col("entropy")
    if kl_coef:
        total = total + kl_coef * kl(F.col("logp"), F.col("ref_logp"), kind)
    return agg_loss(out, total, mode)


def value_composite(df: DataFrame, clip: float = 0.5, mode: str = "token-mean", factor: float | None = None) -> DataFrame:
    """The critic's loss in one row, with how often values are clipped and their mean."""
    x = value_loss(df, clip)
    told = x.agg(
        (F.sum(F.col("clipped") * mask()) / F.sum(mask())).alias("clip_fraction"),
        (F.sum(F.col("vpred") * mask()) / F.sum(mask())).alias("value_mean")
    )
    return agg_loss(x, mode=mode, factor=factor).join(F.broadcast(told))  # one row each
