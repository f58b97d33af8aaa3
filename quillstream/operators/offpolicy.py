"""Off-policy correction: importance weights, rejection masks and their diagnostics.

Rows: row_id and arrays old_log_probs, rollout_log_probs, response_mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import masked as M

BOUND = 20.0
OPTIONS = tuple(
    ["token_k1", "token_k2", "token_k3"] + [f"seq_{a}_{k}" for a in ("sum", "mean") for k in ("k1", "k2", "k3")] + ["seq_max_k2", "seq_max_k3"]
)


def is_threshold(value: float | str) -> tuple[float | None, float]:
    """(lower or None, upper) of a number or of ``low_high``."""
    if isinstance(value, bool):
        raise TypeError("a threshold is a number or low_high")
    parts = [float(x) for x in str(value).split("_")]
    if len(parts) > 2 or any(x <= 0 for x in parts) or len(parts) == 2 and parts[0] > parts[1]:
        raise ValueError(f"bad threshold {value!r}")
    return (None, parts[0]) if len(parts) == 1 else (parts[0], parts[1])


def rs_thresholds(options: list[str], value: float | str) -> dict[str, tuple[float | None, float]]:
    """A (lower, upper) for each option: one value for all, or a comma list; k1 options have a
    lower bound too, 1 / upper unless given."""
    parts = str(value).split(",")
    if len(parts) == 1:
        parts *= len(options)
    if len(parts) != len(options):
        raise ValueError("one threshold for all options or one for each is needed")
    out = {}
    for o, p in zip(options, parts):
        if o not in OPTIONS:
            raise ValueError(f"unknown option {o!r}")
        low, high = is_threshold(p.strip())
        if not o.endswith("k1") and low is not None:
            raise ValueError(f"{o} takes an upper bound only")
        out[o] = (low if low is not None else 1 / high, high) if o.endswith("k1") else (None, high)
    return out


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), x))


def log_ratio(masked: bool = True) -> Column:
    d = F.zip_with("old_log_probs", "rollout_log_probs", lambda a, b: a - b)
    return M.masked(d, "response_mask") if masked else d


def importance_weights(df: DataFrame, level: str = "token", threshold: float | str = 2.0, batch_normalize: bool = False) -> DataFrame:
    """Add ``is_weights``: exp of the token's log ratio, or of the row's sum, truncated at the upper
    bound; with a lower bound too, weights outside are 0."""
    low, high = is_threshold(threshold)
    d = df.withColumn("_d", log_ratio())
    if level == "token":
        w = F.transform("_d", lambda x: F.exp(_clamp(x)))
    elif level == "sequence":
        d = d.withColumn("_w", F.exp(_clamp(M.array_sum("_d"))))
        w = F.transform("_d", lambda _: F.col("_w"))
    else:
        raise ValueError(f"unknown level {level!r}")
    cut = (lambda x: F.least(x, F.lit(high))) if low is None else (lambda x: F.when((x >= low) & (x <= high), x).otherwise(0.0))
    d = d.withColumn("is_weights", F.zip_with(F.transform(w, cut), "response_mask", lambda x, m: x * m)).drop("_d", "_w")
    if batch_normalize:
        if level == "token":
            mean = d.agg((F.sum(M.array_sum("is_weights")) / F.sum(M.mask_count("response_mask"))).alias("_mean"))
        else:
            mean = d.agg(F.avg(F.array_max("is_weights")).alias("_mean"))
        d = d.join(F.broadcast(mean)).withColumn(
            "is_weights", F.transform("is_weights", lambda x: x / F.greatest(F.col("_mean"), F.lit(1e-8)))
        ).drop("_mean")
    return d


def _k(kind: str):
    return {"k1": lambda x: -x, "k2": lambda x: 0.5 * x * x, "k3": lambda x: F.exp(_clamp(x)) - 1 - _clamp(x)}[kind]


def rejection_mask(df: DataFrame, options: list[str], threshold: float | str) -> DataFrame:
    """The response mask with what any option rejects set to 0; tokens, or whole rows."""
    d = df.withColumn("_d", log_ratio())
    keep_row, token = F.lit(True), []
    n = F.greatest(M.mask_count("response_mask"), F.lit(1))
    for o, (low, high) in rs_thresholds(options, threshold).items():
        level, kind = o.rsplit("_", 1)
        if level == "token":
            token.append((kind, low, high))
            continue
        if level == "seq_max":
            x = F.coalesce(F.array_max(M.masked(F.transform("_d", _k(kind)), "response_mask")), F.lit(0.0))
        else:
            x = M.array_sum(M.masked(F.transform("_d", _k(kind)), "response_mask"))
            x = x / n if level == "seq_mean" else x
        keep_row = keep_row & _inside(x, kind, low, high)

    def keep(x, m):
        ok = F.lit(True)
        for kind, low, high in token:
            ok = ok & _inside(_k(kind)(x), kind, low, high)
        return F.when(ok & F.col("_keep"), m).otherwise(0)

    return d.withColumn("_keep", keep_row).withColumn("response_mask", F.zip_with("_d", "response_mask", keep)).drop("_d", "_keep")


def _inside(x: Column, kind: str, low: float | None, high: float) -> Column:
    if kind == "k1":  # the ratio exp(-k1) is bounded on both sides
        return (F.exp(_clamp(-x)) >= low) & (F.exp(_clamp(-x)) <= high)
    return x <= high


def offpolicy_metrics(df: DataFrame) -> DataFrame:
    """One row: perplexities of both policies, KL, k3, perplexity ratio and chi-square."""
    n = M.mask_count("response_mask")
    rows = df.withColumn("_d", log_ratio()).select(
        n.alias("n"), M.array_sum("_d").alias("d"), M.masked_sum("old_log_probs", "response_mask").alias("lo"), M.masked_sum("rollout_log_probs", "response_mask").alias("lr"),
        M.masked_sum(
            F.transform("_d", lambda x: F.exp(_clamp(x)) - 1 - x), "response_mask"
        ).alias("k3"), M.masked_sum(F.transform("_d", lambda x: F.exp(2 * _clamp(x))), "response_mask").alias("w2"),
    ).where("n > 0")
    mo, mr = F.col("lo") / F.col("n"), F.col("lr") / F.col("n")
    return rows.agg(
        F.avg(F.exp(-mo)).alias("training_ppl"), F.avg(-mo).alias("training_log_ppl"), F.avg(F.exp(-mr)).alias("rollout_ppl"), F.avg(-mr).alias("rollout_log_ppl"),
        (-F.sum("d") / F.sum("n")).alias("kl"), (F.sum("k3") / F.sum("n")).alias("k3_kl"), F.avg(mr - mo).alias("log_ppl_diff"), F.avg(F.abs(mr - mo)).alias("log_ppl_abs_diff"),
        F.max(mr - mo).alias("log_ppl_diff_max"), F.min(mr - mo).alias("log_ppl_diff_min"), F.avg(F.exp(mr - mo)).alias("ppl_ratio"),
        (F.sum("w2") / F.sum("n") - 1).alias("chi2_token"), (F.avg(F.exp(2 * _clamp(F.col("d")))) - 1).alias("chi2_seq"),
    )


def weight_metrics(df: DataFrame, threshold: float = 2.0) -> DataFrame:
    """One row: mean, extremes, shares above and below the bounds, and effective sample size."""
    w = df.select(
        F.explode(F.arrays_zip("is_weights", "response_mask")).alias("x")
    ).where("x.response_mask = 1").select(F.col("x.is_weights").alias("w"))
    mean = F.avg("w")
    return w.agg(
        mean.alias("mean"), F.max("w").alias("max"), F.min("w").alias("min"), F.stddev_pop("w").alias("std"),
        F.avg((F.col("w") > threshold).cast("double")).alias("share_high"), F.avg((F.col("w") < 1 / threshold).cast("double")).alias("share_low"),
        (mean * mean / F.avg(F.col("w") * F.col("w"))).alias("ess")
    )


def correct(
    df: DataFrame, level: str = "token", threshold: float | str = 2.0, options: list[str] | None = None, rs_threshold: float | str | None = None
) -> DataFrame:
    """Weights and rejection mask as new columns."""
    out = importance_weights(df, level, threshold)
    return rejection_mask(out, options, rs_threshold if rs_threshold is not None else threshold) if options else out


def bypass(df: DataFrame) -> DataFrame:
    return df.withColumn("old_log_probs", F.col("rollout_log_probs"))
