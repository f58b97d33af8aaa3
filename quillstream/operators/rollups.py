"""One-row roll-ups of generation, judging and agent loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def speculation(df: DataFrame) -> DataFrame:
    """Rows drafts, accepts, verifies: means over rows of accepts / drafts and 1 + accepts /
    verifies; a row without any counts as 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    length = F.when(F.col("verifies") > 0, 1 + F.col("accepts") / F.col("verifies")).otherwise(0.0)
    return df.agg(F.avg(ratio(F.col("accepts"), F.col("drafts"))).alias("accept_rate"), F.avg(length).alias("accept_length"))


def judging(df: DataFrame) -> DataFrame:
    """Rows called, eligible, score, passed, bonus, error: ratios over all rows; scores (finite, 1
    at least), passes and errors over the called ones; zeros where there are none."""
    called = F.col("called")
    valid = called & ~F.isnan("score") & (F.abs("score") < float("inf")) & (F.col("score") >= 1)
    z = lambda x: F.coalesce(x, F.lit(0.0))
    share = lambda c: F.avg(c.cast("double"))
    score = F.when(valid, F.col("score"))
    return df.agg(
        share(called).alias("called_ratio"), F.count_if(called).alias("called_count"), share(F.col("eligible")).alias("eligible_ratio"), F.count_if("eligible").alias("eligible_count"),
        z(F.avg(score)).alias("score_mean"), z(F.max(score)).alias("score_max"), z(F.min(score)).alias("score_min"), z(share(F.when(called, F.col("passed")))).alias("pass_rate"), F.avg("bonus").alias("bonus_mean"),
        z(share(F.when(called, F.trim(F.coalesce("error", F.lit(""))) != ""))).alias("error_rate"),
    )


def agent_loops(df: DataFrame, order: str = "row_id") -> DataFrame:
    """Rows generate, tools, score, preempted and lengths: least, largest and mean of each, and the
    slowest row's own figures (the first of equally slow ones)."""
    total = F.col("generate") + F.col("tools") + F.col("score")
    slow = F.max_by(F.struct("generate", "tools", "score", "preempted", "prompt_length", "response_length"), F.struct(total, -F.col(order)))
    names = ("generate", "tools", "score", "preempted")
    out = df.agg(*[f(c).alias(f"{c}_{k}") for c in names for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))], slow.alias("_s"))
    return out.select("*", *[F.col(f"_s.{c}").alias(f"slowest_{c}") for c in (*names, "prompt_length", "response_length")]).drop("_s")
