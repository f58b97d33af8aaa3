"""Reward shaping over perplexities: rank penalties, anchor bands, judge fallback, margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.functions import masked as M

MODES = ("band", "no_lower_zero", "lower_zero_only")
#: Two-sided 95 % points of Student's t for 1 to 10 degrees of freedom (fixed values).
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228)


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def mean_nll(nll: str, count: str) -> Column:
    return F.when(F.col(count) > 0, finite(F.col(nll)) / F.col(count))


def complete_anchor(prefix: str = "") -> Column:
    """Both answers are there, with positive counts and finite NLLs; anything else is false."""
    c = lambda n: F.col(f"{prefix}{n}")
    ok = (F.size(c("y0")) > 0) & (F.size(c("y1")) > 0) & (c("ref0_token_count") > 0) & (c("ref1_token_count") > 0) & finite(c("ref0_nll")).isNotNull() & finite(c("ref1_nll")).isNotNull()
    return F.coalesce(ok, F.lit(False))


def train_ready_anchor(limit: int = 32768) -> Column:
    ok = (
        F.col("ref0_token_count") == F.size("y0")
    ) & (F.col("ref1_token_count") == F.size("y1")) & (F.col("ref0_token_count") <= limit) & (F.col("ref1_token_count") <= limit)
    return complete_anchor() & F.coalesce(ok & finite(F.col("ref0_ppl")).isNotNull() & finite(F.col("ref1_ppl")).isNotNull(), F.lit(False))


def attach_anchors(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join on ``index``; rows without an anchor get infinite NLL and count 0.  The join is by
    key on both sides: a cache grows with the data."""
    names = [c for c in cache.columns if c != "index"]
    out = df.join(cache.withColumn("anchor_hit", F.lit(True)), "index", "left").withColumn("anchor_hit", F.coalesce("anchor_hit", F.lit(False)))
    for c in names:
        if c.endswith(("_nll", "_ppl")):
            out = out.withColumn(c, F.coalesce(c, F.lit(float("inf"))))
        elif c.endswith("_count"):
            out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out


def rank_penalty(df: DataFrame, coef: float = 0.1, share: int = 4) -> DataFrame:
    """Rows uid, row_id, ppl, gate, reward: in each group, of rows with finite ppl, the worst
    max(n / share, 1) pay coef if their gate is positive.  (The bonus for low perplexity never fires.)"""
    x = df.withColumn("_p", finite(F.col("ppl")))
    w = W.partitionBy("uid", F.col("_p").isNotNull())
    n = F.count("_p").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("_p"), F.desc("row_id")))
    hit = F.col("_p").isNotNull() & (rank <= F.greatest(F.floor(n / share), F.lit(1))) & (F.col("gate") > 0)
    return x.withColumn("bonus", F.when(hit, -coef).otherwise(0.0)).withColumn("reward", F.col("reward") + F.col("bonus")).drop("_p")


def in_interval(m: Column, floor: Column, ceiling: Column, margin: float, mode: str = "band") -> Column:
    inside = {"band": (m >= floor - margin) & (m <= ceiling), "no_lower_zero": m <= ceiling, "lower_zero_only": F.lit(False)}[mode]
    return F.coalesce(inside & (floor <= ceiling), F.lit(False))


def anchor_band(
    df: DataFrame, coef: float = 0.1, margin: float = 0.0, mode: str = "band", below: str = "zero", inverted: str = "abstain", penalty: float = 0.1
) -> DataFrame:
    """Rows with reward and policy, ref0 (floor) and ref1 (ceiling) NLLs and counts.

    A mean below the floor less the margin sets the reward to 0, or leaves it, or takes a
    penalty; inside the band it earns coef; a band upside down abstains, or is read strictly.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    x = df.withColumns(
        {
            "_m": mean_nll("policy_nll", "policy_token_count"), "_f": mean_nll("ref0_nll", "ref0_token_count"),
            "_c": mean_nll("ref1_nll", "ref1_token_count")
        }
    )
    valid = F.col("_m").isNotNull() & F.col("_f").isNotNull() & F.col("_c").isNotNull()
    upside = F.col("_f") > F.col("_c")
    live = valid & ~upside if inverted == "abstain" else valid
    low = live & (F.col("_m") < F.col("_f") - margin)
    if mode == "no_lower_zero":
        low = F.lit(False)
    good = live & in_interval(F.col("_m"), F.col("_f"), F.col("_c"), margin, mode)
    reward = F.col("reward") + F.when(good, coef).otherwise(0.0)
    if below == "zero":
        reward = F.when(low, 0.0).otherwise(reward)
    elif below == "penalty":
        reward = reward - F.when(low, penalty).otherwise(0.0)
    elif below != "ignore":
        raise ValueError(f"unknown rule {below!r}")
    state = F.when(~valid, "missing").when(upside, "inverted").when(low, "below").when(good, "inside").otherwise("above")
    return x.withColumn("state", state).withColumn("shaped", reward).drop("_m", "_f", "_c")


def needs_judge(constraint: Column, inside: Column) -> Column:
    return (constraint > 0) & ~inside


def judge_bonus(df: DataFrame, threshold: float = 6.0, bonus: float = 0.1) -> DataFrame:
    """Rows reward, constraint_reward, judge_score: a pass earns the bonus, and gives back the
    constraint reward where shaping had made it 0."""
    passed = F.coalesce(F.col("judge_score") >= threshold, F.lit(False)) & (F.col("constraint_reward") > 0)
    base = F.when(F.abs("reward") < 1e-7, F.col("constraint_reward")).otherwise(F.col("reward"))
    return df.withColumn("passed", passed).withColumn("reward", F.when(passed, base + bonus).otherwise(F.col("reward")))


def endpoint(prompt: Column, response: Column, n: int) -> Column:
    """First 8 bytes of SHA-256(prompt, NUL, response) modulo n."""
    h = F.substring(F.sha2(F.concat(prompt, F.lit("\0"), response).cast("binary"), 256), 1, 16)
    high, low = F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return F.pmod(F.pmod(high, F.lit(n)) * ((1 << 32) % n) + F.pmod(low, F.lit(n)), F.lit(n))


def margin_curve(df: DataFrame, target: float = 0.02, step: float = 0.05, steps: int = 41) -> DataFrame:
    """P(m1 < m0 - c) for c = 0, step, ...: one pass with a conditional mean for each c."""
    means = df.agg(*[F.avg((F.col("m1") < F.col("m0") - i * step).cast("double")).alias(f"p{i}") for i in range(steps)])
    rows = means.select(
        F.explode(F.array(*[F.struct(F.lit(round(i * step, 6)).alias("c"), F.col(f"p{i}").alias("p")) for i in range(steps)])).alias("x")
    ).select("x.c", "x.p")
    return rows.withColumn("chosen", F.col("c") == F.min(F.when(F.col("p") <= target, F.col("c"))).over(W.partitionBy(F.lit(0))))


def confidence_bounds(df: DataFrame, by: list[str], value: str, seeds: int) -> DataFrame:
    """mean +- t s / sqrt(n) of keys seen with all seeds."""
    t = T95[seeds - 2]
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s")).where(F.col("n") == seeds)
    half = t * F.col("s") / F.sqrt("n")
    return out.select(*by, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def draw_floor(df: DataFrame, draws: list[str], rule: str = "min") -> DataFrame:
    """Floor of up to k draws: their least, or mean - t s sqrt(1 + 1/k); one draw stands alone."""
    a = F.array_compact(F.array(*draws))
    if rule == "min":
        return df.withColumn("floor", F.array_min(a))
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    s = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / (n - 1))
    t = F.element_at(F.array(*map(F.lit, T95)), n - 1)
    return df.withColumn("floor", F.when(n > 1, mean - t * s * F.sqrt(1 + 1 / n)).otherwise(F.try_element_at(a, F.lit(1))))


def length_penalty(length: Column, limit: int, buffer: int, factor: float = 1.0) -> Column:
    """0 until ``limit - buffer``, then down to -factor at the limit and below after it."""
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))


def is_non_stop(ids: Column, length: Column, limit: int, stops: list[int]) -> Column:
    """The whole budget is used and the last id does not stop; an empty answer is non-stop."""
    return (length == 0) | (length >= limit) & ~F.coalesce(
        F.array_contains(F.array(*map(F.lit, stops)), F.try_element_at(ids, F.lit(-1))), F.lit(False)
    )


CLIPPED_MODES = ("use", "zero", "drop")


def is_clipped(mask: str, limit: int) -> Column:
    """The response fills the whole budget."""
    return M.mask_count(mask) == limit


def _mode(mode: str) -> str:
    if mode not in CLIPPED_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return mode


def clipped_batch(df: DataFrame, mode: str, limit: int, mask: str = "response_mask") -> DataFrame:
    """The rows that go on: mode ``drop`` leaves clipped ones out; nothing left is an error."""
    if _mode(mode) != "drop":
        return df
    out = df.where(~is_clipped(mask, limit))
    if out.isEmpty() and not df.isEmpty():
        raise ValueError("every rollout is clipped: drop would leave none")
    return out


def clipped_rewards(df: DataFrame, mode: str, reward: str, limit: int, mask: str = "response_mask") -> DataFrame:
    """Mode ``zero``: clipped rows have no reward."""
    if _mode(mode) != "zero":
        return df
    return df.withColumn(reward, F.transform(reward, lambda x: F.when(is_clipped(mask, limit), 0.0).otherwise(x)))


def clipped_metrics(df: DataFrame, mode: str, limit: int, mask: str = "response_mask") -> DataFrame:
    hit = is_clipped(mask, limit)
    n = F.count_if(hit)
    gone = n if _mode(mode) == "drop" else F.lit(0).cast("long")
    return df.agg(
        n.alias("count"), (n / F.greatest(F.count("*"), F.lit(1))).alias("ratio"), gone.alias("dropped_count"),
        (F.count("*") - gone).alias("kept_count")
    )


def fallback_bonus(df: DataFrame, reward: str, mask: str, bonus: str, constraint: str) -> DataFrame:
    """Add ``adjustment`` and put it at the response's last token: the bonus, and the constraint
    reward back where shaping had made the whole reward 0 and the bonus is positive."""
    zeroed = F.abs(M.array_sum(reward)) <= 1e-7
    restored = F.when((F.col(bonus) > 0) & (F.col(constraint) > 0) & zeroed, F.col(constraint)).otherwise(0.0)
    last = F.greatest(M.mask_count(mask) - 1, F.lit(0))
    x = df.withColumn("adjustment", F.col(bonus) + restored)
    return x.withColumn(reward, F.transform(reward, lambda r, i: F.when(i == last, r + F.col("adjustment")).otherwise(r)))


def anchor_from_mean(mean: Column, count: Column) -> Column:
    """struct(nll, ppl) of a mean NLL that replaces what was measured."""
    return F.struct((mean * count).alias("nll"), F.exp(mean).alias("ppl"))


def threshold_pair(prefix: tuple[str, str] = ("ref0", "ref1")) -> Column:
    """struct(floor, ceiling): mean NLLs of both anchors, or null if either can't be had."""
    floor, ceiling = (mean_nll(f"{p}_nll", f"{p}_token_count") for p in prefix)
    return F.when(floor.isNotNull() & ceiling.isNotNull(), F.struct(floor.alias("floor"), ceiling.alias("ceiling")))


def scoring_rows(df: DataFrame, prefix: str, continuation: str, most_prefix: int, most: int) -> DataFrame:
    """Rows to be scored: those with both parts, of the prefix its end and of the continuation its
    beginning."""
    p, c = F.col(prefix), F.col(continuation)
    x = df.where((F.size(p) > 0) & (F.size(c) > 0))
    return x.withColumn(
        prefix, F.slice(p, F.greatest(F.size(p) - most_prefix, F.lit(0)) + 1, most_prefix)
    ).withColumn(continuation, F.slice(c, 1, most))


def scored_back(df: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """NLL, count and perplexity of scored rows; infinity and 0 for the others."""
    inf = F.lit(float("inf"))
    out = df.join(scores.select(key, "nll", "count"), key, "left")
    ppl = F.when(F.col("count") > 0, F.exp(F.col("nll") / F.col("count"))).otherwise(inf)
    return out.withColumn("ppl", ppl).withColumns({"nll": F.coalesce("nll", inf), "count": F.coalesce("count", F.lit(0))})
