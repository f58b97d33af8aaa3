"""Advantage estimators: scores normalised within prompt groups.

Input rows: row_id, uid, token_level_rewards array<double>, response_mask array<int>; some need
more, named below.  Output: the same rows with ``advantages`` and ``returns``.  Group statistics
are window aggregates over ``uid``: one exchange, no join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.functions import masked as M
from quillstream.registry import ADVANTAGES


# windows and columns can't be made before there is a session, so these are functions
def group():
    return W.partitionBy("uid")


def score() -> Column:
    return F.col("_s")


def with_score(df: DataFrame) -> DataFrame:
    """Add ``_s``, the unmasked sum of the token rewards."""
    return df.withColumn("_s", M.array_sum("token_level_rewards"))


def spread(df: DataFrame, scalar: Column) -> DataFrame:
    """A row's scalar at each token of its mask, as advantages and returns."""
    df = df.withColumn("_a", scalar)
    out = F.transform("response_mask", lambda m: F.col("_a") * m)
    return df.withColumn("advantages", out).withColumn("returns", out).drop("_a", "_s")


def group_mean_std(x: Column, eps: float = 0.0, w=None) -> tuple[Column, Column]:
    """Mean and sample deviation over the group; a single row has mean 0 and deviation 1."""
    w = w or group()
    n = F.count(F.lit(1)).over(w)
    return F.when(n > 1, F.avg(x).over(w)).otherwise(0.0), F.when(n > 1, F.greatest(F.stddev_samp(x).over(w), F.lit(eps))).otherwise(1.0)


def whiten(df: DataFrame, column: str, mask: str = "response_mask", shift_mean: bool = True) -> DataFrame:
    """(v - mean) / sqrt(var + 1e-8) over all masked tokens of the table, times the mask.

    Tokens are aggregated by the built-in variance, whose partial results merge without a
    difference of large sums; its one row joins back by broadcast."""
    valid = F.explode(F.filter(F.zip_with(M.col(column), M.col(mask), lambda v, k: F.when(k == 1, v)), lambda v: v.isNotNull()))
    one = df.select(valid.alias("v")).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.var_pop("v").alias("var"))
    n, mean = F.col("n"), F.col("s") / (F.col("n") + M.EPS)
    gap = F.col("s") / n - mean  # the mean is over a count that is a little more
    var = F.when(n > 1, (F.col("var") + gap * gap) * n / (n + M.EPS) * n / (n - 1))
    one = one.select(F.coalesce(mean, F.lit(0.0)).alias("_mean"), F.coalesce(var, F.lit(0.0)).alias("_var"))
    out = F.zip_with(
        M.col(column), M.col(mask),
        lambda v, k: ((v - F.col("_mean")) / F.sqrt(F.col("_var") + M.EPS) + (F.lit(0.0) if shift_mean else F.col("_mean"))) * k
    )
    return df.join(F.broadcast(one)).withColumn(column, out).drop("_mean", "_var")


@ADVANTAGES.register("grpo")
def grpo(df: DataFrame, norm_by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    df = with_score(df)
    mean, std = group_mean_std(score())
    return spread(df, (score() - mean) / (std + eps) if norm_by_std else score() - mean)


@ADVANTAGES.register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, norm_by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    return grpo(df, norm_by_std, eps)


@ADVANTAGES.register("gdpo")
def gdpo(df: DataFrame, components: list[str], weights: list[float] | None = None, eps: float = 1e-6) -> DataFrame:
    """Each score column normalised as in grpo; their weighted sum, whitened over all tokens."""
    total = F.lit(0.0)
    for c, w in zip(components, weights or [1.0] * len(components)):
        mean, std = group_mean_std(F.col(c).cast("double"))
        total = total + w * (F.col(c) - mean) / (std + eps)
    out = whiten(spread(with_score(df), total), "advantages")
    return out.withColumn("returns", F.col("advantages"))


@ADVANTAGES.register("grpo_passk")
def grpo_passk(df: DataFrame, norm_by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """Only a group's best row, the earliest of equals, has an advantage: its lead over the next."""
    df = with_score(df)
    by = group().orderBy(F.desc("_s"), "row_id")
    gap = score() - F.lead("_s").over(by)
    if norm_by_std:
        gap = gap / (F.stddev_samp("_s").over(group()) + eps)
    guard = F.when(F.count(F.lit(1)).over(group()) < 2, F.raise_error(F.lit("a group has fewer than two rows")))
    return spread(df, F.when(guard.isNotNull(), F.lit(None).cast("double")).when(F.row_number().over(by) == 1, gap).otherwise(0.0))


@ADVANTAGES.register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame) -> DataFrame:
    df = with_score(df)
    mean, _ = group_mean_std(score())
    out = whiten(spread(df, score() - mean), "advantages")
    return out.withColumn("returns", F.col("advantages"))


def _leave_one_out(single: Column) -> Column:
    n = F.count(F.lit(1)).over(group())
    return F.when(n > 1, (n * score() - F.sum(score()).over(group())) / (n - 1)).otherwise(single)


@ADVANTAGES.register("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """A group of one keeps its score."""
    return spread(with_score(df), _leave_one_out(score()))


@ADVANTAGES.register("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """A group of one has 0."""
    return spread(with_score(df), _leave_one_out(F.lit(0.0)))


@ADVANTAGES.register("opo")
def opo(df: DataFrame) -> DataFrame:
    """Score less the length-weighted mean of the group; a group of one keeps its score."""
    df = with_score(df).withColumn("_len", M.mask_count("response_mask"))
    n = F.count(F.lit(1)).over(group())
    base = F.try_divide(F.sum(F.col("_len") * score()).over(group()), F.sum("_len").over(group()).cast("double"))
    return spread(df, F.when(n > 1, score() - base).otherwise(score())).drop("_len")


@ADVANTAGES.register("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    df = df.withColumn("returns", M.discounted_returns("token_level_rewards", "response_mask", gamma)).withColumn("advantages", F.col("returns"))
    return whiten(df, "advantages")


@ADVANTAGES.register("remax")
def remax(df: DataFrame) -> DataFrame:
    """Needs ``reward_baselines``, the score of the greedy answer."""
    out = df.withColumn("returns", M.reverse_cumsum(M.masked("token_level_rewards", "response_mask")))
    return out.withColumn("advantages", F.zip_with("returns", "response_mask", lambda r, m: r - F.col("reward_baselines") * m))


@ADVANTAGES.register("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha (s - mean) / f_norm; alpha is rows over rows with a score, of the whole table."""
    df = with_score(df)
    one = df.agg((F.count("*") / F.greatest(F.lit(1), F.count_if(score() != 0))).alias("_alpha"))
    mean, _ = group_mean_std(score())
    return spread(df.join(F.broadcast(one)), F.col("_alpha") * (score() - mean) / f_norm).drop("_alpha")


@ADVANTAGES.register("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Needs ``values``.  Masked steps carry the state through; advantages are whitened."""
    df = df.withColumn("advantages", M.gae("token_level_rewards", "values", "response_mask", gamma, lam))
    df = df.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v))
    return whiten(df, "advantages")


def token_baseline(tokens: DataFrame, rows: DataFrame, compact: bool = False) -> DataFrame:
    """Long form: tokens (row_id, uid, t, r, m, old_logp, q) and rollouts (row_id, uid), some of
    which may have no tokens, give (row_id, t, advantage, return).

    The baseline of a (uid, place) is weighted by the cumulative weight of tokens.  Windows run
    over one row's tokens, and the group's sums over (uid, place), so neither needs a whole prompt
    in one task's memory.
    """
    row = W.partitionBy("row_id").orderBy("t")
    before, later = row.rowsBetween(W.unboundedPreceding, 0), row.rowsBetween(0, W.unboundedFollowing)
    m = F.col("m")
    x = tokens.select(
        "row_id", "uid", "t", "m", F.sum(F.col("r") * m).over(later).alias("g"), F.sum(
            (1 - 2 * F.exp("old_logp") + F.col("q")) * m
        ).over(before).alias("w"),
        (F.sum("m").over(before) - 1 if compact else F.col("t")).alias("place"),
    )
    x = x.where("m = 1") if compact else x
    at = W.partitionBy("uid", "place")
    base = F.sum(F.col("g") * F.col("w") * m).over(at) / (F.sum(F.col("w") * m).over(at) + M.EPS)
    lengths = rows.select("row_id", "uid").join(tokens.groupBy("row_id").agg(F.sum("m").alias("len")), "row_id", "left")
    lengths = lengths.select("uid", "row_id", F.coalesce("len", F.lit(0)).alias("len")).where("len > 0" if compact else "true")
    top = F.sort_array(F.collect_list("len"), asc=False)  # a prompt's rollouts are few
    groups = lengths.groupBy("uid").agg(F.count("*").alias("n"), F.try_element_at(top, F.lit(2)).alias("second"))
    x = x.withColumn("base", base).join(groups, "uid")
    # a single row has no baseline; of the one longest row, what no other reaches has none
    alone = (F.col("n") < 2) | (F.col("place") >= F.col("second"))
    return x.select(
        "row_id", "t", F.when(alone, 0.0).otherwise((F.col("g") - F.col("base")) * m).alias("advantage"), (F.col("g") * m).alias("return")
    )


def _token_baseline(df: DataFrame, compact: bool) -> DataFrame:
    """The same on rows of arrays, scattered back to the places of the tokens."""
    x = df.select(
        "row_id", "uid", F.posexplode(F.arrays_zip("token_level_rewards", "response_mask", "old_log_probs", "sum_pi_squared")).alias("t", "x")
    )
    x = x.select(
        "row_id", "uid", "t", F.col("x.token_level_rewards").alias("r"), F.col("x.response_mask").alias("m"),
        F.col("x.old_log_probs").alias("old_logp"), F.col("x.sum_pi_squared").alias("q")
    )
    made = token_baseline(x, df, compact).groupBy("row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("t", F.struct(F.col("advantage").alias("a"), F.col("return").alias("g"))))).alias("_at")
    )
    out = df.join(made, "row_id", "left")
    pick = lambda f: F.transform("response_mask", lambda _, i: F.coalesce(F.try_element_at(F.col("_at"), i)[f], F.lit(0.0)))
    return out.withColumn("advantages", pick("a")).withColumn("returns", pick("g")).drop("_at")


@ADVANTAGES.register("optimal_token_baseline")
def optimal_token_baseline(df: DataFrame) -> DataFrame:
    return _token_baseline(df, compact=False)


@ADVANTAGES.register("tir_optimal_token_baseline")
def tir_optimal_token_baseline(df: DataFrame) -> DataFrame:
    """The same over valid tokens only, scattered back; rows without any are left out."""
    return _token_baseline(df, compact=True)


def last_turn_advantage(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Rows: uid, session, turn, score.  Only a session's last turn enters the group's statistics;
    its advantage goes to all turns of the session."""
    session = W.partitionBy("uid", "session")
    last = F.col("turn") == F.max("turn").over(session)
    df = df.withColumn("_x", F.when(last, F.col("score").cast("double")))
    n = F.count("_x").over(group())
    mean, std = F.when(n > 1, F.avg("_x").over(group())).otherwise(0.0), F.when(n > 1, F.stddev_samp("_x").over(group())).otherwise(1.0)
    df = df.withColumn("_a", (F.col("_x") - mean) / (std + eps))
    return df.withColumn("advantage", F.max("_a").over(session)).drop("_x", "_a")


def kl_in_reward(df: DataFrame, beta: float, kind: str = "kl") -> DataFrame:
    """Rewards less beta times the KL of each masked token, and the row's masked mean of it."""
    d = M.zip3("old_log_probs", "ref_log_prob", "response_mask", lambda a, b, m: M.kl(a, b, kind) * m)
    df = df.withColumn("kl", d)
    return df.withColumn(
        "token_level_rewards", F.zip_with("token_level_scores", "kl", lambda s, k: s - beta * k)
    ).withColumn("mean_kl", M.masked_mean("kl", "response_mask"))


def compute(df: DataFrame, estimator: str, **options) -> DataFrame:
    return ADVANTAGES.get(estimator)(df, **options)
