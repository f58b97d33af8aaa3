"""Reward functions and managers: how scores of responses become reward arrays.

A reward function is a column expression (text, truth, extra) -> double, or a struct with a
``score`` and more.  A manager takes rows (data_source, response_text, ground_truth,
response_length) and adds ``reward_score``, ``reward_extra_info`` and ``token_level_scores``, in
which the score stands at the last token.  All are expressions on a row: partitions are the
workers, and a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import graders as G
from quillstream.functions import masked as M
from quillstream.functions import verifiers as V
from quillstream.operators.shaping import length_penalty
from quillstream.registry import REWARD_MANAGERS, REWARDS, load_function

Reward = Callable[[Column, Column, Column | None], Column]


@REWARDS.register("exact")
def exact(text: Column, truth: Column, extra: Column | None = None) -> Column:
    return F.coalesce((F.trim(text) == truth).cast("double"), F.lit(0.0))


@REWARDS.register("hash")
def by_hash(text: Column, truth: Column, extra: Column | None = None) -> Column:
    return G.grade_hash(text, truth)


@REWARDS.register("answer_line")
def by_answer_line(text: Column, truth: Column, extra: Column | None = None) -> Column:
    return G.grade_answer_line(text, truth)


@REWARDS.register("math")
def by_box(text: Column, truth: Column, extra: Column | None = None) -> Column:
    return G.grade_math(text, truth)


def constraints(rules: list[tuple[str, dict]], coefficient: float = 1.0) -> Reward:
    """A reward function of the share of verifiers that are satisfied: its score and accuracy."""

    def score(text: Column, truth: Column, extra: Column | None = None) -> Column:
        s = V.constraint_score(text, rules)
        return F.struct((coefficient * s).alias("score"), s.alias("acc"))

    return score


def by_source(rules: dict[str, str], source: str = "data_source") -> Reward:
    """The registered function of each source; an unknown source fails the query."""

    def score(text: Column, truth: Column, extra: Column | None = None) -> Column:
        out = F.raise_error(F.concat(F.lit("no reward for "), F.col(source))).cast("double")
        for name, reward in rules.items():
            out = F.when(F.col(source) == name, score_of(REWARDS.get(reward)(text, truth, extra), False)).otherwise(out)
        return out

    return score


def custom(path: str, name: str, **bound) -> Reward:
    """A reward function of a Python file."""
    return load_function(path, name, **bound)


def score_of(result: Column, is_struct: bool) -> Column:
    return result["score"] if is_struct else result


def _is_struct(df: DataFrame, result: Column) -> bool:
    return df.select(result.alias("r")).schema["r"].dataType.typeName() == "struct"


def _scored(df: DataFrame, reward: Reward, text: Column | None = None, named: str = "acc") -> DataFrame:
    """Add _r, the raw score, and reward_extra_info, a map of what the function gave."""
    extra = F.col("extra_info") if "extra_info" in df.columns else None
    result = reward(F.col("response_text") if text is None else text, F.col("ground_truth"), extra)
    if _is_struct(df, result):
        x = df.withColumn("_s", result)
        fields = [f.name for f in x.schema["_s"].dataType.fields if f.dataType.typeName() in ("double", "boolean", "integer", "long", "float")]
        info = F.create_map(*[c for n in fields for c in (F.lit(n), F.col(f"_s.{n}").cast("double"))])
        return x.withColumns({"_r": F.col("_s.score").cast("double"), "reward_extra_info": info}).drop("_s")
    x = df.withColumn("_r", result.cast("double"))
    return x.withColumn("reward_extra_info", F.create_map(F.lit(named), F.col("_r")))


def _placed(df: DataFrame, score: Column) -> DataFrame:
    """The score as a column and, in an array of the response's length, at its last token."""
    x = df.withColumn("reward_score", score)
    return x.withColumn("token_level_scores", M.place_at_last(F.col("reward_score"), F.col("response_length").cast("int"))).drop("_r")


def existing_or(df: DataFrame, manager: Callable[[DataFrame], DataFrame], column: str = "rm_scores") -> DataFrame:
    """Rows that come with a score keep it; the manager's is for the others."""
    if column not in df.columns:
        return manager(df)
    out = manager(df)
    kept = F.coalesce(F.col(column), F.col("reward_score"))
    return out.withColumn("reward_score", kept).withColumn(
        "token_level_scores", M.place_at_last(F.col("reward_score"), F.col("response_length").cast("int"))
    )


@REWARD_MANAGERS.register("naive")
def naive(df: DataFrame, reward: Reward) -> DataFrame:
    x = _scored(df, reward)
    return _placed(x, F.col("_r"))


@REWARD_MANAGERS.register("batch")
def batch(df: DataFrame, reward: Reward) -> DataFrame:
    """As naive: an expression is evaluated on batches of rows anyway."""
    return naive(df, reward)


@REWARD_MANAGERS.register("dapo")
def overlong(df: DataFrame, reward: Reward, limit: int = 0, buffer: int = 0, factor: float = 1.0, end: str | None = None) -> DataFrame:
    """A penalty that grows over the last ``buffer`` tokens below the limit is added to the score
    and told as overlong_reward and overlong.  The end mark is no part of the text."""
    text = F.col("response_text")
    if end:
        text = F.when(F.endswith(text, F.lit(end)), F.substr(text, F.lit(1), F.length(text) - len(end))).otherwise(text)
    x = _scored(df, reward, text)
    if not buffer:
        return _placed(x, F.col("_r"))
    penalty = length_penalty(F.col("response_length"), limit, buffer, factor)
    x = x.withColumn("_p", penalty)
    told = F.create_map(F.lit("overlong_reward"), F.col("_p"), F.lit("overlong"), (F.col("_p") < 0).cast("double"))
    return _placed(x.withColumn("reward_extra_info", F.map_concat("reward_extra_info", told)), F.col("_r") + F.col("_p")).drop("_p")


@REWARD_MANAGERS.register("prime")
def tolerant(df: DataFrame, reward: Reward) -> DataFrame:
    """A response whose score can't be had counts 0."""
    x = _scored(df, reward)
    failed = F.col("_r").isNull() | F.isnan("_r")
    return _placed(x.withColumn("_r", F.when(failed, 0.0).otherwise(F.col("_r"))), F.col("_r"))


@REWARD_MANAGERS.register("gdpo")
def components(df: DataFrame, rewards: dict[str, Reward]) -> DataFrame:
    """Each component's score as a column of its own; the reward is their sum."""
    x = df
    for name, reward in rewards.items():
        x = _scored(x, reward).withColumn(f"reward_{name}", F.col("_r")).drop("_r", "reward_extra_info")
    total = sum((F.col(f"reward_{n}") for n in rewards), F.lit(0.0))
    info = F.create_map(*[c for n in rewards for c in (F.lit(n), F.col(f"reward_{n}"))])
    return _placed(x.withColumn("reward_extra_info", info), total)


@REWARD_MANAGERS.register("remote")
def fan_out(df: DataFrame, reward: Reward, workers: int) -> DataFrame:
    """Rows dealt out to workers in turn, for scores that cost more than moving a row."""
    return naive(df.repartition(workers), reward)


@REWARD_MANAGERS.register("limited")
def limited(df: DataFrame, reward: Reward, seconds: Column, timeout: float) -> DataFrame:
    """A score that took longer than the timeout, or failed, counts 0 and is told as such."""
    x = _scored(df, reward)
    late = F.coalesce(seconds > timeout, F.lit(True)) | F.col("_r").isNull()
    x = x.withColumn("reward_extra_info", F.map_concat("reward_extra_info", F.create_map(F.lit("timeout"), late.cast("double"))))
    return _placed(x.withColumn("_r", F.when(late, 0.0).otherwise(F.col("_r"))), F.col("_r"))


def extra_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The extra information as columns, missing ones null."""
    return df.select("*", *[F.col("reward_extra_info")[n].alias(n) for n in names])


def last_of_sequences(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of several sequences of one sample, the reward is that of the last."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_x")).select(key, "_x.*")
