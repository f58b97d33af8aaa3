"""Distillation losses: single-sample estimators of the reverse KL, and the top-k forward KL.

Rows: row_id and arrays log_probs, teacher_log_probs and response_mask, or, for the top-k form,
the loss and the masses that the ids had in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import masked as M
from quillstream.operators import losses as L
from quillstream.registry import DISTILLATION_LOSSES, LOSSES

ESTIMATORS = ("kl", "k1", "abs", "mse", "k2", "low_var_kl", "k3")


def _estimator(kind: str):
    def loss(df: DataFrame) -> DataFrame:
        """Add ``distillation_loss``: the estimator of each token."""
        return df.withColumn("distillation_loss", F.zip_with("log_probs", "teacher_log_probs", lambda s, t: M.kl(s, t, kind)))

    return loss


for _kind in ESTIMATORS:
    DISTILLATION_LOSSES.register(_kind)(_estimator(_kind))


@DISTILLATION_LOSSES.register("forward_kl_topk")
def topk(df: DataFrame) -> DataFrame:
    """The loss of the top ids, at least 0: the two distributions over them do not sum to 1."""
    return df.withColumn("distillation_loss", F.transform("topk_loss", lambda x: F.greatest(x, F.lit(0.0))))


def clamped(values: Column | str, most: float | None) -> Column:
    v = M.col(values)
    return v if most is None else F.transform(v, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), x)))


def loss_metrics(df: DataFrame) -> DataFrame:
    """loss_min, loss_max and abs_loss over the tokens in the mask."""
    t = df.select(F.explode(F.arrays_zip(F.col("distillation_loss").alias("x"), F.col("response_mask").alias("m"))).alias("e")).where("e.m = 1")
    x = F.col("e.x")
    return t.agg(F.min(x).alias("loss_min"), F.max(x).alias("loss_max"), F.avg(F.abs(x)).alias("abs_loss"))


def overlap_metrics(df: DataFrame, k: int) -> DataFrame:
    """Share of the teacher's top k that the student has too, mean loss where any is, and masses;
    rows are tokens in the mask: overlap_count, overlap_advantage, student_mass, teacher_mass."""
    some = F.col("overlap_count") > 0
    masses = [f(c).alias(f"{c}_{n}") for c in ("student_mass", "teacher_mass") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.agg(
        (F.avg("overlap_count") / k).alias("overlap_ratio"),
        F.coalesce(F.avg(F.when(some, F.col("overlap_advantage"))), F.lit(0.0)).alias("overlap_token_advantage"), *masses
    )


def distill(df: DataFrame, kind: str, mode: str = "token-mean", most: float | None = None, policy: str | None = None, width: int = 64) -> DataFrame:
    """The aggregated loss: of the estimator, clamped to +-``most``; or, with ``policy``, of that
    policy loss with the negative estimator as advantage, from old_log_probs."""
    x = DISTILLATION_LOSSES.get(kind)(df).withColumn("_loss", clamped("distillation_loss", most))
    names = {"loss": "_loss", "mask": "response_mask"}
    if policy is not None:
        names |= {"logp": "log_probs", "old_logp": "old_log_probs"}
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in names.items()])
    t = x.select("row_id", F.posexplode(zipped).alias("t", "e")).select("row_id", "t", *[F.col(f"e.{n}").alias(n) for n in names])
    if policy is None:
        return L.agg_loss(t, "loss", mode, width)
    return L.agg_loss(LOSSES.get(policy)(t.withColumn("adv", -F.col("loss")).drop("loss")), mode=mode, factor=width)


def with_policy_terms(distillation: Column, policy: Column, use_task_rewards: bool, coefficient: float) -> Column:
    """The distillation loss alone, or added to the task's policy loss by a coefficient."""
    return policy + coefficient * distillation if use_task_rewards else distillation
