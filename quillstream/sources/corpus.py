"""Export of two dumped batches as one corpus of scored rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.sources.scans import numbered


def valid_ids(ids: str, *masks: str) -> Column:
    """Ids where all masks are 1; a mask longer than the ids counts from its end."""
    n = F.size(ids)
    tails = [F.when(F.size(m) > n, F.slice(m, F.size(m) - n + 1, n)).otherwise(F.col(m)) for m in masks]
    ok = tails[0]
    for t in tails[1:]:
        ok = F.zip_with(ok, t, lambda a, b: F.when((a == 1) & (b == 1), 1).otherwise(0))
    return F.transform(F.filter(F.arrays_zip(F.col(ids).alias("i"), ok.alias("k")), lambda x: x["k"] == 1), lambda x: x["i"])


def first_filled(*choices: tuple[str, Column]) -> tuple[Column, Column]:
    """(value, source) of the first choice whose array is there and not empty."""
    value = F.coalesce(*[F.when(F.size(c) > 0, c) for _, c in choices])
    source = F.coalesce(*[F.when(F.size(c) > 0, F.lit(n)) for n, c in choices])
    return value, source


def export(prompts: DataFrame, generated: DataFrame) -> DataFrame:
    """Rows of both dumps by row_id: prompts (row_id, uid, ground_truth, prompt_ids, rebuilt_ids) and
    generated (row_id, responses, response_mask, attention_mask, answer_ids, response_text, score).
    A prefix is the dumped one, else the rebuilt one; a continuation the dumped final answer, else
    the valid response; each with its source.  Rows that lack either are not eligible, with why."""
    x = numbered(prompts, "uid", "row_id", "rollout_index").join(generated, "row_id")
    x = x.withColumn("response_token_ids", valid_ids("responses", "response_mask", "attention_mask"))
    prefix, prefix_from = first_filled(("dumped", F.col("prompt_ids")), ("rebuilt", F.col("rebuilt_ids")))
    answer, answer_from = first_filled(("answer", F.col("answer_ids")), ("response", F.col("response_token_ids")))
    x = x.withColumns(
        {
            "ppl_prefix_token_ids": prefix, "ppl_prefix_source": prefix_from, "ppl_continuation_token_ids": answer,
            "ppl_continuation_source": answer_from
        }
    )
    reason = F.when(F.col("ppl_prefix_token_ids").isNull(), "no prefix").when(F.col("ppl_continuation_token_ids").isNull(), "no continuation")
    return x.select(
        F.concat_ws(
            "-", "uid", F.col("rollout_index").cast("string")
        ).alias("id"), F.col("row_id").alias("row_index"), "uid", "rollout_index", "ground_truth", "response_token_ids", "response_text", F.size("response_token_ids").alias("response_token_count"), F.col("score").alias("constraint_score"),
        reason.isNull().alias("ppl_eligible"), reason.alias("ppl_ineligible_reason"), "ppl_prefix_token_ids", "ppl_continuation_token_ids", F.coalesce(F.size("ppl_prefix_token_ids"), F.lit(0)).alias("ppl_prefix_token_count"), F.coalesce(
            F.size("ppl_continuation_token_ids"), F.lit(0)
        ).alias("ppl_continuation_token_count"), "ppl_prefix_source", "ppl_continuation_source",
    )


def corpus_stats(df: DataFrame) -> DataFrame:
    """Counts, sums, least and largest lengths by the source of the prefix."""
    n = F.col("ppl_prefix_token_count")
    return df.groupBy("ppl_prefix_source").agg(
        F.count("*").alias("rows"), F.count_if("ppl_eligible").alias("eligible"), F.sum(n).alias("prefix_tokens"), F.min(n).alias("least"),
        F.max(n).alias("most"), F.sum("response_token_count").alias("response_tokens")
    )


def turn_masks(df: DataFrame, system_ids: list[int], generation_ids: list[int]) -> DataFrame:
    """Rows of messages (conv, turn, role, ids), each encoded alone: the repeated system prefix goes
    from later turns that aren't the system's, and only assistant tokens after the generation prompt
    carry loss.  Gives conv, input_ids, loss_mask."""
    s, g = len(system_ids), len(generation_ids)
    later = (F.col("turn") > 0) & (F.col("role") != "system")
    ids = F.when(later, F.slice("ids", s + 1, F.greatest(F.size("ids") - s, F.lit(0)))).otherwise(F.col("ids"))
    x = df.withColumn("_i", ids)
    mask = F.transform("_i", lambda _, i: F.when((F.col("role") == "assistant") & (i >= g), 1).otherwise(0))
    x = x.withColumn("_m", mask).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "_i", "_m"))).alias("_x"))
    return x.select(
        "conv", F.flatten(F.transform("_x", lambda e: e["_i"])).alias("input_ids"), F.flatten(F.transform("_x", lambda e: e["_m"])).alias("loss_mask")
    )
