"""Queries of work estimates, roll-ups and corpus export."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import flops as W
from quillstream.operators import rollups as R
from quillstream.plans.base import query, r6, read
from quillstream.sources import corpus as C

MODEL = W.Model(linear=7_000_000_000, pair=16_384, head=300_000_000, full_layers=20, sliding_layers=8, window=128)


@query(
    """WITH x AS (SELECT doc_id, n_chars::HUGEINT AS n, least(n_chars, 128)::HUGEINT AS c FROM documents)
    SELECT doc_id, CAST(n * 7300000000 + (n * (n + 1) // 2 * 20 + (c * (c + 1) // 2 + (n - c) * 128) * 8) * 16384 AS VARCHAR) AS flops FROM x"""
)
def perplexity_flops(spark, sf):
    return read(spark, sf, "documents").select("doc_id", W.perplexity_flops(MODEL, F.col("n_chars")).cast("string").alias("flops"))


@query(
    """WITH x AS (SELECT o_orderkey AS row_id, (o_orderkey % 500)::HUGEINT AS p, (o_custkey % 90)::HUGEINT AS k, (o_orderkey % 500 // 2)::HUGEINT AS s
    FROM orders), y AS (SELECT *, greatest(k - 1, 0) AS d, p + greatest(k - 1, 0) AS e FROM x)
  SELECT row_id, CAST((e - s) * 7000000000 + k * 300000000 + ((e * (e + 1) // 2 - s * (s + 1) // 2) * 20 + ((least(e, 128) * (least(e,
    128) + 1) // 2 + (e - least(e, 128)) * 128) - (least(s, 128) * (least(s, 128) + 1) // 2 + (s - least(s,
    128)) * 128)) * 8) * 16384 AS VARCHAR) AS flops FROM y"""
)
def generation_flops(spark, sf):
    p = F.col("o_orderkey") % 500
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), W.generation_flops(MODEL, p, F.col("o_custkey") % 90, F.floor(p / 2)).cast("string").alias("flops")
    )


@query(
    """WITH x AS (SELECT l_partkey % 9 AS d, l_partkey % 9 * (l_suppkey % 2) AS a, l_suppkey % 5 AS v FROM lineitem)
    SELECT round(avg(CASE WHEN d > 0 THEN a / d ELSE 0 END), 6) AS accept_rate, round(avg(CASE WHEN v > 0 THEN 1 + a / v ELSE 0 END),
    6) AS accept_length FROM x"""
)
def speculation(spark, sf):
    d = F.col("l_partkey") % 9
    x = read(spark, sf, "lineitem").select(
        d.alias("drafts"), (d * (F.col("l_suppkey") % 2)).alias("accepts"), (F.col("l_suppkey") % 5).alias("verifies")
    )
    return R.speculation(x).select(r6("accept_rate").alias("accept_rate"), r6("accept_length").alias("accept_length"))


@query(
    """WITH x AS (SELECT value > 20 AS called, value > 10 AS eligible, CASE WHEN event_id % 7 = 0 THEN CAST('Infinity' AS DOUBLE)
    ELSE CAST(event_id % 11 AS DOUBLE) END AS score, event_id % 3 = 0 AS passed, CAST(event_id % 2 AS DOUBLE) / 4 AS bonus,
    CASE WHEN event_id % 13 = 0 THEN 'e' ELSE ' ' END AS error FROM events)
  SELECT count(*) FILTER (WHERE called) AS called_count, round(avg(CASE WHEN eligible THEN 1.0 ELSE 0 END), 6) AS eligible_ratio,
    round(avg(score) FILTER (WHERE called AND isfinite(score) AND score >= 1), 6) AS score_mean,
    max(score) FILTER (WHERE called AND isfinite(score)) AS score_max, round(avg(CASE WHEN passed THEN 1.0 ELSE 0 END) FILTER (WHERE called),
    6) AS pass_rate,
   round(avg(bonus), 6) AS bonus_mean, round(avg(CASE WHEN trim(error) <> '' THEN 1.0 ELSE 0 END) FILTER (WHERE called), 6) AS error_rate FROM x"""
)
def judging(spark, sf):
    i = F.col("event_id")
    x = read(spark, sf, "events").select(
        (F.col("value") > 20).alias("called"), (F.col("value") > 10).alias("eligible"),
        F.when(i % 7 == 0, float("inf")).otherwise((i % 11).cast("double")).alias("score"), (i % 3 == 0).alias("passed"),
        ((i % 2) / 4.0).alias("bonus"), F.when(i % 13 == 0, "e").otherwise(" ").alias("error")
    )
    return R.judging(x).select(
        "called_count", "score_max", *[r6(c).alias(c) for c in ("eligible_ratio", "score_mean", "pass_rate", "bonus_mean", "error_rate")]
    )


@query(
    """WITH x AS (SELECT event_id, value AS g, event_id % 5 AS t, event_id % 3 AS s FROM events), w AS (SELECT event_id, g FROM x
    ORDER BY g + t + s DESC, event_id LIMIT 1)
  SELECT round(min(x.g), 6) AS generate_min, round(max(x.g), 6) AS generate_max, round(avg(x.t), 6) AS tools_mean,
    any_value(w.event_id) AS slowest_prompt_length, round(any_value(w.g), 6) AS slowest_generate FROM x, w"""
)
def agent_loops(spark, sf):
    i = F.col("event_id")
    x = read(spark, sf, "events").select(
        i.alias("row_id"), F.col("value").alias("generate"), (i % 5).alias("tools"), (i % 3).alias("score"), F.lit(0).alias("preempted"),
        i.alias("prompt_length"), i.alias("response_length")
    )
    return R.agent_loops(x).select(
        r6("generate_min").alias("generate_min"), r6("generate_max").alias("generate_max"), r6("tools_mean").alias("tools_mean"),
        "slowest_prompt_length", r6("slowest_generate").alias("slowest_generate")
    )


@query(
    """WITH x AS (SELECT o_orderkey AS row_id, o_custkey AS uid, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderkey) - 1 AS k, o_orderkey % 3 AS p, o_orderkey % 4 AS n FROM orders)
  SELECT row_id AS row_index, uid || '-' || k AS id, CASE WHEN p > 0 THEN 'dumped' WHEN n > 1 THEN 'rebuilt' END AS ppl_prefix_source,
    CAST(CASE WHEN p > 0 THEN p WHEN n > 1 THEN n - 1 ELSE 0 END AS INTEGER) AS ppl_prefix_token_count, CAST(n AS INTEGER) AS response_token_count,
    CASE WHEN p = 0 AND n < 2 THEN 'no prefix' WHEN n = 0 THEN 'no continuation' END AS ppl_ineligible_reason FROM x"""
)
def corpus_export(spark, sf):
    i = F.col("o_orderkey")
    run = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))
    ones = lambda n: F.transform(run(n), lambda _: F.lit(1))
    o = read(spark, sf, "orders")
    prompts = o.select(
        i.alias("row_id"), F.col("o_custkey").cast("string").alias("uid"), F.lit("").alias("ground_truth"), run(i % 3).alias("prompt_ids"),
        run(i % 4 - 1).alias("rebuilt_ids")
    )
    made = o.select(
        i.alias("row_id"), run(i % 4 + 2).alias("responses"),
        F.transform(run(i % 4 + 2), lambda x: F.when(x <= i % 4, 1).otherwise(0)).alias("response_mask"), ones(i % 4 + 9).alias("attention_mask"),
        F.lit(None).cast("array<bigint>").alias("answer_ids"), F.lit("").alias("response_text"), F.lit(0.0).alias("score")
    )
    return C.export(prompts, made).select(
        "row_index", "id", "ppl_prefix_source", "ppl_prefix_token_count", "response_token_count", "ppl_ineligible_reason"
    )


@query(
    """WITH x AS (SELECT conv_id, turn, role, CASE WHEN turn > 0 AND role <> 'system' THEN greatest(length(text) % 9 + 3 - 2,
    0) ELSE length(text) % 9 + 3 END AS n FROM conversations)
  SELECT conv_id AS conv, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN greatest(n - 1,
    0) ELSE 0 END) AS BIGINT) AS loss FROM x GROUP BY 1"""
)
def turn_masks(spark, sf):
    c = read(spark, sf, "conversations").select(
        F.col("conv_id").alias("conv"), "turn", "role", F.sequence(F.lit(1), F.length("text") % 9 + 3).alias("ids")
    )
    return C.turn_masks(c, [1, 2], [9]).select(
        "conv", F.size("input_ids").cast("long").alias("tokens"), F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("loss")
    )
