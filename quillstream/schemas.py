"""Schemas of the tables that operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
SAMPLE = T.StructType([
    T.StructField("data_source", T.StringType()),
    T.StructField("prompt", MESSAGES),
    T.StructField("ability", T.StringType()),
    T.StructField("reward_model", T.StructType([T.StructField("style", T.StringType()), T.StructField("ground_truth", T.StringType())])),
    T.StructField(
        "extra_info",
        T.StructType(
            [
                T.StructField("index", T.LongType()), T.StructField("key", T.StringType()), T.StructField("constraint", T.StringType()),
                T.StructField("constraint_type", T.StringType())
            ]
        )
    ),
])
SFT = T.StructType(
    [T.StructField("messages", MESSAGES), T.StructField("tools", T.ArrayType(T.StringType())), T.StructField("enable_thinking", T.BooleanType())]
)
PREFERENCE = T.StructType([T.StructField(c, T.StringType()) for c in ("prompt", "chosen", "rejected")])
EVALUATION = T.StructType(
    [
        T.StructField("data_source", T.StringType()), T.StructField("responses", T.ArrayType(T.StringType())),
        T.StructField("reward_model", T.StructType([T.StructField("ground_truth", T.StringType())]))
    ]
)
_DOUBLES = (
    "token_level_scores", "token_level_rewards", "values", "old_log_probs", "rollout_log_probs", "ref_log_prob", "advantages", "returns",
    "sum_pi_squared"
)
TOKENS_WIDE = T.StructType(
    [
        T.StructField("row_id", T.LongType()), T.StructField("uid", T.StringType()), T.StructField("responses", T.ArrayType(T.LongType())),
        T.StructField("response_mask", T.ArrayType(T.IntegerType())), T.StructField("attention_mask", T.ArrayType(T.IntegerType()))
    ] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in _DOUBLES]
)
ANCHOR_ITEM = T.StructType(
    [T.StructField("index", T.LongType()), T.StructField("y0", T.ArrayType(T.LongType())), T.StructField("y1", T.ArrayType(T.LongType()))] + [
        T.StructField(f"ref{k}_{c}", t) for k in (0, 1) for c,
        t in (("nll", T.DoubleType()), ("token_count", T.IntegerType()), ("ppl", T.DoubleType()))
    ]
)
METRIC_LONG = T.StructType(
    [
        T.StructField("name", T.StringType()), T.StructField("aggregation", T.StringType()), T.StructField("rank", T.IntegerType()),
        T.StructField("pos", T.IntegerType()), T.StructField("value", T.DoubleType())
    ]
)
VALIDATION = T.StructType(
    [
        T.StructField("data_source", T.StringType()), T.StructField("uid", T.StringType()), T.StructField("var_name", T.StringType()),
        T.StructField("pos", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("pred", T.StringType())
    ]
)
QUEUE = T.StructType(
    [
        T.StructField("sample_id", T.StringType()), T.StructField("epoch", T.IntegerType()), T.StructField("produced_at", T.LongType()),
        T.StructField("param_version", T.IntegerType())
    ]
)
