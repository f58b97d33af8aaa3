"""Agent rollouts: sessions of prompts, states, outputs of fixed width, scores of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import jagged as J
from quillstream.functions import masked as M

STATES = ("pending", "generating", "processing_tools", "interacting", "terminated")


def expanded(df: DataFrame, sessions: int, turns: Column, uid: str = "uid", agent: str | None = None) -> DataFrame:
    """One row for each session and turn of a prompt, with key ``uid_session_turn``."""
    x = df.withColumn("session", F.explode(F.sequence(F.lit(0), F.lit(sessions - 1))))
    x = x.withColumn("turn", F.explode(F.sequence(F.lit(0), (turns - 1).cast("int"))))
    key = F.concat_ws("_", F.col(uid).cast("string"), F.col("session").cast("string"), F.col("turn").cast("string"))
    x = x.withColumn("key", key)
    return x.withColumn("agent_name", F.lit(agent)) if agent else x


def final_state(events: Column) -> Column:
    """Replay of an agent's events (started, call, answer, tool, reply, limit): the state it ends in.
    What a state does not know leaves it as it is; a limit, or an answer, ends all."""

    def step(state, e):
        return (
            F.when(state == "terminated", state)
            .when(e == "limit", "terminated")
            .when((state == "pending") & (e == "started"), "generating")
            .when((state == "generating") & (e == "call"), "processing_tools")
            .when((state == "generating") & (e == "question"), "interacting")
            .when((state == "generating") & (e == "answer"), "terminated")
            .when((state == "processing_tools") & (e == "tool"), "generating")
            .when((state == "interacting") & (e == "reply"), "generating")
            .otherwise(state)
        )

    return F.aggregate(events, F.lit("pending"), step)


def with_tool_reply(ids: Column, mask: Column, reply: Column) -> tuple[Column, Column]:
    """Ids and loss mask once a tool's reply is appended: nobody is trained on it."""
    return F.concat(ids, reply), F.concat(mask, F.array_repeat(F.lit(0), F.size(reply)))


def position_ids(mask: Column) -> Column:
    """0-based places of valid tokens; 0 where the mask is 0."""
    return F.transform(mask, lambda m, i: F.when(m == 1, M.mask_count(F.slice(mask, 1, i + 1)) - 1).otherwise(F.lit(0).cast("long")))


def fixed_width(df: DataFrame, prompt: str, response: str, prompt_width: int, width: int, score: str) -> DataFrame:
    """Agent outputs as columns of one width: the prompt padded on the left, the response on the
    right, masks and places over both, the score at the response's last token."""
    p, r = F.col(prompt), F.slice(F.col(response), 1, width)
    ids = F.concat(J.pad_left(p, prompt_width, 0), M.pad_right(r, width, 0))
    kept = F.least(F.size(p), F.lit(prompt_width))
    mask = F.concat(J.pad_left(J.ones(kept), prompt_width, 0), M.pad_right(J.ones(F.size(r)), width, 0))
    x = df.withColumns({"input_ids": ids, "attention_mask": mask})
    last = F.size(r) - 1
    return x.withColumns(
        {
            "position_ids": position_ids(F.col("attention_mask")),
            "rm_scores": F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == last, F.col(score)).otherwise(0.0))
        }
    )


def timings(df: DataFrame, key: str, metrics: str) -> DataFrame:
    """(key, name, position, value) of a row's list of named times."""
    return df.select(key, F.posexplode(metrics).alias("position", "m")).select(
        key, F.col("m.name").alias("name"), "position", F.col("m.value").alias("value")
    )


def token_nll(log_probs: Column, labels: Column, ignore: int = -100) -> Column:
    """struct(nll, count, ppl) over the labels that are not to be ignored; infinite without any. A null log probability
    counts and adds nothing, as in SQL; where all are null, so is ppl."""
    kept = F.filter(F.arrays_zip(log_probs.alias("p"), labels.alias("y")), lambda x: x["y"] != ignore)
    known = F.filter(F.transform(kept, lambda x: x["p"]), F.isnotnull)
    n, nll = F.size(kept), -M.array_sum(known)
    ppl = F.when(n == 0, float("inf")).when(F.size(known) > 0, F.exp(nll / n))
    return F.struct(nll.alias("nll"), n.cast("long").alias("count"), ppl.alias("ppl"))


def rescored(items: DataFrame, prefixes: DataFrame, key: str = "index") -> DataFrame:
    """Cached items with the prefixes they are scored behind; an item without one is an error."""
    out = items.join(prefixes.withColumn("_there", F.lit(True)), key, "left")
    return out.withColumn(
        key, F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.lit("an item has no prefix")).cast("long"))
    ).drop("_there")


def filled(cache: DataFrame, wanted: DataFrame, make, key: str = "index") -> DataFrame:
    """The cache and, for wanted keys it lacks, what ``make`` gives for them alone."""
    return cache.unionByName(make(wanted.join(cache, key, "left_anti")))


def checked_ids(ids: Column, vocabulary: int) -> Column:
    """Token ids, none missing, negative or too large; else the query fails."""
    bad = ids.isNull() | F.exists(ids, lambda x: x.isNull() | (x < 0) | (x >= vocabulary))
    return F.when(bad, F.raise_error(F.lit("malformed token ids")).cast("array<long>")).otherwise(ids)


def with_empty_scores(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Infinity, 0 and false where a row has no scores."""
    inf = F.lit(float("inf"))
    kinds = {"nll": inf, "ppl": inf, "token_count": F.lit(0), "hit": F.lit(False)}
    return df.withColumns({f"{p}_{k}": F.coalesce(F.col(f"{p}_{k}"), v) for p in prefixes for k, v in kinds.items() if f"{p}_{k}" in df.columns})


def distributed_moments(df: DataFrame, value: str, mask: str | None = None) -> DataFrame:
    """Mean, least, largest and deviation over all partitions: partial results merge in one row."""
    x = F.col(value) if mask is None else F.when(F.col(mask) == 1, F.col(value))
    return df.agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_samp(x).alias("std"))
