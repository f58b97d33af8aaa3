"""Queries of files written and read back, of controllers, and of what answers hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import graders as G
from quillstream.functions import masked as M
from quillstream.functions import messages as Y
from quillstream.functions import verifiers as V
from quillstream.operators import metrics as X
from quillstream.operators import shaping as S
from quillstream.plans.base import TOK, query, r6, read, tokens
from quillstream.sources import dumps as D
from quillstream.sources import scans, sinks


@query(
    """WITH c AS (SELECT conv_id * 100 + turn AS id, role, text FROM conversations)
    SELECT 'preferences' AS kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM c
    UNION ALL SELECT 'prompts', count(*), sum(length(text))::BIGINT FROM c UNION ALL SELECT 'lines', count(*), sum(length(text))::BIGINT FROM c
    UNION ALL SELECT 'answers', count(DISTINCT id // 100), sum(length(text))::BIGINT FROM c UNION ALL SELECT 'manifest', count(*), sum(id)::BIGINT FROM c WHERE id % 3 = 0
    UNION ALL SELECT 'credentials', count(*), 0 FROM c WHERE id % 100 = 0 AND id % 500 = 0 UNION ALL SELECT 'replayed', count(*), sum(length(text))::BIGINT FROM c WHERE id % 7 = 2"""
)
def scanned_files(spark, sf):
    """Turns written as each kind of dataset, manifest and dump, and read by the scan of that kind."""
    c = read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", "text").where("text IS NOT NULL")
    at = D.scratch(spark)
    c.select(F.col("text").alias("prompt"), F.col("role").alias("chosen"), F.lit("no").alias("rejected"), "id").write.parquet(f"{at}/pairs.parquet")
    c.select("id", "text").write.json(f"{at}/lines.jsonl")
    message = F.array(F.struct("role", F.col("text").alias("content")))
    c.groupBy(F.floor(F.col("id") / 100).alias("k")).agg(F.flatten(F.collect_list(message)).alias("messages")).write.parquet(f"{at}/chats.parquet")
    c.where("id % 3 = 0").select("id").groupBy().agg(F.to_json(F.struct(F.collect_list("id").alias("indices")))).write.text(f"{at}/manifest")  # one document, as manifests are
    c.where("id % 500 = 0").select(F.concat(F.lit("key = hf_"), F.lit("a" * 24)), F.col("id").alias("k")).write.partitionBy("k").text(f"{at}/secrets")
    replay = lambda: c.where("id % 7 = 2").select("text")
    for _ in range(2):  # recorded, then replayed
        again = sinks.dump_or_replay(spark, f"{at}/steps", 3, replay)
    total = lambda df, kind, n: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("chars")).select(F.lit(kind).alias("kind"), "n", "chars")
    parts = [
        total(scans.scan_preferences(spark, f"{at}/pairs.parquet"), "preferences", F.length("prompt")), total(scans.scan(spark, f"{at}/pairs.parquet"), "prompts", F.length("prompt")),
        total(scans.scan(spark, f"{at}/lines.jsonl"), "lines", F.length("text")),
        total(scans.scan_sft(spark, f"{at}/chats.parquet").where("tools IS NULL AND enable_thinking IS NULL"), "answers", F.aggregate("messages", F.lit(0), lambda s, m: s + F.length(m["content"]))),
        total(scans.scan_manifest(spark, f"{at}/manifest"), "manifest", F.col("index")), total(scans.find_credentials(spark, f"{at}/secrets/*"), "credentials", F.lit(0)), total(again, "replayed", F.length("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(
    """WITH s AS (SELECT event_id // 50 AS step, avg(event_id % 13)::DOUBLE AS kl FROM events GROUP BY 1)
    SELECT step, 0.1::DOUBLE AS fixed, round(0.2 * exp(sum(ln(1 + greatest(-0.2, least(0.2, kl / 6.0 - 1)) * 50 / 1000)) OVER (ORDER BY step)), 6) AS adaptive FROM s"""
)
def kl_controllers(spark, sf):
    """Coefficients of a fixed and an adaptive controller over steps of events."""
    steps = read(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 50).alias("step")).agg(F.avg(F.col("event_id") % 13).alias("kl")).withColumn("n_steps", F.lit(50))
    fixed, adaptive = X.kl_controller("fixed", 0.1), X.kl_controller("adaptive", 0.2, 6.0, 1000)
    x = fixed(steps).withColumnRenamed("coefficient", "fixed")
    return adaptive(x).select("step", "fixed", r6("coefficient").alias("adaptive"))


@query(
    f"""WITH {TOK}, d AS (SELECT row_id, logp - ref_logp AS d, greatest(-20, least(20, ref_logp - logp)) AS x FROM tok)
    SELECT row_id, round(sum(d), 6) + 0.0 AS k1, round(sum(abs(d)), 6) + 0.0 AS abs, round(sum(0.5 * d * d), 6) + 0.0 AS k2, round(sum(greatest(-10, least(10, exp(x) - x - 1))), 6) + 0.0 AS k3 FROM d GROUP BY 1"""
)
def straight_through_kl(spark, sf):
    """Estimators of KL with a straight-through gradient: their values are those of the plain ones."""
    t = tokens(spark, sf, "logp", "ref_logp")
    of = lambda kind: r6(F.sum(M.kl(F.col("logp"), F.col("ref_logp"), kind)))
    return t.groupBy("row_id").agg(of("k1+").alias("k1"), of("abs+").alias("abs"), of("k2+").alias("k2"), of("k3+").alias("k3"))


@query(
    """SELECT conv_id, turn, role AS answer, text AS channel, CASE WHEN turn % 3 = 0 THEN text END AS marked, (conv_id + turn) % 2 = 0 AS strict,
      CASE WHEN (conv_id + turn) % 2 = 0 THEN 1.0::DOUBLE ELSE -1 END AS score, turn % 4 AS place,
      CASE WHEN turn % 2 = 0 AND conv_id % 3 > 0 THEN 1.25::DOUBLE WHEN turn % 2 = 0 THEN 0.0 ELSE 0.5 END AS rewarded, turn % 2 = 0 AND conv_id % 3 > 0 AS passed FROM conversations"""
)
def answers_of_turns(spark, sf):
    """What turns answer behind thoughts and channels, boxes that must be the truth itself, places of ids, a judge's bonus."""
    c = read(spark, sf, "conversations")
    i, t = F.col("conv_id"), F.col("turn")
    thought = F.concat(F.lit("<think>no</think> <|assistant|><answer>"), "role", F.lit("</answer> "))
    channel = F.concat(F.lit("x<|channel>thought y<channel|>"), "text")
    marked = F.concat(F.when(t % 3 == 0, "a</think>").otherwise("a "), F.lit("<|think|>"), F.regexp_replace("text", "</?answer>", ""))
    strict = G.grade_strict_box(F.concat(F.lit("so \\boxed{"), (i + t).cast("string"), F.lit("}")), F.when((i + t) % 2 == 0, (i + t).cast("string")).otherwise("x"))
    before = F.slice(F.array(*map(F.lit, (9, 8, 9, 9))), 1, (t % 4).cast("int"))
    place = Y.subsequence(F.concat(before, F.array(F.lit(5), F.lit(6)), F.array(F.lit(5), F.lit(6))), [5, 6])
    x = c.withColumns({"judge_score": F.when(t % 2 == 0, 9.0).otherwise(1.0), "constraint_reward": F.when(i % 3 > 0, 1.0).otherwise(0.0), "reward": F.when(t % 2 == 0, 0.0).otherwise(0.5)})
    return S.judge_bonus(x, 5.0, 0.25).select(
        "conv_id", "turn", V.final_answer(thought).alias("answer"), V.strip_thought(channel).alias("channel"), V.final_answer(marked, "</think>").alias("marked"), strict["acc"].alias("strict"), strict["score"].alias("score"),
        place.cast("long").alias("place"), F.col("reward").alias("rewarded"), "passed",
    )
