"""Queries of agent rollouts, token scores, caches, and what is summed up over partitions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.functions import masked as M
from quillstream.functions import tables as T
from quillstream.operators import agents as A
from quillstream.operators import metrics as X
from quillstream.plans.base import TOK, query, r6, read, tokens
from quillstream.plans.streams import drained
from quillstream.sources import dumps as D
from quillstream.sources import files


@query(
    """SELECT CAST(s AS INTEGER) AS session, CAST(t AS INTEGER) AS turn, doc_id || '_' || s || '_' || t AS key, 'tool' AS agent_name
    FROM documents, range(2) AS a(s), range(3) AS b(t) WHERE t <= doc_id % 3"""
)
def expanded_sessions(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("uid"))
    return A.expanded(d, 2, F.col("uid") % 3 + 1, agent="tool").select("session", "turn", "key", "agent_name")


@query(
    """SELECT CAST(s AS INTEGER) AS session, CAST(t AS INTEGER) AS turn, doc_id || '_' || s || '_' || t AS key
    FROM documents, range(2) AS a(s), range(3) AS b(t) WHERE t <= doc_id % 3"""
)
def lateral_sessions(spark, sf):
    """Sessions and turns by a table function in SQL, joined laterally."""
    T.register(spark)
    sql = "SELECT x.session, x.turn, x.key FROM {d} AS d, LATERAL session_turns(CAST(d.doc_id AS STRING), 2, CAST(d.doc_id % 3 + 1 AS INT)) AS x"
    return spark.sql(sql, d=read(spark, sf, "documents").select("doc_id"))


@query(
    """WITH x AS (SELECT *, row_number() OVER w - 1 AS position, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, lag(role) OVER w AS follows
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    g AS (SELECT *, sum(CASE WHEN role = follows THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM x)
    SELECT conv_id, turn, role, position::INT AS position, ahead::BIGINT AS ahead, follows, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn)::INT AS run FROM g"""
)
def turn_positions(spark, sf):
    """What the order of turns tells, by a table function that takes and gives tables."""
    T.register(spark)
    sql = "SELECT conv_id, turn, role, position, ahead, follows, run FROM turn_positions(TABLE(SELECT * FROM {c}), 'conv_id', 'turn')"
    return spark.sql(sql, c=read(spark, sf, "conversations"))


@query("SELECT conv_id % 5 AS step, count(*) AS n, sum(length(text))::BIGINT AS chars, count(*) FILTER (conv_id % 5 >= 3) AS later FROM conversations GROUP BY 1")
def dumped_rollouts(spark, sf):
    """Turns dumped by step through the data source, read back whole, by step, and as a stream."""
    c = read(spark, sf, "conversations").select(F.col("text").alias("input"), F.col("role").alias("output"), F.lit("").alias("gts"), F.lit(0.0).alias("score"), (F.col("conv_id") % 5).alias("step"))
    path = D.scratch(spark)
    D.write_dump(c, path)
    later = D.read_dump(spark, path).where("step >= 3").groupBy(F.col("step").alias("s")).agg(F.count("*").alias("later"))
    streamed = drained(D.stream_dump(spark, path), "append").groupBy("step").agg(F.count("*").alias("n"), F.sum(F.length("input")).alias("chars"))
    return streamed.join(later, F.col("step") == F.col("s"), "left").select("step", "n", "chars", F.coalesce("later", F.lit(0)).alias("later"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'terminated' WHEN 1 THEN 'processing_tools' WHEN 2 THEN 'generating' WHEN 3 THEN 'pending'
    ELSE 'interacting' END AS state, 3 + doc_id % 4 AS tokens, 3::BIGINT AS trained,
    CASE WHEN doc_id % 4 = 0 THEN 0::BIGINT ELSE 1 END AS last_one FROM documents"""
)
def agent_states(spark, sf):
    """Replayed states, and tool replies that are not trained on."""
    i = F.col("doc_id")
    runs = [
        ("started", "call", "tool", "answer", "call"), ("started", "tool", "call"), ("started", "call", "tool"), ("call", "tool"),
        ("started", "question")
    ]
    events = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in runs]), (i % 5 + 1).cast("int"))
    reply = F.when(i % 4 > 0, F.array_repeat(F.lit(7), (i % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    ids, mask = A.with_tool_reply(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (1, 1, 1))), reply)
    x = read(spark, sf, "documents").select("doc_id", A.final_state(events).alias("state"), ids.alias("ids"), mask.alias("mask"))
    return x.select(
        "doc_id", "state", F.size("ids").cast("long").alias("tokens"), M.mask_count("mask").alias("trained"),
        F.when(F.element_at("mask", -1) == 0, 1).otherwise(0).cast("long").alias("last_one")
    )


@query(
    """WITH x AS (SELECT doc_id, doc_id % 6 + 1 AS p, doc_id % 5 + 1 AS r FROM documents), y AS (SELECT *, least(p, 4) AS a, least(r, 4) AS b FROM x)
    SELECT doc_id, 8 AS width, a + b AS attended, a + b - 1 AS last_place, CAST((4 - a + 1 + 4) * a / 2 + (5 + 4 + b) * b / 2 AS BIGINT) AS mask_dot,
    round(b * 0.5, 6)::DOUBLE AS score_dot FROM y"""
)
def agent_outputs(spark, sf):
    """Prompts and responses in columns of one width, with masks, places and the score."""
    i = F.col("doc_id")
    x = read(spark, sf, "documents").select(
        "doc_id", F.sequence(F.lit(1), (i % 6 + 1).cast("int")).alias("p"), F.sequence(F.lit(1), (i % 5 + 1).cast("int")).alias("r"),
        F.lit(0.5).alias("s")
    )
    y = A.fixed_width(x, "p", "r", 4, 4, "s")
    dot = lambda a: M.array_sum(F.transform(a, lambda v, k: v * (k + 1.0)))
    # a response that is cut has its score at the last place that is left
    return y.select(
        "doc_id", F.size("input_ids").alias("width"), M.mask_count("attention_mask").alias("attended"),
        F.array_max("position_ids").alias("last_place"), dot("attention_mask").cast("long").alias("mask_dot"), r6(dot("rm_scores")).alias("score_dot")
    )


@query("SELECT event_id, 'step' AS name, CAST(k AS INTEGER) AS position, round(value + k, 4) AS value FROM events, range(2) AS r(k)")
def sample_timings(spark, sf):
    e = read(spark, sf, "events").select(
        "event_id",
        F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.struct(F.lit("step").alias("name"), (F.col("value") + k).alias("value"))).alias("m")
    )
    return A.timings(e, "event_id", "m").select("event_id", "name", "position", r6("value", 4).alias("value"))


@query(
    f"""WITH {TOK}, g AS (SELECT row_id, -sum(logp) FILTER (WHERE m = 1) AS nll, count(*) FILTER (WHERE m = 1) AS n FROM tok GROUP BY 1)
    SELECT row_id, round(coalesce(nll, 0), 6) + 0.0 AS nll, n AS count, round(CASE WHEN n > 0 THEN exp(nll / n) ELSE 'inf'::DOUBLE END, 5) AS ppl
    FROM g"""
)
def batch_nll(spark, sf):
    """Negative log likelihood of the labels that count, their number, and the perplexity."""
    t = tokens(spark, sf, "logp", "m")
    x = t.groupBy("row_id").agg(F.collect_list(F.struct("logp", F.when(F.col("m") == 1, 5).otherwise(-100).alias("y"))).alias("x"))
    s = A.token_nll(F.transform("x", lambda e: e["logp"]), F.transform("x", lambda e: e["y"]))
    return x.select("row_id", s.alias("s")).select("row_id", r6("s.nll").alias("nll"), F.col("s.count").alias("count"), r6("s.ppl", 5).alias("ppl"))


@query(
    """SELECT doc_id AS "index", CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS origin, CASE WHEN doc_id % 3 = 0 THEN 2.5::DOUBLE
    ELSE 'inf'::DOUBLE END AS a_nll, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END AS a_token_count, doc_id % 3 = 0 AS a_hit, 3::BIGINT AS prefix
    FROM documents"""
)
def filled_cache(spark, sf):
    """A cache filled where it lacks rows, with defaults for what has no scores, and prefixes by key."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("index"))
    cache = d.where(F.col("index") % 3 == 0).select(
        "index", F.lit(1).alias("origin"), F.lit(2.5).alias("a_nll"), F.lit(4).alias("a_token_count"), F.lit(True).alias("a_hit")
    )
    null = lambda kind: F.lit(None).cast(kind)
    made = A.filled(
        cache, d,
        lambda missing: missing.select(
            "index", F.lit(2).alias("origin"), null("double").alias("a_nll"), null("int").alias("a_token_count"), null("boolean").alias("a_hit")
        )
    )
    prefixes = d.select("index", A.checked_ids(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)]), 10).alias("prefix"))
    x = A.rescored(A.with_empty_scores(made, ["a"]), prefixes)
    return x.withColumn("prefix", F.size("prefix").cast("long"))


@query(
    """SELECT round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std,
    round(avg(value) FILTER (WHERE event_id % 3 = 0), 6) AS masked_mean FROM events"""
)
def distributed_moments(spark, sf):
    e = read(spark, sf, "events").withColumn("m", F.when(F.col("event_id") % 3 == 0, 1).otherwise(0))
    both = A.distributed_moments(e, "value").join(F.broadcast(A.distributed_moments(e, "value", "m").select(F.col("mean").alias("masked_mean"))))
    return both.select(r6("mean").alias("mean"), "min", "max", r6("std").alias("std"), r6("masked_mean").alias("masked_mean"))


@query(
    """WITH e AS (SELECT user_id % 5 AS uid, value, row_number() OVER (PARTITION BY user_id % 5
    ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id % 5) AS n FROM events), g AS (SELECT DISTINCT uid, n FROM e),
    d AS (SELECT uid, b, CAST('0x' || substr(md5('42:' || uid || ':' || b || ':' || k), 1, 8) AS BIGINT) % n AS pos
    FROM g, range(30) AS r(b), range(3) AS s(k)), m AS (SELECT d.uid, b, max(value) - min(value) AS v FROM d JOIN e ON d.uid = e.uid AND d.pos = e.pos
    GROUP BY 1, 2)
    SELECT uid, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM m GROUP BY 1"""
)
def bootstrap_range(spark, sf):
    """A bootstrap of a reducer of one's own: the range of three draws."""
    e = read(spark, sf, "events").select((F.col("user_id") % 5).alias("uid"), "value", "event_id")
    e = e.withColumn("pos", F.row_number().over(W.partitionBy("uid").orderBy("event_id")) - 1)
    return X.bootstrap(
        e, ["uid"], 3, resamples=30, reducer=lambda a: F.array_max(a) - F.array_min(a)
    ).select("uid", r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    """SELECT lang AS category, count(*) AS files, count(*) FILTER (WHERE doc_id % 10 IN (3, 7)) AS rejected, false AS complete FROM documents
    WHERE lang IS NOT NULL GROUP BY 1"""
)
def publication_scope(spark, sf):
    """Files by category: how many are out of scope, and whether a category is complete."""
    i = F.col("doc_id")
    path = F.when(i % 10 == 3, F.concat(F.lit("out/../"), i.cast("string"))).when(
        i % 10 == 7, F.concat(F.lit("out/a"), i.cast("string"), F.lit(".pem"))
    ).otherwise(F.concat(F.lit("out/b/"), i.cast("string")))
    x = read(spark, sf, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("category"), path.alias("path"))
    return files.scope_report(x, "path", "category", "out", {"en": 1})


@query(
    """SELECT name, step // 50 AS period, CASE WHEN contains(name, 'max') THEN 'max' WHEN contains(name, 'timing_s') THEN 'sum' ELSE 'avg' END AS rule,
    round(CASE WHEN contains(name, 'max') THEN max(v) WHEN contains(name, 'timing_s') THEN sum(v) ELSE avg(v) END, 4) AS value
    FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'a/max' WHEN 1 THEN 'timing_s/x' ELSE 'loss' END AS name, event_id // 10 AS step, value AS v
    FROM events) GROUP BY 1, 2"""
)
def flushed_metrics(spark, sf):
    """Metrics of several steps rolled up each time the aggregator is flushed."""
    e = read(spark, sf, "events").select(
        F.expr("CASE event_id % 3 WHEN 0 THEN 'a/max' WHEN 1 THEN 'timing_s/x' ELSE 'loss' END").alias("name"),
        F.floor(F.col("event_id") / 10).alias("step"), "value"
    )
    x = e.withColumn("period", F.floor(F.col("step") / 50))
    named = x.withColumn("name", F.concat_ws("\t", "name", F.col("period").cast("string")))
    out = X.roll_up_steps(named)
    return out.select(
        F.split_part("name", F.lit("\t"), F.lit(1)).alias("name"), F.split_part("name", F.lit("\t"), F.lit(2)).cast("long").alias("period"), "rule",
        r6("value", 4).alias("value")
    )


@query(
    """SELECT 1 AS half, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 2, count(*), round(avg(value), 6)
    FROM events WHERE event_id % 2 = 1 UNION ALL SELECT 0, count(*), round(avg(value), 6) FROM events"""
)
def merged_validations(spark, sf):
    """Two validation results as one, and each."""
    e = read(spark, sf, "events").select((F.col("event_id") % 2 + 1).cast("int").alias("half"), "value")
    both = e.where("half = 1").unionByName(e.where("half = 2"))
    stat = lambda d, k: d.agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean")).select(F.lit(k).alias("half"), "n", "mean")
    return stat(e.where("half = 1"), 1).union(stat(e.where("half = 2"), 2)).union(stat(both, 0))
