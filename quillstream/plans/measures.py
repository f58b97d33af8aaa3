"""Queries of metrics, validation, shaping, curation, balancing and texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.functions import graders as G
from quillstream.functions import masked as M
from quillstream.functions import messages as Y
from quillstream.functions import verifiers as V
from quillstream.operators import balance as P
from quillstream.operators import curation as C
from quillstream.operators import metrics as X
from quillstream.operators import shaping as S
from quillstream.plans.base import TOK, query, r6, read, rollouts, spread

MEAN_SCORE = """WITH s AS (SELECT lang, (CASE WHEN NOT contains(text, ',') THEN 1.0 ELSE 0 END + CASE WHEN NOT contains(text,
    '!') THEN 1.0 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '[a-zA-Z]')) >= 500 THEN 1.0 ELSE 0 END) / 3 AS s FROM documents)
  SELECT lang, round(avg(s), 6) AS score, count(*) AS n FROM s GROUP BY 1"""


@query(MEAN_SCORE)
def mean_score_by_lang(spark, sf):
    """The flagship: verifier scores of responses, averaged by language."""
    checks = [
        ("punctuation:no_comma", {}), ("punctuation:punctuation_exclamation", {}), ("letters:letter_counting", {"N": 500, "relation": "at least"})
    ]
    d = spread(read(spark, sf, "documents").select("lang", "text")).select("lang", V.constraint_score(F.col("text"), checks).alias("s"))
    return d.groupBy("lang").agg(r6(F.avg("s")).alias("score"), F.count("*").alias("n"))


@query(
    f"""WITH {TOK}, g AS (SELECT o_orderkey, coalesce(sum(r), 0) AS s, coalesce(sum(m), 0) AS n, sum(adv * m) AS a, max(CASE WHEN m = 1 THEN adv END) AS amax,
    min(CASE WHEN m = 1 THEN adv END) AS amin FROM orders LEFT JOIN tok ON row_id = o_orderkey GROUP BY 1),
  e AS (SELECT var_samp(q - v) AS ve, var_samp(q) AS vr FROM tok WHERE m = 1)
  SELECT round(avg(s) FILTER (WHERE n > 0), 6) AS score_mean, max(s) FILTER (WHERE n > 0) AS score_max, min(s) FILTER (WHERE n > 0) AS score_min,
    round(sum(a) / sum(n), 6) + 0.0 AS advantages_mean, max(amax) AS advantages_max, min(amin) AS advantages_min,
   round(avg(n), 6) AS length_mean, CAST(max(n) AS BIGINT) AS length_max, round(avg(CASE WHEN n = 7 THEN 1.0 ELSE 0 END), 6) AS clip_ratio,
    round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END), 6) AS aborted_ratio, round(1 - any_value(ve) / (any_value(vr) + 1e-5), 5) AS explained_variance
    FROM g, e"""
)
def data_metrics(spark, sf):
    r = rollouts(spark, sf, "token_level_rewards", "advantages", "values", "sum_pi_squared", "response_mask")
    m = X.data_metrics(r.withColumn("token_level_scores", F.col("token_level_rewards")).withColumnRenamed("sum_pi_squared", "returns"), 7)
    exact = ["score_max", "score_min", "advantages_max", "advantages_min", "length_max"]
    return m.select(
        *exact, *[r6(c).alias(c) for c in ("score_mean", "advantages_mean", "length_mean", "clip_ratio", "aborted_ratio")],
        r6("explained_variance", 5).alias("explained_variance")
    )


@query(
    """SELECT event_type AS section, round(sum(value), 4) AS seconds, round(sum(value) * 1000 / CASE WHEN event_type = 'view' THEN sum(user_id % 7)
    ELSE sum(event_id % 11) + sum(user_id % 7) END, 4) AS ms_per_token FROM events GROUP BY 1"""
)
def timing(spark, sf):
    e = read(spark, sf, "events").select(
        F.when(F.col("event_type") == "view", "gen").otherwise(F.col("event_type")).alias("section"), F.col("value").alias("seconds"),
        (F.col("event_id") % 11).alias("prompt_tokens"), (F.col("user_id") % 7).alias("response_tokens")
    )
    return X.timing_metrics(e).select(
        F.when(F.col("section") == "gen", "view").otherwise(F.col("section")).alias("section"), r6("seconds", 4).alias("seconds"),
        r6("ms_per_token", 4).alias("ms_per_token")
    )


NAMES = "CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 'a/max' WHEN 1 THEN 'b/min' WHEN 2 THEN 'minmax_diff' ELSE 'timing_s/gen' END"


@query(
    f"""WITH x AS (SELECT {NAMES} AS name, value FROM events) SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name,
    'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM x GROUP BY 1"""
)
def reduce_metrics(spark, sf):
    e = read(spark, sf, "events").select(
        F.expr("CASE event_id % 4 WHEN 0 THEN 'a/max' WHEN 1 THEN 'b/min' WHEN 2 THEN 'minmax_diff' ELSE 'timing_s/gen' END").alias("name"), "value"
    )
    return X.reduce_by_name(e).select("name", r6("value").alias("value"))


@query(
    f"""WITH x AS (SELECT {NAMES} AS name, value FROM events) SELECT name, CASE WHEN contains(name, 'timing_s') THEN 'sum' WHEN contains(name,
    'max') THEN 'max' WHEN contains(name, 'min') THEN 'min' ELSE 'avg' END AS rule, round(CASE WHEN contains(name,
    'timing_s') THEN sum(value) WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 4) AS value
    FROM x GROUP BY 1"""
)
def step_roll_up(spark, sf):
    e = read(spark, sf, "events").select(
        F.expr("CASE event_id % 4 WHEN 0 THEN 'a/max' WHEN 1 THEN 'b/min' WHEN 2 THEN 'minmax_diff' ELSE 'timing_s/gen' END").alias("name"),
        F.col("event_id").alias("step"), "value"
    )
    return X.roll_up_steps(e).select("name", "rule", r6("value", 4).alias("value"))


@query(
    """WITH x AS (SELECT event_type AS name, CASE CAST(user_id % 3 AS INTEGER) WHEN 0 THEN 'sum' WHEN 1 THEN 'mean' ELSE 'max' END AS aggregation,
    event_id % 4 AS rank, event_id // 400 AS pos, value FROM events),
  p AS (SELECT name, aggregation, pos, avg(value) AS v, max(value) AS hi FROM x GROUP BY 1, 2, 3)
    SELECT name, aggregation, round(CASE aggregation WHEN 'sum' THEN sum(v) WHEN 'mean' THEN avg(v) ELSE max(hi) END, 4) AS value FROM p GROUP BY 1, 2"""
)
def tagged_metrics(spark, sf):
    e = read(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.expr("CASE user_id % 3 WHEN 0 THEN 'sum' WHEN 1 THEN 'mean' ELSE 'max' END").alias("aggregation"),
        (F.col("event_id") % 4).alias("rank"), F.floor(F.col("event_id") / 400).alias("pos"), "value"
    )
    return X.reduce_tagged(e).select("name", "aggregation", r6("value", 4).alias("value"))


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95),
    6) AS p95, max(value) AS max FROM events GROUP BY 1"""
)
def percentile_summary(spark, sf):
    return X.summary(read(spark, sf, "events"), "value", ["event_type"]).select(
        "event_type", "n", *[r6(c).alias(c) for c in ("mean", "p50", "p95")], "max"
    )


@query(
    """WITH g AS (SELECT user_id, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1)
    SELECT round(avg(mean), 6) AS mean_at_n, round(avg(std), 6) AS std_at_n, count(*) AS prompts FROM g"""
)
def val_mean_std(spark, sf):
    g = read(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return g.agg(r6(F.avg("mean")).alias("mean_at_n"), r6(F.avg("std")).alias("std_at_n"), F.count("*").alias("prompts"))


@query(
    """WITH v AS (SELECT user_id AS uid, event_type AS vote, count(*) AS votes, min(event_id) AS f, arg_min(value, event_id) AS value FROM events
    GROUP BY 1, 2) SELECT uid, vote, votes, value FROM v QUALIFY row_number() OVER (PARTITION BY uid ORDER BY votes DESC, f) = 1"""
)
def val_maj(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("uid"), F.col("event_type").alias("pred"), "value", F.col("event_id").alias("pos"))
    return X.majority(e, ["uid"])


@query(
    """WITH e AS (SELECT user_id % 20 AS uid, value, row_number() OVER (PARTITION BY user_id % 20
    ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id % 20) AS n FROM events), g AS (SELECT DISTINCT uid, n FROM e),
  d AS (SELECT uid, b, CAST('0x' || substr(md5('42:' || uid || ':' || b || ':' || k), 1, 8) AS BIGINT) % n AS pos
    FROM g, range(50) AS r(b), range(4) AS s(k)), m AS (SELECT d.uid, b, max(value) AS v FROM d JOIN e ON d.uid = e.uid AND d.pos = e.pos
    GROUP BY 1, 2)
  SELECT uid, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM m GROUP BY 1"""
)
def bootstrap_best(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id") % 20).alias("uid"), "value", "event_id")
    e = e.withColumn("pos", F.row_number().over(W.partitionBy("uid").orderBy("event_id")) - 1)
    return X.bootstrap(e, ["uid"], 4, resamples=50).select("uid", r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    """SELECT event_type, user_id % 3 AS g, grouping(event_type) * 2 + grouping(user_id % 3) AS level, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY ROLLUP (event_type, user_id % 3)"""
)
def rollup_metrics(spark, sf):
    e = read(spark, sf, "events").withColumn("g", F.col("user_id") % 3)
    return e.rollup("event_type", "g").agg(
        (F.grouping("event_type").cast("long") * 2 + F.grouping("g")).cast("int").cast("long").alias("level"), F.count("*").alias("n"),
        r6(F.sum("value"), 4).alias("total")
    )


@query("WITH g AS (SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1) SELECT rows, count(*) AS prompts FROM g GROUP BY 1")
def rollout_shape(spark, sf):
    return X.shape_check(read(spark, sf, "orders").withColumnRenamed("o_custkey", "uid"))


@query(
    """WITH s AS (SELECT conv_id % 3 AS source, conv_id, length(text) % 2 AS score FROM conversations
    WHERE role = 'assistant'), r AS (SELECT source, conv_id, avg(score) AS s FROM s GROUP BY 1, 2)
    SELECT source AS data_source, round(avg(s), 6) AS score FROM r GROUP BY 1"""
)
def offline_eval(spark, sf):
    c = read(spark, sf, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("row_id")).agg(
        F.collect_list("text").alias("responses")
    )
    df = c.withColumns({"data_source": F.col("row_id") % 3, "ground_truth": F.lit(None).cast("string")})
    return X.offline_eval(df, (F.length("response") % 2).cast("double")).select("data_source", r6("score").alias("score"))


@query(
    f"""WITH {TOK}, g AS (SELECT o_orderkey AS row_id, -sum(logp * m) AS p, -sum(old_logp * m) AS f, -sum(rollout_logp * m) AS c, sum(m) AS n,
    o_orderkey % 3 AS reward FROM orders LEFT JOIN tok ON row_id = o_orderkey GROUP BY o_orderkey),
  h AS (SELECT row_id, reward, p / nullif(n, 0) AS m, f / nullif(n, 0) AS f, c / nullif(n, 0) AS c FROM g),
  s AS (SELECT *, CASE WHEN m IS NULL THEN 'missing' WHEN f > c THEN 'inverted' WHEN m < f - 0.125 THEN 'below' WHEN m <= c THEN 'inside'
    ELSE 'above' END AS state FROM h)
  SELECT row_id, state, round(CASE state WHEN 'below' THEN 0.0 WHEN 'inside' THEN reward + 0.1 ELSE reward END, 6) AS shaped FROM s"""
)
def anchor_band(spark, sf):
    r = rollouts(spark, sf, "log_probs", "old_log_probs", "rollout_log_probs", "response_mask")
    n = M.mask_count("response_mask")
    cols = {
        f"{k}_nll": -M.masked_sum(c, "response_mask") for k, c in (("policy", "log_probs"), ("ref0", "old_log_probs"), ("ref1", "rollout_log_probs"))
    }
    r = r.withColumns(cols | {f"{k}_token_count": n for k in ("policy", "ref0", "ref1")}).withColumn("reward", (F.col("row_id") % 3).cast("double"))
    return S.anchor_band(r, margin=0.125).select("row_id", "state", r6("shaped").alias("shaped"))


@query(
    """WITH x AS (SELECT o_orderkey AS row_id, o_custkey AS uid, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p, o_orderkey % 2 AS gate
    FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY uid, p IS NULL
    ORDER BY p DESC, row_id DESC) AS k, count(p) OVER (PARTITION BY uid, p IS NULL) AS n FROM x)
  SELECT row_id, CASE WHEN p IS NOT NULL AND k <= greatest(n // 4, 1) AND gate > 0 THEN -0.1 ELSE 0.0 END AS bonus FROM r"""
)
def rank_penalty(spark, sf):
    o = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"),
        F.when(F.col("o_orderkey") % 7 == 0, float("inf")).otherwise(F.col("o_totalprice")).alias("ppl"), (F.col("o_orderkey") % 2).alias("gate"),
        F.lit(1.0).alias("reward")
    )
    return S.rank_penalty(o).select("row_id", "bonus")


@query(
    """WITH x AS (SELECT (l_partkey % 97) / 32.0 AS m0, (l_suppkey % 89) / 32.0 AS m1 FROM lineitem), c AS (SELECT round(i * 0.05, 6) AS c, i
    FROM range(41) AS r(i)), p AS (SELECT c, round(avg(CASE WHEN m1 < m0 - i * 0.05::DOUBLE THEN 1.0 ELSE 0 END), 6) AS p FROM x, c GROUP BY 1)
    SELECT c, p, coalesce(c = (SELECT min(c) FROM p WHERE p <= 0.02), false) AS chosen FROM p"""
)
def margin_curve(spark, sf):
    x = read(spark, sf, "lineitem").select((F.col("l_partkey") % 97 / 32.0).alias("m0"), (F.col("l_suppkey") % 89 / 32.0).alias("m1"))
    return S.margin_curve(x).select("c", r6("p").alias("p"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query(
    """WITH x AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT user_id, count(*) AS n, avg(v) AS mean,
    stddev_samp(v) AS s FROM x GROUP BY 1) SELECT user_id, round(mean + 1e-9, 5) AS mean, round(mean - 2.776 * s / sqrt(n), 4) AS low,
    round(mean + 2.776 * s / sqrt(n), 4) AS high FROM g WHERE n = 5"""
)
def ci95(spark, sf):
    x = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return S.confidence_bounds(x, ["user_id"], "v", 5).select(
        "user_id", r6(F.col("mean") + 1e-9, 5).alias("mean"), r6("low", 4).alias("low"), r6("high", 4).alias("high")
    )


@query(
    """SELECT turn, conv_id, CAST((CAST('0x' || substr(h, 1, 8) AS BIGINT) % 5 * (4294967296 % 5) + CAST('0x' || substr(h, 9,
    8) AS BIGINT) % 5) % 5 AS BIGINT) AS endpoint FROM (SELECT conv_id, turn, sha256(role || chr(0) || text) AS h FROM conversations)"""
)
def endpoint_routing(spark, sf):
    return read(spark, sf, "conversations").select("turn", "conv_id", S.endpoint(F.col("role"), F.col("text"), 5).alias("endpoint"))


@query("SELECT o_orderkey, round(least(-(length(o_orderpriority) * 10 - 60) / 50.0 * 0.5, 0.0), 6) + 0.0 AS penalty FROM orders")
def length_penalty(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", r6(S.length_penalty(F.length("o_orderpriority") * 10, 110, 50, 0.5)).alias("penalty"))


STRATA = "x AS (SELECT doc_id AS row_id, lang || '/' || CAST(n_chars // 2000 AS VARCHAR) AS stratum FROM documents), c AS (SELECT stratum, count(*) AS n FROM x GROUP BY 1), f AS (SELECT stratum, n, n * 100.0 / sum(n) OVER () AS e FROM c)"
QUOTA = f"{STRATA}, q AS (SELECT stratum, n, CAST(floor(e) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, stratum) <= 100 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS quota FROM f)"


def _strata(spark, sf):
    return read(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.concat_ws("/", "lang", F.floor(F.col("n_chars") / 2000).cast("string")).alias("stratum")
    )


def _quotas(x):
    return C.largest_remainder(x.groupBy("stratum").agg(F.count("*").alias("n")), "stratum", "n", 100)


@query(f"WITH {QUOTA} SELECT stratum, n, CAST(quota AS BIGINT) AS quota FROM q")
def strata_quota(spark, sf):
    return _quotas(_strata(spark, sf)).select("stratum", "n", "quota")


@query(
    f"""WITH {QUOTA}, h AS (SELECT row_id, stratum, row_number() OVER (PARTITION BY stratum
    ORDER BY CAST('0x' || substr(md5('20:' || row_id), 1, 8) AS BIGINT), row_id) AS k FROM x) SELECT row_id, h.stratum FROM h JOIN q USING (stratum)
    WHERE k <= quota"""
)
def stratified_draw(spark, sf):
    x = _strata(spark, sf)
    return C.stratified_draw(x, _quotas(x), 20).select("row_id", "stratum")


@query(
    f"""WITH {STRATA}, s AS (SELECT stratum, n, i, row_number() OVER (ORDER BY round(2 * (i - e) - 1, 9), stratum, i) AS k FROM f, range(1, 100000) AS r(i)
    WHERE i <= n) SELECT f.stratum, count(s.i) FILTER (WHERE k <= 100) AS quota FROM f JOIN s USING (stratum) GROUP BY 1"""
)
def nearest_quota(spark, sf):
    x = _strata(spark, sf).groupBy("stratum").agg(F.count("*").alias("n"))
    return C.nearest_quota(x, "stratum", "n", 100).select("stratum", "quota")


@query(
    """WITH v AS (SELECT DISTINCT o_totalprice AS v FROM orders), d AS (SELECT v, (SELECT 1)
    FROM v), a AS (SELECT o_totalprice AS v, count(*) FILTER (WHERE o_orderstatus = 'F') AS na, count(*) FILTER (WHERE o_orderstatus = 'O') AS nb
    FROM orders GROUP BY 1), c AS (SELECT abs(sum(na) OVER (ORDER BY v) / sum(na) OVER () - sum(nb) OVER (ORDER BY v) / sum(nb) OVER ()) AS d FROM a)
    SELECT round(max(d), 6) AS ks FROM c"""
)
def ks_statistic(spark, sf):
    o = read(spark, sf, "orders")
    return C.ks_distance(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_totalprice").select(r6("ks").alias("ks"))


@query(
    """WITH a AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source, count(*) AS n FROM documents
    WHERE lang <> 'en' GROUP BY 1) SELECT round(0.5 * sum(abs(coalesce(a.n, 0) / (SELECT sum(n) FROM a) - coalesce(b.n, 0) / (SELECT sum(n)
    FROM b))), 6) AS tv FROM a FULL JOIN b USING (source)"""
)
def total_variation(spark, sf):
    d = read(spark, sf, "documents")
    return C.total_variation(d.where("lang = 'en'"), d.where("lang <> 'en'"), "source").select(r6("tv").alias("tv"))


@query(
    """SELECT doc_id, round(cume_dist() OVER (PARTITION BY lang ORDER BY n_chars), 6) AS cdf, round((rank() OVER (PARTITION BY lang
    ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0) / count(*) OVER (PARTITION BY lang), 6) AS share FROM documents"""
)
def cume_dist(spark, sf):
    d = read(spark, sf, "documents")
    return d.select(
        "doc_id", r6(F.cume_dist().over(W.partitionBy("lang").orderBy("n_chars"))).alias("cdf"), r6(C.rank_share("n_chars", ["lang"])).alias("share")
    )


@query(
    """WITH e AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60) SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM e a
    JOIN e b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2"""
)
def id_pairs(spark, sf):
    e = read(spark, sf, "events").where("value > 60").groupBy("user_id").agg(F.collect_set("event_type").alias("ids"))
    return C.id_pairs(e, "ids")


@query(
    """WITH r AS (SELECT (rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) AS a,
    (rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0) AS b FROM orders)
    SELECT round(corr(a, b), 6) + 0.0 AS spearman FROM r"""
)
def spearman(spark, sf):
    return C.spearman(read(spark, sf, "orders"), "o_totalprice", "o_custkey").select(r6("spearman").alias("spearman"))


@query(
    """WITH e AS (SELECT user_id, event_type, value FROM events), m AS (SELECT event_type, avg(value) AS m FROM e GROUP BY 1)
    SELECT user_id AS row_id, round(avg(m), 5) AS difficulty FROM e JOIN m USING (event_type) GROUP BY 1"""
)
def item_difficulty(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("row_id"), F.array("event_type").alias("items"), F.col("value").alias("s"))
    return C.item_difficulty(e, "items", "s").select("row_id", r6("difficulty", 5).alias("difficulty"))


@query(
    """WITH q AS (SELECT list_distinct(quantile_cont(n_chars, [0.2, 0.4, 0.6, 0.8])) AS e FROM documents)
    SELECT doc_id, CAST(len(list_filter(e, lambda x: n_chars > x)) AS INTEGER) AS bucket FROM documents, q"""
)
def quantile_buckets(spark, sf):
    return C.quantile_bucket(read(spark, sf, "documents"), "n_chars", 5, "bucket").select("doc_id", "bucket")


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r FROM documents)
    SELECT doc_id, CAST(CASE WHEN r // 4 % 2 = 0 THEN r % 4 ELSE 3 - r % 4 END AS INTEGER) AS panel FROM r"""
)
def panel_snake(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("row_id"), "n_chars")
    return C.panels(d, "n_chars").select("doc_id", "panel")


@query(
    "SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1)::DOUBLE, 6) AS ascii, round(len(regexp_extract_all(text, '[\\x{0400}-\\x{052F}]')) / greatest(length(text), 1)::DOUBLE, 6) AS cyrillic FROM documents"
)
def script_ratios(spark, sf):
    r = C.script_ratios("text")
    return read(spark, sf, "documents").select("doc_id", r6(r["ascii"]).alias("ascii"), r6(r["cyrillic"]).alias("cyrillic"))


@query()
def pack_kk(spark, sf):
    o = read(spark, sf, "orders").withColumn("batch", F.floor(F.col("o_orderkey") / 512)).withColumn("w", P.workload((F.col("o_orderkey") % 997 + 1)))
    big = o.withColumn("n", F.count("*").over(W.partitionBy("batch"))).where("n >= 8")
    return P.balance(big, "batch", "o_orderkey", "w", 8)


@query(
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n
    FROM documents) SELECT doc_id, CAST(CASE WHEN r % 2 = 1 THEN (n - 1) // 2 + (r + 1) // 2 ELSE (n - 1) // 2 - (r + 1) // 2 END AS INTEGER) AS place
    FROM r"""
)
def centre_out(spark, sf):
    return P.centre_out(read(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "lang", "n_chars", "doc_id").select("doc_id", "place")


VERIFY = {
    "no_comma": (("punctuation:no_comma", {}), "NOT contains(text, ',')"),
    "no_dot": (("punctuation:punctuation_dot", {}), "NOT contains(text, '.')"),
    "no_exclamation": (("punctuation:punctuation_exclamation", {}), "NOT contains(text, '!')"),
    "letters": (("letters:letter_counting", {"N": 800, "relation": "at least"}), "len(regexp_extract_all(text, '[a-zA-Z]')) >= 800"),
    "letter_e": (
        ("keywords:letter_frequency", {"letter": "e", "let_frequency": 100, "let_relation": "at least"}),
        "length(lower(text)) - length(replace(lower(text), 'e', '')) >= 100"
    ),
    "the_of": (("keywords:existence", {"keywords": ["the", "of"]}), "regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)of')"),
    "the_often": (
        ("keywords:frequency", {"keyword": "the", "frequency": 20, "relation": "at least"}), "len(regexp_extract_all(text, '(?i)the')) >= 20"
    ),
    "exclude": (("keywords:exclude_word_harder", {"keyword": "and"}), "NOT contains(text, ' and ')"),
    "quotation": (("startend:quotation", {}), "length(trim(text)) > 1 AND starts_with(trim(text), '\"') AND ends_with(trim(text), '\"')"),
    "placeholders": (("detectable_content:number_placeholders", {"num_placeholders": 1}), "len(regexp_extract_all(text, '\\[.*?\\]')) >= 1"),
    "first_word": (("first_word:first_word_answer", {"first_word": "The"}), "lower(regexp_extract(ltrim(text), '^\\S+')) = 'the'"),
}


@query("SELECT doc_id, " + ", ".join(f"coalesce({sql}, false) AS {n}" for n, (_, sql) in VERIFY.items()) + " FROM documents")
def verify_simple(spark, sf):
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", *[V.verify(name, "text", **k).alias(n) for n, ((name, k), _) in VERIFY.items()]
    )

@query(
    """WITH a AS (SELECT conv_id, turn, 'so #### ' || CAST(conv_id * 37 % 5000 AS VARCHAR) || CASE WHEN turn % 2 = 0
    THEN ' then #### ' || CAST(conv_id % 9 AS VARCHAR) ELSE '' END AS t, CASE WHEN turn % 2 = 0 THEN conv_id % 9 ELSE conv_id * 37 % 4999 END AS g
    FROM conversations),
  x AS (SELECT conv_id, turn, g, replace(list_last(regexp_extract_all(right(t, 300), '#### (-?[0-9.,]+)', 1)), ',', '') AS x FROM a)
    SELECT conv_id, turn, CASE WHEN x IS NULL THEN 0.0 WHEN x = CAST(g AS VARCHAR) THEN 1.0 ELSE 0.1 END AS score FROM x"""
)
def grade_hash(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    text = F.concat(
        F.lit("so #### "), (c * 37 % 5000).cast("string"), F.when(t % 2 == 0, F.concat(F.lit(" then #### "), (c % 9).cast("string"))).otherwise("")
    )
    truth = F.when(t % 2 == 0, c % 9).otherwise(c * 37 % 4999).cast("string")
    return read(spark, sf, "conversations").select("conv_id", "turn", G.grade_hash(text, truth, format_score=0.1).alias("score"))


@query(
    r"""WITH a AS (SELECT item_id, text, '<answer>' || upper(split_part(text, ' ', 1)) || '! the ' || split_part(text, ' ', 2) || '</answer>' AS t,
    split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS g FROM benchmark),
  n AS (SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(t, '(?s)<answer>(.*?)</answer>', 1)),
    '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS x, trim(regexp_replace(regexp_replace(regexp_replace(lower(g), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS y FROM a)
  SELECT item_id, CASE WHEN x = y THEN 1.0 ELSE 0.0 END AS score FROM n"""
)
def grade_question(spark, sf):
    first, second = F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))
    # letter by letter: one without a capital of its own, as a sharp s, stays
    upper = F.array_join(F.transform(F.split(first, ""), lambda c: F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(c)), "")
    answer = F.concat(F.lit("<answer>"), upper, F.lit("! the "), second, F.lit("</answer>"))
    return read(spark, sf, "benchmark").select("item_id", G.grade_question(answer, F.array(F.concat_ws(" ", first, second))).alias("score"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, concat('<tool_call>', props, '</tool_call>') = '' AS empty FROM events")
def tool_json(spark, sf):
    text = F.concat(
        F.lit("<tool_call>"), F.to_json(F.struct(F.lit("get").alias("name"), F.from_json("props", "map<string,long>").alias("arguments"))),
        F.lit("</tool_call>")
    )
    e = read(spark, sf, "events").select("event_id", Y.json_calls(text).alias("x"))
    call = F.element_at("x.calls", 1)
    return e.select("event_id", F.get_json_object(call["arguments"], "$.k").cast("long").alias("k"), (F.size("x.calls") == 0).alias("empty"))


@query("SELECT conv_id, turn, role || '_' || conv_id || '_' || turn AS key, role AS uid, conv_id::VARCHAR AS session FROM conversations")
def turn_keys(spark, sf):
    c = read(spark, sf, "conversations").withColumn("key", F.concat_ws("_", "role", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    k = Y.turn_key(F.col("key"))
    return c.select("conv_id", "turn", "key", k["uid"].alias("uid"), k["session"].alias("session"))


@query(
    "SELECT vec_id, regexp_replace(regexp_replace('val@' || label || '//x y%', '@', '_at_', 'g'), '[^\\w./ \\-]', '_', 'g') AS key FROM (SELECT vec_id, label FROM embeddings)".replace("'//x y%'", "'/x y%'")
)
def metric_keys(spark, sf):
    return read(spark, sf, "embeddings").select(
        "vec_id", Y.metric_key(F.concat(F.lit("val@"), F.col("label").cast("string"), F.lit("//x y%"))).alias("key")
    )


@query(
    """WITH x AS (SELECT conv_id, turn, text, role || ':' || chr(10) || text AS m FROM conversations)
    SELECT conv_id, md5(CASE WHEN count(*) = 1 THEN any_value(text) ELSE string_agg(m, chr(10) || chr(10) ORDER BY turn) END) AS prompt FROM x
    GROUP BY 1"""
)
def flatten_prompts(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m")
    )
    return c.select(
        "conv_id",
        F.md5(Y.flatten_prompt(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))).alias("prompt")
    )
