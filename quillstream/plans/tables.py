"""Queries of batch tables, balancing, curation, dataset preparation and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import masked as M
from quillstream.operators import balance as P
from quillstream.operators import curation as C
from quillstream.operators import frame as B
from quillstream.operators import metrics as X
from quillstream.operators import shaping as S
from quillstream.operators import subset as U
from quillstream.plans.base import query, r6, read
from quillstream.sources import corpus, prepare, scans, sinks
from quillstream.streaming import queues as Q


def draw(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8) AS BIGINT)"


POS = "pos AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)"


def _orders(spark, sf, *names):
    return read(spark, sf, "orders").withColumn("row_id", F.col("o_orderkey")).select("row_id", *names)


# --- batch tables


@query(
    f"""WITH {POS} SELECT o_orderkey AS row_id, rn, false AS is_padding, 'both' AS kind FROM pos UNION ALL SELECT o_orderkey, n + k - 1, true, 'first'
    FROM pos, range(1, 4) AS r(k) WHERE rn = 0
    UNION ALL SELECT o_orderkey, n + k - 1, true, 'last' FROM pos, range(1, 4) AS r(k) WHERE rn = n - 1"""
)
def pad_first_last(spark, sf):
    o = _orders(spark, sf)
    first, last = B.pad_with(o, 3), B.pad_with(o, 3, last=True).where("is_padding")
    kind = F.when(F.col("is_padding"), "first").otherwise("both")
    return first.withColumn("kind", kind).unionByName(last.withColumn("kind", F.lit("last"))).select(
        "row_id", F.col("rn").cast("long").alias("rn"), "is_padding", "kind"
    )


@query(
    """SELECT CAST(count(*) + (64 - count(*) % 64) % 64 AS BIGINT) AS rows, CAST((64 - count(*) % 64) % 64 AS BIGINT) AS padding,
    CAST((64 - count(*) % 64) % 64 AS BIGINT) AS uids, round(avg(o_totalprice), 4) AS price FROM orders"""
)
def noop_rows(spark, sf):
    """Rows that do nothing fill up the batch and are left out of step metrics."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("string").alias("uid"), "o_totalprice")
    x = B.pad_minimal(o, 64, {"o_totalprice": F.lit(0.0)})
    whole = x.agg(
        F.count("*").alias("rows"), F.count_if("is_padding").alias("padding"),
        F.count_distinct(F.when(F.col("is_padding"), F.col("uid"))).alias("uids")
    )
    return whole.join(F.broadcast(X.without_padding(x).agg(r6(F.avg("o_totalprice"), 4).alias("price"))))


@query(
    f"""WITH {POS}, s AS (SELECT *, row_number() OVER (ORDER BY {draw("'5'", "o_orderkey")}, o_orderkey) - 1 AS k FROM pos)
    SELECT o_orderkey AS row_id, CASE WHEN rn // 100 < n // 100 THEN rn // 100 END AS batch, k // 100 AS seeded FROM s"""
)
def data_loader(spark, sf):
    o = _orders(spark, sf)
    train, val = B.loader(o, 100), B.loader(o, 100, drop_last=False, seed=5).withColumnRenamed("batch", "seeded")
    return val.join(train, "row_id", "left").select("row_id", "batch", "seeded")


@query(
    f"""WITH e AS (SELECT o_orderkey, e, row_number() OVER (PARTITION BY e ORDER BY {draw("'3'", "e", "o_orderkey")}, o_orderkey) - 1 AS rn,
    count(*) OVER (PARTITION BY e) // 256 AS k FROM orders, range(3) AS r(e))
    SELECT CAST(e * k + rn // 256 AS BIGINT) AS step, CAST(e AS INTEGER) AS epoch, rn % 256 AS slot, o_orderkey AS row_id FROM e
    WHERE rn // 256 < k AND e * k + rn // 256 < 70"""
)
def batch_feed(spark, sf):
    """Batches in a row over several epochs, as many as are asked for."""
    o = _orders(spark, sf)
    each = max(1, o.count() // 256)
    return B.feed(o, 256, min(70, 3 * each), seed=3).select(F.col("step").cast("long").alias("step"), "epoch", "slot", "row_id")


@query(
    f"WITH e AS (SELECT o_orderkey, e, row_number() OVER (PARTITION BY e ORDER BY {draw("'7'", "e", "o_orderkey")}, o_orderkey) - 1 AS rn FROM orders, range(2) AS r(e)) SELECT o_orderkey AS row_id, CAST(e AS INTEGER) AS epoch, rn // 256 AS batch, rn % 256 AS slot FROM e"
)
def mini_batches(spark, sf):
    return B.mini_batches(_orders(spark, sf), 256, epochs=2, seed=7)


@query(
    f"""WITH w AS (SELECT c_custkey, CAST(round(greatest(abs(c_acctbal) * 100, 1)) AS BIGINT) AS w
    FROM customer), s AS (SELECT *, sum(w) OVER (ORDER BY c_custkey) AS hi FROM w), t AS (SELECT sum(w) AS t FROM w),
    d AS (SELECT k AS draw, {draw("'3'", "k")} / 4294967296.0 * t AS u FROM range(500) AS r(k), t) SELECT draw, c_custkey AS row_id FROM d
    JOIN s ON u >= hi - w AND u < hi"""
)
def weighted_resample(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.greatest(F.round(F.abs("c_acctbal") * 100), F.lit(1.0)).alias("w"))
    return B.weighted_resample(c, "w", 500, seed=3).select("draw", "row_id")


@query(
    f"""WITH k AS (SELECT DISTINCT user_id, event_type FROM events), c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY event_type
    ORDER BY {draw("'1'", "user_id")}, user_id) <= 3)
    SELECT event_id, c.user_id IS NOT NULL AS traced FROM events e LEFT JOIN c ON e.user_id = c.user_id AND e.event_type = c.event_type"""
)
def traced_samples(spark, sf):
    return B.traced(
        read(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", 3, seed=1, by=["event_type"]
    ).select("event_id", "traced")


@query(f"WITH {POS} SELECT rn // 32 AS block, CAST(sum(o_custkey) AS BIGINT) AS total FROM pos GROUP BY 1")
def block_sums(spark, sf):
    return B.block_sums(_orders(spark, sf, "o_custkey"), "o_custkey", 32)


@query("SELECT o_orderkey AS row_id, CAST(k AS INTEGER) AS k, o_custkey % 4 AS times FROM orders, range(4) AS r(k) WHERE k < o_custkey % 4")
def repeat_each(spark, sf):
    return B.repeat_each(_orders(spark, sf, (F.col("o_custkey") % 4).alias("times")), "times").select("row_id", "k", "times")


@query(
    """SELECT o_orderkey AS row_id, CAST(k AS INTEGER) AS k, o_orderkey * (2 * k + 1) + o_orderkey * (2 * k + 2) AS total FROM orders, range(3) AS r(k)"""
)
def unfold_column(spark, sf):
    x = _orders(spark, sf).withColumn("a", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.col("row_id") * i))
    return B.unfold(x, "a", 3).select("row_id", "k", (F.get("a", 0) + F.get("a", 1)).alias("total"))


@query(f"WITH {POS} SELECT o_orderkey AS row_id, n - 1 - rn AS pos, rn // 1000 AS part FROM pos")
def reorder_rows(spark, sf):
    """Rows by positions (here reversed), and parts of one size."""
    o = _orders(spark, sf)
    n = o.count()
    positions = spark.range(n).select(F.col("id").alias("rn"), (F.lit(n - 1) - F.col("id")).alias("pos"))
    return B.take(o, positions).join(B.split(o, 1000), "row_id").select("row_id", "pos", "part")


@query(
    """SELECT o_orderkey AS row_id, o_custkey AS renamed, o_custkey + 1 AS popped, o_orderkey % 3 AS a, 2::BIGINT AS b,
    CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -1 END AS defaulted FROM orders"""
)
def column_verbs(spark, sf):
    """Popped, renamed, defaulted and constant columns; maps with checked keys."""
    o = _orders(spark, sf, "o_custkey", (F.col("o_custkey") + 1).alias("popped"))
    rest, popped = B.pop(o, ["popped"])
    x = B.rename(rest, ["o_custkey"], ["renamed"]).join(popped, "row_id")
    key = F.pmod("row_id", F.lit(3))
    both = B.merged_maps(F.create_map(F.lit("a"), key), F.create_map(F.lit("a"), key, F.lit("b"), F.lit(2).cast("long")))
    maybe = F.when(F.pmod("row_id", F.lit(2)) == 0, F.col("renamed"))
    return x.select("row_id", "renamed", "popped", both["a"].alias("a"), both["b"].alias("b"), F.coalesce(maybe, F.lit(-1)).alias("defaulted"))


@query("SELECT count(*) AS left_over, 7::BIGINT AS again FROM orders WHERE o_orderkey % 2 = 1")
def padded_then_unpadded(spark, sf):
    o = _orders(spark, sf).where(F.pmod("row_id", F.lit(2)) == 1)
    n = o.count()
    x = B.unpad(B.pad_to_divisor(o, 50))
    return x.agg(F.count("*").alias("left_over"), F.lit(7 if B.same_rows(x.select("row_id"), o) and n else 0).cast("long").alias("again"))


# --- balancing


def _batches(spark, sf, weight):
    o = read(spark, sf, "orders").withColumn("batch", F.floor(F.col("o_orderkey") / 512)).withColumn("w", weight)
    return o.join(o.groupBy("batch").agg(F.count("*").alias("n")).where("n >= 8").select("batch"), "batch")


LPT = """i AS (SELECT o_orderkey // 512 AS batch, CAST(o_orderkey % 997 AS DOUBLE) AS w, row_number() OVER (PARTITION BY o_orderkey // 512
    ORDER BY o_orderkey % 997 DESC, o_orderkey) AS k FROM orders),
  n AS (SELECT batch, count(*) AS n FROM i GROUP BY 1 HAVING count(*) >= 8),
  s AS (SELECT batch, 0 AS k, [0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0] AS l FROM n UNION ALL
    SELECT s.batch, s.k + 1, list_transform(l, lambda x, j: CASE WHEN j = list_position(l, list_min(l)) THEN x + i.w ELSE x END) FROM s
    JOIN i ON i.batch = s.batch AND i.k = s.k + 1)"""


@query(
    f"""WITH RECURSIVE {LPT} SELECT s.batch, list_min(l) AS min, list_max(l) AS max, list_max(l) - list_min(l) AS spread FROM s
    JOIN n ON s.batch = n.batch AND s.k = n.n"""
)
def pack_greedy(spark, sf):
    return P.imbalance(P.balance(_batches(spark, sf, (F.col("o_orderkey") % 997).cast("double")), "batch", "o_orderkey", "w", 8, "longest"))


@query(
    """WITH o AS (SELECT o_orderkey // 512 AS batch, o_custkey, o_orderkey, CAST(o_orderkey % 997 AS DOUBLE) AS w
    FROM orders), g AS (SELECT batch, count(DISTINCT o_custkey) AS g, count(*) AS n, sum(w) AS total FROM o
    GROUP BY 1 HAVING count(DISTINCT o_custkey) % 2 = 0)
    SELECT batch, n AS items, g AS groups, g // 2 AS least_groups, g // 2 AS most_groups, 0::BIGINT AS split_groups, total FROM g"""
)
def balance_keeps_groups(spark, sf):
    """Groups stay whole and both parts have equally many; which part is the heuristic's choice."""
    o = read(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 512).alias("batch"), "o_custkey", "o_orderkey", (F.col("o_orderkey") % 997).cast("double").alias("w")
    )
    even = o.groupBy("batch").agg(F.count_distinct("o_custkey").alias("g")).where("g % 2 = 0").select("batch")
    x = P.balance_groups(o.join(even, "batch"), "batch", "o_custkey", "o_orderkey", "w", 2)
    groups = x.groupBy("batch", "group").agg(
        F.count_distinct("part").alias("parts"), F.min("part").alias("part"), F.count("*").alias("n"), F.sum("weight").alias("w")
    )
    parts = groups.groupBy("batch", "part").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count_if(F.col("parts") > 1).alias("split")
    )
    return parts.groupBy("batch").agg(
        F.sum("n").alias("items"), F.sum("g").alias("groups"), F.min("g").alias("least_groups"), F.max("g").alias("most_groups"),
        F.sum("split").alias("split_groups"), F.sum("w").alias("total")
    )


@query(
    """SELECT o_orderkey // 512 AS batch, count(*) AS items, CAST(sum(o_orderkey) AS BIGINT) AS keys, true AS restored, true AS dense FROM orders
    GROUP BY 1 HAVING count(*) >= 8"""
)
def balance_and_restore(spark, sf):
    """Laid out part by part, and back: places and original places are permutations of each other."""
    x = P.balanced_order(P.balance(_batches(spark, sf, (F.col("o_orderkey") % 997).cast("double")), "batch", "o_orderkey", "w", 8))
    back = B.restored(x.withColumnRenamed("item", "row_id"), "original", ["batch", "place"])
    dense = (F.count_distinct("place") == F.count("*")) & (F.max("place") == F.count("*") - 1)
    sane = F.max("original") == F.count("*") - 1
    return back.groupBy("batch").agg(F.count("*").alias("items"), F.sum("row_id").alias("keys"), sane.alias("restored"), dense.alias("dense"))


@query(
    """SELECT o_orderkey // 512 AS batch, count(*) AS items, CAST(sum(o_orderkey % 997 + 1) AS BIGINT) AS tokens, CAST(greatest(1, least(count(*),
    ceil(sum(o_orderkey % 997 + 1) / 8192.0))) AS BIGINT) AS parts FROM orders GROUP BY 1"""
)
def micro_batches(spark, sf):
    """As many parts as the limit asks for, every item in one of them."""
    o = read(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 512).alias("batch"), "o_orderkey", (F.col("o_orderkey") % 997 + 1).alias("len")
    )
    x = P.micro_batches(o, "batch", "o_orderkey", "len", 8192)
    return x.groupBy("batch").agg(F.count("*").alias("items"), F.sum("length").alias("tokens"), F.count_distinct("part").alias("parts"))


@query(
    """WITH r AS (SELECT o_orderkey, o_custkey, o_orderkey // 16 AS g FROM orders), x AS (SELECT *,
    CASE WHEN o_custkey // 300 = lag(o_custkey // 300) OVER (PARTITION BY g ORDER BY o_orderkey) THEN 0 ELSE 1 END AS s
    FROM r), y AS (SELECT *, sum(s) OVER (PARTITION BY g ORDER BY o_orderkey) AS run FROM x)
    SELECT g, CAST(max(run) AS BIGINT) AS prompts, count(*) AS responses FROM y GROUP BY 1"""
)
def shared_prefixes(spark, sf):
    """One prompt for each run of equal uids."""
    o = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.floor(F.col("o_orderkey") / 16).alias("g"), F.floor(F.col("o_custkey") / 300).alias("uid")
    )
    runs = B.consecutive_runs(o, "uid", ["g"])
    prompts = runs.groupBy("g", "run").agg(F.count("*").alias("n"))
    return prompts.groupBy("g").agg(F.count("*").alias("prompts"), F.sum("n").alias("responses"))


# --- metrics


@query(
    """SELECT CAST(sum(n_chars) AS BIGINT) AS total_num_tokens, 2.5::DOUBLE AS time_per_step, round(sum(n_chars) / (2.5 * 8), 6) AS throughput FROM documents"""
)
def throughput(spark, sf):
    t = X.throughput(read(spark, sf, "documents"), "n_chars", 2.5, 8)
    return t.select("total_num_tokens", F.col("time_per_step").cast("double").alias("time_per_step"), r6("throughput").alias("throughput"))


ASSEMBLE = "round(avg(value) + 1e-9, 6) AS avg, max(value) AS max, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS tp50, round(quantile_cont(value, 0.95), 6) AS tp95, round(quantile_cont(value, 0.99), 6) AS tp99, count(*) FILTER (WHERE event_id % 3 > 0) AS partial, round(avg(CASE WHEN event_id % 3 > 0 THEN 1.0 ELSE 0 END), 6) AS partial_ratio, max(event_id % 3) AS max_span, count(DISTINCT event_id // 100 + event_id % 3) AS versions"


def _samples(spark, sf):
    e = read(spark, sf, "events").select(
        "event_id", "event_type", F.col("value").alias("seconds"), F.floor(F.col("event_id") / 100).alias("first_version")
    )
    return e.withColumn("last_version", F.col("first_version") + F.col("event_id") % 3)


def _told(x, *keys):
    return x.select(
        *keys,
        *[
            r6(F.col(c) + 1e-9 if c == "avg" else c).alias(c) if c in (
                "avg", "tp50", "tp95", "tp99", "partial_ratio"
            ) else F.col(c) for c in x.columns if c not in keys
        ]
    )


@query(f"SELECT event_type, {ASSEMBLE} FROM events GROUP BY 1")
def assembly_stats(spark, sf):
    return _told(X.assembly_stats(_samples(spark, sf), "seconds", "first_version", "last_version", ["event_type"]), "event_type")


@query(
    f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n
    FROM events) SELECT event_type, rn // 64 AS batch, {ASSEMBLE} FROM b WHERE rn // 64 < n // 64 GROUP BY 1, 2"""
)
def assembled_batches(spark, sf):
    return _told(Q.batch_of_samples(_samples(spark, sf), 64, "event_id", ["event_type"]), "event_type", "batch")


@query(
    """WITH d AS (SELECT doc_id % 900 AS k, lang, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source FROM documents)
    SELECT 'repeated' AS issue, (SELECT count(*) FROM (SELECT k FROM d GROUP BY 1 HAVING count(*) > 1)) AS n
    UNION ALL SELECT 'missing lang', count(*) FILTER (WHERE lang IS NULL) FROM d UNION ALL
    SELECT 'missing source', count(*) FILTER (WHERE source IS NULL) FROM d UNION ALL SELECT 'group size', (SELECT count(*) FROM (SELECT lang FROM d
    GROUP BY 1 HAVING count(*) <> 250))"""
)
def row_issues(spark, sf):
    d = read(spark, sf, "documents").select(
        (F.col("doc_id") % 900).alias("k"), "lang", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source")
    )
    return X.row_issues(d, "k", ["lang", "source"], "lang", 250)


@query(
    """SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS by_label, CAST(doc_id % 10 AS BIGINT) AS by_digit, CAST(doc_id AS BIGINT) AS by_float
    FROM documents WHERE lang IS NOT NULL"""
)
def group_numbers(spark, sf):
    d = read(spark, sf, "documents").where("lang IS NOT NULL").select(
        "doc_id", "lang", (F.col("doc_id") % 10).cast("string").alias("digit"), (F.col("doc_id") + 1e-9).alias("near")
    )
    x = X.group_numbers(X.group_numbers(X.group_numbers(d, "lang", "by_label"), "digit", "by_digit"), "near", "by_float")
    return x.select("doc_id", "by_label", "by_digit", "by_float")


@query(
    """SELECT event_type, CAST(user_id % 3 AS VARCHAR) AS name, count(*) AS n, round(list_sum(list_transform(list(value
    ORDER BY event_id)[1:5], lambda v, i: v * i)), 4) AS head FROM events GROUP BY 1, 2"""
)
def gathered_metrics(spark, sf):
    """Lists of what was appended to each metric, in order."""
    e = read(spark, sf, "events").select("event_type", (F.col("user_id") % 3).cast("string").alias("name"), "value", "event_id")
    g = X.gathered(e, "event_type", "name", "value", "event_id")
    return g.select(
        "event_type", "name", F.size("values").cast("long").alias("n"),
        r6(M.array_sum(F.transform(F.slice("values", 1, 5), lambda v, i: v * (i + 1))), 4).alias("head")
    )


VAL = """v AS (SELECT CAST(user_id AS VARCHAR) AS uid, value, event_type AS pred, row_number() OVER (PARTITION BY user_id
    ORDER BY event_id) - 1 AS pos FROM events),
  g AS (SELECT uid, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM v
    GROUP BY 1), z AS (SELECT uid, n, unnest(list_distinct(list_append(list_filter(list_transform(range(1, 31), lambda i: pow(2, i)::BIGINT), lambda p: p < n), n))) AS size FROM g WHERE n > 1),
  d AS (SELECT z.uid, size, b, k, CAST('0x' || substr(md5('42:events:' || z.uid || ':acc:' || b || ':' || k), 1, 8) AS BIGINT) % n AS pos
    FROM (SELECT *, unnest(range(size)) AS k FROM z) AS z, range(1000) AS r(b)),
  j AS (SELECT d.*, v.value, v.pred FROM d JOIN v ON d.uid = v.uid AND d.pos = v.pos), c AS (SELECT uid, size, b, pred, count(*) AS votes,
    min(k) AS first, arg_min(value, k) AS val FROM j GROUP BY 1, 2, 3, 4),
  m AS (SELECT uid, size, b, arg_max(val, votes * 1000000 - first) AS maj FROM c
    GROUP BY 1, 2, 3), x AS (SELECT uid, size, b, max(value) AS best, min(value) AS worst FROM j GROUP BY 1, 2, 3),
  a AS (SELECT uid, size, avg(best) AS bm, stddev_pop(best) AS bs, avg(worst) AS wm, stddev_pop(worst) AS ws, avg(maj) AS mm, stddev_pop(maj) AS ms
    FROM x JOIN m USING (uid, size, b) GROUP BY 1, 2),
  l AS (SELECT uid, 'mean@' || n AS metric, mean AS value FROM g UNION ALL SELECT uid, 'std@' || n, std FROM g UNION ALL
    SELECT uid, 'best@' || size || '/mean', bm FROM a UNION ALL SELECT uid, 'best@' || size || '/std', bs FROM a
    UNION ALL SELECT uid, 'worst@' || size || '/mean', wm FROM a UNION ALL SELECT uid, 'worst@' || size || '/std', ws FROM a UNION ALL
    SELECT uid, 'maj@' || size || '/mean', mm FROM a UNION ALL SELECT uid, 'maj@' || size || '/std', ms FROM a),
  f AS (SELECT metric, avg(value) AS value, CAST(regexp_extract(metric, '@(\\d+)', 1) AS INTEGER) AS n FROM l GROUP BY 1)"""


@query(
    f"""WITH {VAL} SELECT CASE WHEN regexp_matches(metric, '^(mean|best|maj)@') AND NOT contains(metric,
    'std') AND n = max(n) OVER () THEN 'val-core' ELSE 'val-aux' END || '/events/acc/' || metric AS name, round(value, 8) + 0.0 AS value FROM f"""
)
def validation_metrics(spark, sf):
    from pyspark.sql import Window as W

    e = read(spark, sf, "events").select(
        F.lit("events").alias("data_source"), F.col("user_id").cast("string").alias("uid"), F.lit("acc").alias("var_name"), "event_id",
        "value", F.col("event_type").alias("pred")
    )
    e = e.withColumn("pos", F.row_number().over(W.partitionBy("uid").orderBy("event_id")) - 1)
    return X.metric_section(X.validation_metrics(e, resamples=1000)).select("name", r6("value", 8).alias("value"))


# --- curation


@query(
    """WITH k AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'ai2-adapt-dev/flan_' || doc_id WHEN 1 THEN 'personahub_' || doc_id WHEN 2
    THEN 'science.a.b.' || doc_id WHEN 3 THEN 'abc12' WHEN 4 THEN 'oasst1_x' WHEN 5 THEN 'Other.x_y' WHEN 6 THEN '_x'
      WHEN 7 THEN 'ai2-adapt-dev/no_' || md5(CAST(doc_id AS VARCHAR)) ELSE 'hard_coded_' || doc_id END AS k FROM documents)
    SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'ai2/flan' WHEN 1 THEN 'personahub' WHEN 2 THEN 'science.a.b' WHEN 3 THEN 'opaque_short_id' WHEN 4
    THEN 'oasst1'
      WHEN 5 THEN 'Other' WHEN 6 THEN 'unknown' WHEN 7 THEN 'ai2/no' ELSE 'hard_coded' END AS bucket FROM k"""
)
def source_buckets(spark, sf):
    i, s = F.col("doc_id") % 9, F.col("doc_id").cast("string")
    keys = [
        F.concat(F.lit("ai2-adapt-dev/flan_"), s), F.concat(F.lit("personahub_"), s), F.concat(F.lit("science.a.b."), s), F.lit("abc12"),
        F.lit("oasst1_x"), F.lit("Other.x_y"), F.lit("_x"), F.concat(F.lit("ai2-adapt-dev/no_"), F.md5(s)), F.concat(F.lit("hard_coded_"), s)
    ]
    return read(spark, sf, "documents").select("doc_id", C.source_bucket(F.element_at(F.array(*keys), (i + 1).cast("int"))).alias("bucket"))


RUNS = """r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars::DOUBLE END AS a, CASE WHEN doc_id % 3 = 0 THEN (n_chars + 3)::DOUBLE END AS b,
    CASE WHEN doc_id % 5 = 0 THEN (n_chars * 2)::DOUBLE END AS c FROM documents),
  l AS (SELECT *, list_filter([a, b, c], lambda x: x IS NOT NULL) AS l FROM r)"""


@query(
    f"""WITH {RUNS} SELECT doc_id, len(l) AS n, round(list_avg(l), 4) AS mean, round(CASE WHEN len(l) > 1 THEN list_stddev_samp(l) END, 4) AS std,
    CAST((a IS NOT NULL)::INT + 2 * (b IS NOT NULL)::INT + 4 * (c IS NOT NULL)::INT AS INTEGER) AS pattern,
    CASE WHEN len(l) = 0 THEN 'no_anchor' WHEN doc_id % 7 = 0 THEN 'short_y0' WHEN doc_id % 11 = 0 THEN 'loop_y0' WHEN doc_id % 13 = 0
    THEN 'cot_marker' ELSE 'clean' END AS defect,
    CASE WHEN len(l) = 0 THEN 'no_anchor' WHEN least(len(l), doc_id % 3) = 0 THEN 'none' WHEN least(len(l),
    doc_id % 3) = len(l) THEN 'all' ELSE 'some' END AS satisfied,
    CAST(coalesce(greatest(a + b, b + c), 65536) AS BIGINT) AS cost, greatest(a + b, b + c) IS NULL AS assumed FROM l"""
)
def run_statistics(spark, sf):
    """Values over runs with gaps, availability, the first defect, what is satisfied, observed cost."""
    d = read(spark, sf, "documents")
    i, n = F.col("doc_id"), F.col("n_chars").cast("double")
    x = d.select(
        "doc_id", F.when(i % 2 == 0, n).alias("a"), F.when(i % 3 == 0, n + 3).alias("b"), F.when(i % 5 == 0, n * 2).alias("c")
    ).withColumn("s", C.over_runs(["a", "b", "c"]))
    x = x.withColumns({c + "_on": F.col(c).isNotNull() for c in "abc"})
    cost = C.observed_cost([("a", "b"), ("b", "c")])
    flags = {"short_y0": i % 7 == 0, "loop_y0": i % 11 == 0, "cot_marker": i % 13 == 0}
    return x.select(
        "doc_id", F.col("s.n").alias("n"), r6("s.mean", 4).alias("mean"), r6("s.std", 4).alias("std"), C.availability(["a_on", "b_on", "c_on"]).alias("pattern"), C.defect_class(F.col("s.n"), flags).alias("defect"),
        C.satisfied_bucket(
            F.least(F.col("s.n"), i % 3), F.col("s.n")
        ).alias("satisfied"), cost["cost"].alias("cost"), cost["assumed"].alias("assumed"),
    )


@query(
    """SELECT doc_id, round(CASE WHEN doc_id % 4 > 0 AND doc_id % 3 > 0 THEN n_chars / (doc_id % 4.0) END, 6) AS floor,
    round(CASE WHEN doc_id % 4 > 0 AND doc_id % 3 > 0 THEN n_chars / (doc_id % 3.0) END, 6) AS ceiling,
    round(0.5 * (doc_id % 4), 6)::DOUBLE AS nll, round(exp(0.5), 6) AS ppl, doc_id % 4 > 0 AND doc_id % 3 > 0 AS complete FROM documents"""
)
def anchor_thresholds(spark, sf):
    """Both anchors' means or neither, anchors made from a mean, completeness."""
    i = F.col("doc_id")
    x = read(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("ref0_nll"), F.col("n_chars").cast("double").alias("ref1_nll"),
        (i % 4).alias("ref0_token_count"), (i % 3).alias("ref1_token_count"), F.array(F.lit(1)).alias("y0"), F.array(F.lit(1)).alias("y1")
    )
    t, made = S.threshold_pair(), S.anchor_from_mean(F.lit(0.5), i % 4)
    return x.select(
        "doc_id", r6(t["floor"]).alias("floor"), r6(t["ceiling"]).alias("ceiling"), r6(made["nll"]).alias("nll"), r6(made["ppl"]).alias("ppl"),
        S.complete_anchor().alias("complete")
    )


@query(
    """WITH g AS (SELECT doc_id, doc_id % 5 > 0 AS y0, doc_id % 7 > 0 AS y1 FROM documents WHERE doc_id % 11 > 0), w AS (SELECT doc_id FROM documents
    WHERE doc_id % 13 > 0)
    SELECT 'missing_y0' AS issue, count(*) AS n FROM g WHERE NOT y0 UNION ALL SELECT 'missing_y1', count(*) FROM g WHERE NOT y1 UNION ALL
    SELECT 'incomplete_score', count(*) FROM g WHERE NOT (y0 AND y1) UNION ALL SELECT 'ready', count(*) FROM g WHERE y0 AND y1
    UNION ALL SELECT 'missing key', count(*) FROM w WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'extra key', count(*) FROM g
    WHERE doc_id NOT IN (SELECT doc_id FROM w)"""
)
def run_audit(spark, sf):
    d, i = read(spark, sf, "documents"), F.col("doc_id")
    part = lambda k: F.when(i % k > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    g = d.where(i % 11 > 0).select("doc_id", part(5).alias("y0"), part(7).alias("y1"))
    complete = (F.size("y0") > 0) & (F.size("y1") > 0)
    return C.audit(g, d.where(i % 13 > 0).select("doc_id"), "doc_id", complete, complete, F.col("y0"), F.col("y1"))


@query("SELECT doc_id FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0")
def integrity(spark, sf):
    """Keys whose digests differ, or are not there, between two copies."""
    d, i = read(spark, sf, "documents").select("doc_id", "lang", "n_chars"), F.col("doc_id")
    copy = d.where(i % 19 != 0).withColumn("n_chars", F.when(i % 17 == 0, -1).otherwise(F.col("n_chars")))
    return C.differing(C.digests(d, "doc_id", "lang", "n_chars"), C.digests(copy, "doc_id", "lang", "n_chars"), "doc_id")


@query(
    f"""WITH q AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT lang, n, n * 50.0::DOUBLE / sum(n) OVER () AS x
    FROM q), f AS (SELECT lang, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) AS k, 50 - sum(floor(x)) OVER () AS rest
    FROM e),
    quota AS (SELECT lang, f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS quota
    FROM f), s AS (SELECT d, documents.lang, n_chars, row_number() OVER (PARTITION BY d, documents.lang ORDER BY {draw("d", "doc_id")}, doc_id) AS k
    FROM documents, range(20) AS r(d)),
    m AS (SELECT d, avg(n_chars) AS m FROM s JOIN quota ON s.lang = quota.lang WHERE k <= quota
    GROUP BY 1), w AS (SELECT avg(n_chars) AS a, stddev_pop(n_chars) AS s FROM documents)
    SELECT CAST(d AS INTEGER) AS draw, round(((m - a) / s) ** 2, 6) AS score FROM m, w"""
)
def rerandomise(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("stratum"), "n_chars")
    q = C.largest_remainder(d.groupBy("stratum").agg(F.count("*").alias("n")), "stratum", "n", 50)
    return C.rerandomise(d, q, 20, ["n_chars"]).select("draw", r6("score").alias("score"))


@query(
    """WITH q AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT stratum, n, n * 60.0::DOUBLE / sum(n) OVER () AS x FROM q),
    f AS (SELECT stratum, n, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) AS k, 60 - sum(floor(x)) OVER () AS rest FROM e)
    SELECT stratum, n, CAST(f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS chosen, true AS nearer, true AS accepted FROM f"""
)
def polished_subset(spark, sf):
    """A subset of 60 documents by language: of 12 draws, all polished by swaps, the nearest.  It is
    nearer the whole than the best draw was, and below the limits on each distance."""
    d = read(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("stratum"), "n_chars", F.log1p("n_chars").alias("log_chars"), F.regexp_count("text", F.lit(r"\s")).alias("spaces"), "source", "lang"
    )
    q = C.largest_remainder(d.groupBy("stratum").agg(F.count("*").alias("n")), "stratum", "n", 60)
    found = U.polished(d, q, 12, ["n_chars", "log_chars", "spaces"], {"source": 1.0, "lang": 0.5}, swaps=1500, spare=3.0).cache()
    best = U.best_subset(found).crossJoin(F.broadcast(found.agg(F.min("before").alias("best_draw"))))  # one row
    ok = C.acceptance({"ks": 0.2, "tv": 0.35, "after": 1.0})
    rows = best.withColumns({"nearer": F.col("after") < F.col("best_draw"), "accepted": ok}).join(d.select("row_id", "stratum"), "row_id")
    counts = rows.groupBy("stratum").agg(F.count("*").alias("chosen"), F.every("nearer").alias("nearer"), F.every("accepted").alias("accepted"))
    return q.select("stratum", "n").join(counts, "stratum").select("stratum", "n", "chosen", "nearer", "accepted")


WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"


@query(
    f"""WITH {WORDS}, g AS (SELECT doc_id, len(w) AS n, unnest(CASE WHEN len(w) >= 50 THEN list_transform(range(1, len(w) - 6),
    lambda i: array_to_string(w[i:i + 7], ' ')) END) AS g FROM w), c AS (SELECT doc_id, n, g, count(*) AS c FROM g GROUP BY 1, 2, 3),
    m AS (SELECT doc_id, max(c) AS m FROM c GROUP BY 1) SELECT w.doc_id, len(w) >= 50 AND (len(list_distinct(w)) / len(w) < 0.15
    OR m / (len(w) - 7) > 0.5) AS loops FROM w LEFT JOIN m ON w.doc_id = m.doc_id"""
)
def loop_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.coalesce(C.loops(F.col("text")), F.lit(False)).alias("loops"))


@query(
    """WITH d AS (SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang) AS a, count(*) OVER (PARTITION BY lang, source) AS b FROM documents
    WHERE lang IS NOT NULL AND source IS NOT NULL)
    SELECT doc_id, CASE WHEN b * 0.05 >= 5 THEN '1:' || lang || '|' || source ELSE '0:' || lang END AS stratum FROM d"""
)
def strata(spark, sf):
    d = read(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    return C.finest_stratum(d, ["lang", "source"], 0.05).select("doc_id", "stratum")


@query(
    """WITH s AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE doc_id % 4 = 0) AS k FROM documents WHERE lang IS NOT NULL
    GROUP BY 1), c AS (SELECT min(k / (n * 0.25)) AS c FROM s)
    SELECT round(c, 6) AS coverage, c < 2 AND 0.5 < 1 AS accepted, true AS covers, false AS overlapping, (SELECT count(*) FROM documents
    WHERE doc_id % 4 = 0 AND doc_id IN (SELECT doc_id FROM labels)) AS carved FROM c"""
)
def subset_checks(spark, sf):
    """Coverage of a subset, limits on its distances, parts that make up the whole, a carved subset."""
    d = read(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", "lang")
    all_, part = read(spark, sf, "documents").select("doc_id"), lambda k: read(spark, sf, "documents").where(F.col("doc_id") % 4 == k).select("doc_id")
    covers = C.exact_cover([part(0), part(1), part(2), part(3)], all_, "doc_id")
    overlap = C.exact_cover([part(0), all_], all_, "doc_id")
    carved = part(0).join(read(spark, sf, "labels"), "doc_id", "left_semi").count()
    c = C.coverage(d, d.where(F.col("doc_id") % 4 == 0), "lang", 0.25).withColumn("other", F.lit(0.5))
    return c.select(
        r6("coverage").alias("coverage"), C.acceptance({"coverage": 2.0, "other": 1.0}).alias("accepted"), F.lit(covers).alias("covers"),
        F.lit(overlap).alias("overlapping"), F.lit(carved).cast("long").alias("carved")
    )


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars::DOUBLE END AS nll, doc_id % 3 = 0 AS hit FROM documents)
    SELECT doc_id, coalesce(nll, 'inf'::DOUBLE) AS ref0_nll, coalesce(CASE WHEN hit THEN doc_id % 5 END, 0) AS ref0_token_count, hit AS anchor_hit
    FROM r"""
)
def attached_anchors(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("index"))
    cache = read(spark, sf, "documents").where(F.col("doc_id") % 3 == 0).select(
        F.col("doc_id").alias("index"), F.col("n_chars").cast("double").alias("ref0_nll"), (F.col("doc_id") % 5).alias("ref0_token_count")
    )
    return S.attach_anchors(d, cache).select(F.col("index").alias("doc_id"), "ref0_nll", "ref0_token_count", "anchor_hit")


@query(
    f"""WITH {RUNS} SELECT doc_id, list_min(l) AS least, round(CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) = 2
    THEN list_avg(l) - 12.706 * list_stddev_samp(l) * sqrt(1.5) WHEN len(l) = 3 THEN list_avg(l) - 4.303 * list_stddev_samp(l) * sqrt(1 + 1 / 3) END,
    4) AS bound,
    doc_id % 5 > 0 AND coalesce(n_chars, 0) >= 500 AND doc_id % 2 = 0 OR coalesce(n_chars, 0) = 0 AS non_stop FROM l JOIN documents USING (doc_id)"""
)
def draw_floors(spark, sf):
    """Floors of several draws: the least, and a lower bound; answers that never stopped."""
    i, n = F.col("doc_id"), F.col("n_chars").cast("double")
    x = read(spark, sf, "documents").select(
        "doc_id", "n_chars", F.when(i % 2 == 0, n).alias("a"), F.when(i % 3 == 0, n + 3).alias("b"), F.when(i % 5 == 0, n * 2).alias("c")
    )
    x = S.draw_floor(S.draw_floor(x, ["a", "b", "c"]).withColumnRenamed("floor", "least"), ["a", "b", "c"], "bound")
    ids = F.array(F.lit(9), F.when((i % 5 > 0) & (i % 2 == 0), 3).otherwise(1))
    return x.select(
        "doc_id", "least", r6("floor", 4).alias("bound"), S.is_non_stop(ids, F.coalesce("n_chars", F.lit(0)), 500, [1, 2]).alias("non_stop")
    )


@query(
    """SELECT doc_id, len(ids[greatest(len(ids) - 3, 0) + 1:]) AS prefix, len(k[1:3]) AS continuation,
    CASE WHEN doc_id % 2 = 0 THEN 1.5::DOUBLE ELSE 'inf'::DOUBLE END AS nll, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS count,
    round(CASE WHEN doc_id % 2 = 0 THEN exp(0.5) ELSE 'inf'::DOUBLE END, 6) AS ppl
    FROM (SELECT doc_id, range(doc_id % 7) AS ids, range(doc_id % 5) AS k FROM documents) WHERE len(ids) > 0 AND len(k) > 0"""
)
def scoring_batches(spark, sf):
    """Rows that can be scored, the prefix cut in front and the continuation behind, and scores put back."""
    i = F.col("doc_id")
    up_to = lambda k: F.when(i % k > 0, F.sequence(F.lit(1).cast("long"), i % k)).otherwise(F.array().cast("array<long>"))
    x = S.scoring_rows(read(spark, sf, "documents").select("doc_id", up_to(7).alias("p"), up_to(5).alias("c")), "p", "c", 3, 3)
    scores = x.where(i % 2 == 0).select("doc_id", F.lit(1.5).alias("nll"), F.lit(3).alias("count"))
    y = S.scored_back(x, scores, "doc_id")
    return y.select(
        "doc_id", F.size("p").cast("long").alias("prefix"), F.size("c").cast("long").alias("continuation"), "nll", "count", r6("ppl").alias("ppl")
    )


@query(
    """SELECT doc_id, doc_id % 3 AS offset_used, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS found,
    CASE WHEN doc_id % 3 = 0 THEN -6.0::DOUBLE WHEN doc_id % 3 = 1 THEN -9.0 ELSE -3.0 END AS total FROM documents"""
)
def aligned_log_probs(spark, sf):
    """Log probabilities for each token, at the first offset that has one for all."""
    i = F.col("doc_id") % 3
    tokens = F.array(*map(F.lit, ("a", "b", "c")))
    probs = F.when(i == 0, F.array(F.lit(-1.0), F.lit(-2.0), F.lit(-3.0))).when(
        i == 1, F.array(F.lit(-1.0), F.lit(None).cast("double"), F.lit(-4.0), F.lit(-5.0))
    ).otherwise(F.array(F.lit(-1.0), F.lit(-2.0)))
    x = read(spark, sf, "documents").select("doc_id", i.alias("offset_used"), C.aligned(tokens, probs).alias("a"))
    some = F.filter("a", lambda v: v.isNotNull())
    return x.select("doc_id", "offset_used", F.size(some).alias("found"), M.array_sum(some).alias("total"))


# --- preparation of datasets


def _problems(spark, sf):
    c, k = read(spark, sf, "conversations"), F.col("conv_id")
    return c.select(
        (k * 100 + F.col("turn")).alias("row_id"), F.col("text").alias("question"),
        F.concat(F.lit("so 1,0"), (k % 90 + 10).cast("string"), F.lit(" is #### 1,0"), (k % 90 + 10).cast("string")).alias("answer")
    )


ROWS = "SELECT conv_id * 100 + turn AS row_id, text, '10' || (conv_id % 90 + 10) AS truth FROM conversations"


@query(
    f"""WITH r AS ({ROWS}) SELECT row_id, 'grade_school_math' AS data_source, md5(text || ' Think.') AS prompt, 'math' AS ability, truth,
    md5(text) AS turn_prompt, truth AS tool_truth, 'tool_agent' AS agent, 3 AS sft_messages, 'rule' AS style, truth AS boxed,
    md5(text || ' Box it.') AS boxed_prompt FROM r"""
)
def prepared_math(spark, sf):
    """Grade-school records: plain, as a chat, with a tool, for an agent, with solutions; boxed answers."""
    p = _problems(spark, sf)
    a = prepare.grade_school_math(p, "Think.").select(
        F.col("extra_info.index").alias("row_id"), "data_source", F.md5(F.col("prompt")[0]["content"]).alias("prompt"), "ability",
        F.col("reward_model.ground_truth").alias("truth"), F.col("reward_model.style").alias("style")
    )
    b = prepare.grade_school_turns(p, "You solve.", "calc", "tool_agent").select(
        F.col("extra_info.index").alias("row_id"), F.md5(F.col("prompt")[1]["content"]).alias("turn_prompt"),
        F.col("extra_info.tools_kwargs")["calc"]["ground_truth"].alias("tool_truth"), F.col("agent_name").alias("agent")
    )
    s = prepare.grade_school_sft(p, "You solve.").agg(F.max(F.size("messages")).alias("sft_messages"))
    q = p.select(
        "row_id", F.col("question").alias("problem"),
        F.concat(F.lit("\\boxed{"), F.regexp_replace(F.regexp_extract("answer", r"#### (.*)$", 1), ",", ""), F.lit("}")).alias("solution")
    )
    m = prepare.competition_math(q, "Box it.").select(
        F.col("extra_info.index").alias("row_id"), F.col("reward_model.ground_truth").alias("boxed"),
        F.md5(F.col("prompt")[0]["content"]).alias("boxed_prompt")
    )
    return a.join(b, "row_id").join(m, "row_id").join(F.broadcast(s))


@query(
    f"""WITH r AS ({ROWS}), n AS (SELECT CAST(floor(count(*) * 0.75) AS BIGINT) AS n FROM r), p AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS rn
    FROM r),
    k AS (SELECT count(*) AS completions, sum(row_id % 4)::BIGINT AS labels,
      sum(length(trim(replace(regexp_replace(replace('a' || truth || ': b [title] c[d]  ' || text, ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' '))))::BIGINT AS chars FROM r WHERE row_id % 3 > 0)
    SELECT row_id, md5(text) AS prompt, truth, 'model' AS style, rn < n AS first_part, 'search_nq' AS data_source, md5('Find: ' || text) AS question,
    (SELECT 2 * count(*) FROM r) AS sft_rows, completions, chars, labels FROM p, n, k"""
)
def prepared_preferences(spark, sf):
    """Preference pairs as chats to be scored, as answers to be learned and split; searches; completions."""
    p = _problems(spark, sf)
    truth = F.regexp_replace(F.regexp_extract("answer", r"#### (.*)$", 1), ",", "")
    x = p.select("row_id", F.col("question").alias("prompt"), truth.alias("response"))
    a = prepare.preferences_to_rl(x).select(
        F.col("extra_info.index").alias("row_id"), F.md5(F.col("prompt")[0]["content"]).alias("prompt"),
        F.col("reward_model.ground_truth").alias("truth"), F.col("reward_model.style").alias("style")
    )
    first, rest = prepare.preference_split(x.select("row_id"))
    part = first.withColumn("first_part", F.lit(True)).union(rest.withColumn("first_part", F.lit(False)))
    s = prepare.search_questions(
        p.select("row_id", "question", F.array(F.lit("x")).alias("golden_answers"), F.lit("nq").alias("data_source")), "Find: "
    ).select(F.col("extra_info.index").alias("row_id"), "data_source", F.md5(F.col("prompt")[0]["content"]).alias("question"))
    pairs = x.select("prompt", F.col("response").alias("chosen"), F.lit("no").alias("rejected"))
    two = prepare.preferences_to_sft(pairs).agg(F.count("*").alias("sft_rows"))  # one row
    scenes = x.select(
        F.concat(F.lit("a"), "response").alias("activity_label"), F.concat(F.lit("b [title] c[d]  "), "prompt").alias("ctx"), F.array("response").alias("endings"),
        F.when(F.col("row_id") % 3 > 0, (F.col("row_id") % 4).cast("string")).otherwise("").alias("label"),
    )
    c = prepare.sentence_completion(scenes).select(F.length(F.col("prompt")[0]["content"]).alias("n"), F.col("reward_model.ground_truth").alias("label"))
    c = c.agg(F.count("*").alias("completions"), F.sum("n").alias("chars"), F.sum("label").alias("labels"))  # one row
    return a.join(part, "row_id").join(s, "row_id").join(F.broadcast(two)).join(F.broadcast(c))


@query(
    f"WITH v AS (SELECT doc_id FROM documents ORDER BY {draw("'1'", "doc_id")}, doc_id LIMIT 64) SELECT doc_id, doc_id IN (SELECT doc_id FROM v) AS val FROM documents"
)
def train_val_split(spark, sf):
    """A seeded split by key into training and validation rows."""
    train, val = scans.train_val_split(read(spark, sf, "documents").select("doc_id"), "doc_id", 64, 1)
    return train.withColumn("val", F.lit(False)).union(val.withColumn("val", F.lit(True)))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS nth FROM documents WHERE n_chars <= 400 AND lang IS NOT NULL")
def filtered_prompts(spark, sf):
    """Prompts within a limit, numbered within their group; a length that can't be had is too long."""
    d = read(spark, sf, "documents").where("lang IS NOT NULL")
    return scans.numbered(scans.drop_overlong(d, F.col("n_chars"), 400), "lang", "doc_id").select("doc_id", F.col("nth").cast("long").alias("nth"))


@query(
    """SELECT CASE WHEN doc_id % 3 = 0 THEN 'dumped' ELSE 'rebuilt' END AS prefix_source, count(*) AS rows,
    count(*) FILTER (WHERE doc_id % 5 > 0) AS eligible, CAST(sum(doc_id % 7) AS BIGINT) AS prefix_tokens, min(doc_id % 7) AS least,
    max(doc_id % 7) AS most, CAST(sum(doc_id % 11) AS BIGINT) AS response_tokens FROM documents GROUP BY 1"""
)
def corpus_statistics(spark, sf):
    i = F.col("doc_id")
    x = read(spark, sf, "documents").select(
        F.when(i % 3 == 0, "dumped").otherwise("rebuilt").alias("ppl_prefix_source"), (i % 5 > 0).alias("ppl_eligible"),
        (i % 7).alias("ppl_prefix_token_count"), (i % 11).alias("response_token_count")
    )
    return corpus.corpus_stats(x).withColumnRenamed("ppl_prefix_source", "prefix_source")


@query(
    """SELECT doc_id, 'step:3 - a:' || round(doc_id % 9 / 2.0, 3) || ' - b:1.0' AS line,
    '{"a":' || doc_id || ',"b":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '"x"' END || '}' AS canonical FROM documents"""
)
def log_lines(spark, sf):
    """A console line, and a row as JSON with its fields in order."""
    i = F.col("doc_id")
    x = read(spark, sf, "documents").select("doc_id", i.alias("a"), F.when(i % 2 == 1, "x").alias("b"))
    line = sinks.console_line(F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), (i % 9) / 2.0), F.lit(3))
    return x.select("doc_id", line.alias("line"), sinks.canonical_json(x.select("a", "b")).alias("canonical"))


@query("SELECT event_type AS endpoint, epoch(max(ts)) - epoch(min(ts)) AS seconds, count(*) AS requests FROM events GROUP BY 1")
def makespans(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("endpoint"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"))
    e = e.withColumn("end", F.col("start"))
    return sinks.makespan(e)


@query("SELECT conv_id, len(list(text)) AS n, md5(array_to_string(list(text ORDER BY turn), '|')) AS joined FROM conversations GROUP BY 1")
def gathered_responses(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id"), F.col("turn").alias("sample"), F.col("text").alias("response"))
    return sinks.gather_responses(c, "conv_id").select(
        "conv_id", F.size("responses").cast("long").alias("n"), F.md5(F.array_join("responses", "|")).alias("joined")
    )


# --- queues


@query(
    """WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn, count(*) OVER () AS n FROM events)
    SELECT CAST(e AS INTEGER) AS epoch, event_id AS row, e * n + rn AS place FROM p, range(2) AS r(e) WHERE e * n + rn < n + 500 UNION ALL
    SELECT NULL, NULL, count(*) + 500 FROM events"""
)
def sample_feed(spark, sf):
    e = read(spark, sf, "events").select("event_id")
    return Q.sample_feed(e, 2, e.count() + 500, "event_id")


@query(
    """SELECT event_type AS queue, count(*) AS produced, least(count(*), 100) AS held, count(*) - least(count(*), 100) AS dropped,
    CAST(floor(round(least(count(*), 100) * avg(length(event_type)), 3)) AS BIGINT) AS bytes FROM events GROUP BY 1"""
)
def queue_statistics(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("queue"), F.length("event_type").alias("size"))
    return Q.queue_stats(e, 100, "queue", "size")


@query(
    """SELECT event_id, event_id % 9 BETWEEN 4 AND 7 AS valid, event_id % 5 > 1 AS pending, 15.0::DOUBLE AS required,
    event_id % 20 >= 18 OR event_id % 30 >= 15 AS pause FROM events WHERE event_id % 13 > 0"""
)
def queue_rules(spark, sf):
    """Versions that may be used, consumed keys gone, and when a rollout pauses."""
    i = F.col("event_id")
    e = read(spark, sf, "events").select("event_id", (i % 9).alias("version"), (i % 20).alias("queued"), (i % 30).alias("stale"))
    e = Q.consumed(e, e.where(i % 13 == 0), "event_id")
    required = Q.max_required(5, 0.5, 2)
    x = Q.should_pause(e, 18, required)
    return x.select(
        "event_id", Q.is_valid_slot("event_id", "version", 7, 3).alias("valid"), (i % 5 > 1).alias("pending"), F.lit(required).alias("required"),
        "pause"
    )


LIMIT = """e AS (SELECT CAST(user_id AS VARCHAR) AS limiter, event_id AS request, event_id * 0.02::DOUBLE AS arrival, CAST(event_id % 7 + 1 AS DOUBLE) AS need,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  s AS (SELECT limiter, 0::BIGINT AS k, 5.0::DOUBLE AS tokens, NULL::DOUBLE AS at, NULL::DOUBLE AS begin FROM (SELECT DISTINCT limiter FROM e)
    UNION ALL
    SELECT q.limiter, q.k, CASE WHEN have < want THEN want ELSE have END - need, now + CASE WHEN have < want THEN (want - have) / 0.5 ELSE 0 END,
    now + CASE WHEN have < want THEN (want - have) / 0.5 ELSE 0 END
    FROM (SELECT e.limiter, e.k, need, least(need, 5.0) AS want, CASE WHEN s.at IS NULL THEN arrival ELSE greatest(arrival, s.at) END AS now,
    CASE WHEN s.at IS NULL THEN s.tokens ELSE least(5.0, s.tokens + (greatest(arrival, s.at) - s.at) * 0.5) END AS have FROM s
    JOIN e ON e.limiter = s.limiter AND e.k = s.k + 1) q)"""


@query(
    f"""WITH RECURSIVE {LIMIT} SELECT e.limiter, request, arrival, need, round(begin, 6) AS start FROM s JOIN e ON e.limiter = s.limiter AND e.k = s.k"""
)
def rate_limiter(spark, sf):
    """When each request of a user may go, by a bucket of tokens for each user."""
    e = read(spark, sf, "events").select(
        F.col("user_id").alias("limiter"), F.col("event_id").alias("request"), (F.col("event_id") * 0.02).alias("arrival"),
        (F.col("event_id") % 7 + 1).alias("need")
    )
    return Q.token_bucket(e, rate=0.5, capacity=5.0).select("limiter", "request", "arrival", "need", r6("start").alias("start"))


LANES = """e AS (SELECT event_type, event_id, event_id * 0.25::DOUBLE AS arrival, CAST(event_id % 9 + 1 AS DOUBLE) AS seconds,
    (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 3 AS lane FROM events),
  w AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY event_type, lane
    ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM e)"""


@query(
    f"""WITH {LANES} SELECT event_id, CAST(lane AS INTEGER) AS lane, max(arrival - w) OVER (PARTITION BY event_type, lane ORDER BY event_id) + w AS begin
    FROM w"""
)
def concurrency_lanes(spark, sf):
    e = read(spark, sf, "events").select(
        "event_type", "event_id", (F.col("event_id") * 0.25).alias("arrival"), (F.col("event_id") % 9 + 1).cast("double").alias("seconds")
    )
    return Q.admitted(e, 3, "event_id", "seconds", "event_type").select("event_id", "lane", "begin")


@query(
    """WITH v AS (SELECT ts, event_id AS version FROM events WHERE event_id % 40 = 0), r AS (SELECT ts, max(version) AS version FROM v GROUP BY 1)
    SELECT e.event_id, r.version FROM (SELECT * FROM events WHERE event_id % 40 > 0) e ASOF LEFT JOIN r ON e.ts >= r.ts"""
)
def version_as_of_all(spark, sf):
    """As-of join without a key: versions are carried over ranges of time."""
    e = read(spark, sf, "events").select("event_id", "ts")
    v = e.where(F.col("event_id") % 40 == 0).groupBy("ts").agg(F.max("event_id").alias("version"))
    return Q.version_as_of(e.where(F.col("event_id") % 40 > 0), v, "ts").select("event_id", "version")


@query(
    """WITH x AS (SELECT event_id, event_id // 100 AS version, event_id // 100 - event_id % 3 AS pv, count(*) OVER () AS n FROM events)
    SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch, CAST(sum(CASE WHEN version - pv >= 1 THEN 1
    ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS stale_so_far FROM x QUALIFY (row_number() OVER (ORDER BY event_id) - 1) // 64 < n // 64"""
)
def one_queue(spark, sf):
    """Batches and staleness of a single queue, without a global order in one task."""
    e = read(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 100).alias("version"))
    e = e.withColumn("param_version", F.col("version") - F.col("event_id") % 3)
    return Q.batches_of(Q.staleness(e, "event_id"), 64, "event_id").select(
        "event_id", "batch", F.col("stale_so_far").cast("long").alias("stale_so_far")
    )


@query("SELECT event_id, greatest((SELECT count(*) FROM events) - 300, 0) AS dropped FROM events ORDER BY event_id DESC LIMIT 300")
def one_queue_held(spark, sf):
    return Q.drop_oldest(read(spark, sf, "events").select("event_id"), 300, "event_id")
