"""Queries of batch-table verbs, joins, sets and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.operators import curation as C
from quillstream.operators import frame as B
from quillstream.operators import metrics as X
from quillstream.plans.base import query, r6, read
from quillstream.streaming import queues as Q

POS = "pos AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)"


def _orders(spark, sf):
    return read(spark, sf, "orders").withColumn("row_id", F.col("o_orderkey"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01'")
def scan_project_filter(spark, sf):
    o = read(spark, sf, "orders")
    return o.where(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"))
    ).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def union_all(spark, sf):
    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    return B.concat(a, read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")))


@query(f"WITH {POS} SELECT o_orderkey, CAST(k AS INTEGER) AS k, rn * 3 + k AS pos FROM pos, range(3) AS r(k)")
def repeat_interleave(spark, sf):
    return B.repeat(_orders(spark, sf).select("row_id", "o_orderkey"), 3).select("o_orderkey", "k", "pos")


@query(
    f"""WITH {POS}, n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey, CAST(k AS INTEGER) AS k, k * n + rn AS pos FROM pos, n, range(2) AS r(k)"""
)
def repeat_tile(spark, sf):
    return B.repeat(_orders(spark, sf).select("row_id", "o_orderkey"), 2, interleave=False).select("o_orderkey", "k", "pos")


@query(f"WITH {POS}, n AS (SELECT CAST(ceil(count(*) / 7.0) AS BIGINT) AS c FROM orders) SELECT o_orderkey, rn // c AS chunk FROM pos, n")
def chunk_floor(spark, sf):
    return B.chunk(_orders(spark, sf).select("row_id", "o_orderkey"), 7).select("o_orderkey", "chunk")


@query(
    f"""WITH {POS}, n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey, rn, false AS is_padding FROM pos UNION ALL SELECT o_orderkey, rn + n, true
    FROM pos, n WHERE rn < (64 - n % 64) % 64"""
)
def pad_to_divisor(spark, sf):
    return B.pad_to_divisor(_orders(spark, sf).select("row_id", "o_orderkey"), 64).select("o_orderkey", "rn", "is_padding")


@query(f"WITH {POS} SELECT o_orderkey FROM pos WHERE rn >= 10 AND rn < 500 AND (rn - 10) % 3 = 0")
def slice_step(spark, sf):
    return B.slice_rows(_orders(spark, sf).select("row_id", "o_orderkey"), 10, 500, 3).select("o_orderkey")


@query(f"WITH {POS} SELECT rn // 4 AS batch, list(o_custkey ORDER BY rn)::VARCHAR AS custs FROM pos GROUP BY 1")
def fold_batches(spark, sf):
    x = B.fold(_orders(spark, sf).select("row_id", "o_custkey"), 4, ["o_custkey"])
    return x.select(
        "batch", F.concat(F.lit("["), F.array_join(F.transform("o_custkey", lambda c: c.cast("string")), ", "), F.lit("]")).alias("custs")
    )


@query(f"WITH {POS}, n AS (SELECT count(*) // 6 AS c FROM orders) SELECT o_orderkey, rn // c AS part FROM pos, n WHERE rn < 6 * c")
def split_equal(spark, sf):
    return B.split_equal(_orders(spark, sf).select("row_id", "o_orderkey"), 6).select("o_orderkey", "part")


@query(f"WITH {POS} SELECT o_orderkey, rn % 5 AS shard FROM pos")
def round_robin(spark, sf):
    return B.round_robin(_orders(spark, sf).select("row_id", "o_orderkey"), 5).select("o_orderkey", "shard")


@query("SELECT o_orderkey AS row_id, o_custkey, o_orderstatus, o_totalprice FROM orders")
def union_columns_checked(spark, sf):
    o = _orders(spark, sf)
    return B.union_columns(o.select("row_id", "o_custkey", "o_orderstatus"), o.select("row_id", "o_custkey", "o_totalprice"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_cached(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang").join(
        read(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi"
    )


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing(spark, sf):
    o, li = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti").select("o_orderkey")


@query(
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality, CAST(d.n_chars % 2 AS INTEGER)) AS quality FROM documents d FULL
    JOIN labels l ON d.doc_id = l.doc_id"""
)
def override_coalesce(spark, sf):
    base = read(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return C.override(base, read(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def keys_in_all(spark, sf):
    d = read(spark, sf, "documents")
    return C.in_all([d, read(spark, sf, "labels"), d.where("lang = 'en'")], "doc_id")


@query(
    """WITH u AS (SELECT o_custkey AS k, o_orderkey AS v, 0 AS p FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders
    WHERE o_orderkey % 2 = 1), f AS (SELECT k, p, min(v) AS v FROM u GROUP BY 1, 2) SELECT k, v FROM f QUALIFY row_number() OVER (PARTITION BY k
    ORDER BY p DESC) = 1"""
)
def later_shard_wins(spark, sf):
    o = read(spark, sf, "orders")
    part = lambda i: o.where(F.pmod("o_orderkey", F.lit(2)) == i).groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v"))
    return C.later_wins([part(0), part(1)], "k").select("k", "v")


@query(
    """WITH r AS (SELECT doc_id // 64 AS r, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY 1)
    SELECT sha256(string_agg(h, chr(10) ORDER BY r)) AS sha256 FROM r"""
)
def keyset_digest(spark, sf):
    return C.keyset_digest(read(spark, sf, "documents"), "doc_id", 64)


@query(
    """WITH l AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS n FROM events),
    k AS (SELECT *, sum(n) OVER (ORDER BY event_id)::BIGINT AS run FROM l)
    SELECT event_id, run, row_number() OVER (PARTITION BY run ORDER BY event_id) - 1 AS trajectory FROM k"""
)
def runs_of_all(spark, sf):
    """Runs of equal event types over the whole table, and places within them, by ranges."""
    e = read(spark, sf, "events").select("event_id", "event_type")
    runs = B.consecutive_runs(e, "event_type", order="event_id").select("event_id", "run")
    places = B.trajectory_index(e, "event_type", order="event_id").select(F.col("event_id").alias("i"), "trajectory")
    return runs.join(places, F.col("event_id") == F.col("i")).select("event_id", "run", "trajectory")


@query("SELECT sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10)) AS sha256 FROM labels")
def keyset_fingerprint(spark, sf):
    return C.keyset_fingerprint(read(spark, sf, "labels"), "doc_id")


@query(
    """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation) EXCEPT
    SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0"""
)
def set_operations(spark, sf):
    c, s, n = (read(spark, sf, t) for t in ("customer", "supplier", "nation"))
    both = s.select(F.col("s_nationkey").alias("c_nationkey")).intersect(n.select("n_nationkey"))
    return c.join(both, "c_nationkey", "left_semi").select("c_custkey", "c_nationkey").subtract(
        c.where("c_acctbal < 0").select("c_custkey", "c_nationkey")
    )


@query(
    """WITH x AS (SELECT event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id
    ORDER BY event_id) THEN 0 ELSE 1 END AS s, user_id FROM events), y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run
    FROM x) SELECT event_id, CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS trajectory FROM y"""
)
def consecutive_runs(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type")
    runs = B.consecutive_runs(e, "event_type", ["user_id"], "event_id")
    from pyspark.sql import Window as W

    return runs.withColumn(
        "trajectory", (F.row_number().over(W.partitionBy("user_id", "run").orderBy("event_id")) - 1).cast("long")
    ).select("event_id", F.col("run").cast("long").alias("run"), "trajectory")


@query(
    """SELECT event_id, user_id, greatest(count(*) OVER (PARTITION BY user_id) - 10, 0) AS dropped FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10"""
)
def drop_oldest(spark, sf):
    return Q.drop_oldest(read(spark, sf, "events").select("event_id", "user_id"), 10, "event_id", ["user_id"])


@query(
    """WITH x AS (SELECT event_id, user_id, event_id // 100 AS version, event_id // 100 - event_id % 3 AS pv FROM events)
    SELECT event_id, CAST(CASE WHEN version - pv >= 1 THEN 1 ELSE 0 END AS INTEGER) AS is_stale,
    CAST(sum(CASE WHEN version - pv >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS stale_so_far FROM x"""
)
def staleness(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 100).alias("version"))
    e = e.withColumn("param_version", F.col("version") - F.col("event_id") % 3)
    return Q.staleness(e, "event_id", ["user_id"]).select("event_id", "is_stale", "stale_so_far")


@query(
    """WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n
    FROM events) SELECT event_id, user_id, rn // 8 AS batch FROM x WHERE rn // 8 < n // 8"""
)
def batch_collect(spark, sf):
    return Q.batches_of(read(spark, sf, "events").select("event_id", "user_id"), 8, "event_id", ["user_id"])


@query(
    """WITH x AS (SELECT event_id, user_id AS step, CASE WHEN value < 3 THEN 'running' WHEN value > 90 THEN 'failure' ELSE 'success' END AS status
    FROM events) SELECT event_id, step FROM x WHERE status = 'success' AND step NOT IN (SELECT step FROM x WHERE status = 'running')"""
)
def replay_ready(spark, sf):
    v = F.col("value")
    e = read(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("step"), F.when(v < 3, "running").when(v > 90, "failure").otherwise("success").alias("status")
    )
    return Q.ready_steps(e).select("event_id", "step")


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_tags(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", "event_type", "value")
    return Q.latest_tags(e, "key", "event_id").select("key", "event_type", "value")


@query(
    """WITH v AS (SELECT user_id, ts, event_id AS version FROM events WHERE event_type = 'purchase') SELECT e.event_id, v.version FROM (SELECT * FROM events
    WHERE event_type <> 'purchase') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts"""
)
def version_as_of(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    v = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("version"))
    return Q.version_as_of(e.where("event_type <> 'purchase'"), v, "ts", ["user_id"]).select("event_id", "version")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window(spark, sf):
    """An extra, in its batch form: the windowed counts a stream gives once all is in."""
    e = read(spark, sf, "events")
    return Q.windowed_counts(e).select("event_type", F.col("window.start").alias("hour"), "n", r6("total", 4).alias("total"))


@query(
    """WITH x AS (SELECT o_orderkey, CAST('0x' || substr(md5('7:' || o_orderkey), 1, 8) AS BIGINT) AS h FROM orders) SELECT o_orderkey FROM x
    ORDER BY h, o_orderkey LIMIT 100"""
)
def seeded_sample(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", X.md5_draw(F.lit("7"), F.col("o_orderkey").cast("string")).alias("h"))
    return o.orderBy("h", "o_orderkey").limit(100).select("o_orderkey")
