"""Queries that run a stream: files are read as they arrive, and what the query gives is what its
sink holds once all that is there has been taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.plans.base import query, r6, read
from quillstream.sources import dumps as D
from quillstream.streaming import assembly as A
from quillstream.streaming import queues as Q


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    df = spark.readStream.schema(read(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(sf)
    times = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}  # event time is an instant
    return df.withColumns(times) if times else df


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream until nothing is left to read; its result, from files that the tasks write: a
    folder for each micro-batch, of which the last one holds all that ``complete`` gives."""
    at, done = D.scratch(df.sparkSession), []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{n}")
        done.append(f"{at}/{n}")

    df.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if not done:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.read.schema(df.schema).parquet(*(done[-1:] if mode == "complete" else dict.fromkeys(done)))


@query("SELECT event_type AS queue, count(*) AS produced, greatest(count(*) - 50, 0) AS dropped, least(count(*), 50) AS held FROM events GROUP BY 1")
def stream_bounded_queue(spark, sf):
    """A bounded queue for each key as state of a stream: the oldest go when it is full."""
    s = stream(spark, sf, "events").select(F.col("event_type").alias("queue"), F.col("event_id").cast("string").alias("sample_id"))
    out = drained(Q.bounded_queue_stream(s, 50), "update")
    last = out.groupBy("queue").agg(F.max_by(F.struct("produced", "dropped", F.size("held").alias("held")), "produced").alias("x"))
    return last.select("queue", "x.produced", "x.dropped", F.col("x.held").cast("long").alias("held"))


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, sf):
    """Counts and sums by event time, late rows told by a watermark."""
    out = drained(Q.windowed_counts(stream(spark, sf, "events")), "complete")
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", r6("total", 4).alias("total"))


@query(
    """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s
    FROM events), g AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM l)
    SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS events FROM g GROUP BY 1"""
)
def stream_sessions(spark, sf):
    """Sessions of each user, ended by half an hour without events."""
    out = drained(Q.sessions(stream(spark, sf, "events")), "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 3 >= 1) AS stale FROM events GROUP BY 1")
def stream_staleness(spark, sf):
    """How many samples of a stream are behind the trainer's version."""
    s = stream(spark, sf, "events").withColumn("lag", F.col("event_id") % 3)
    return drained(s.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("lag") >= 1).alias("stale")), "complete")


@query(
    """WITH RECURSIVE e AS (SELECT event_type AS q, event_id AS id, event_id % 37 = 0 AS v, sum((event_id % 37 = 0)::INT) OVER (PARTITION BY event_type ORDER BY event_id) AS seg FROM events),
    g AS (SELECT q, unnest(range(0, max(seg)::BIGINT + 1)) AS seg FROM e GROUP BY q),
    s AS (SELECT g.q, g.seg, count(id) FILTER (NOT v) AS a FROM g LEFT JOIN e ON g.q = e.q AND g.seg = e.seg GROUP BY 1, 2),
    r AS (
      SELECT q, seg, least(a, 24)::BIGINT AS done, (a - least(a, 24))::BIGINT AS waiting FROM s WHERE seg = 0
      UNION ALL SELECT r.q, s.seg, r.done + least(waiting + a, 24 - r.done % 8), waiting + a - least(waiting + a, 24 - r.done % 8) FROM r JOIN s ON r.q = s.q AND s.seg = r.seg + 1),
    k AS (SELECT q, id, (row_number() OVER (PARTITION BY q ORDER BY id) - 1) // 8 AS b FROM e WHERE NOT v),
    b AS (SELECT q, b, min(id) AS first, max(id) AS last, count(*) AS n FROM k GROUP BY 1, 2)
    SELECT b.q AS queue, b.b::BIGINT AS batch, min(r.seg)::BIGINT AS version, first, last, b.n FROM b JOIN r ON b.q = r.q AND r.done >= (b.b + 1) * 8 GROUP BY ALL"""
)
def stream_batches(spark, sf):
    """Batches of eight samples as state of a stream, which pauses at 24 stale ones till the next version."""
    s = stream(spark, sf, "events").withColumns({"queue": F.col("event_type"), "id": F.col("event_id"), "seq": F.col("event_id"), "is_version": F.col("event_id") % 37 == 0})
    with A.keyed_state(spark):
        out = drained(A.assembled(s, 8, 24), "append")
    return out.where("NOT drained").select("queue", "batch", "version", F.array_min("ids").alias("first"), F.array_max("ids").alias("last"), F.size("ids").cast("long").alias("n"))


@query(
    """SELECT s.event_id AS id, arg_max(v.event_id, v.ts) AS version FROM events s
    LEFT JOIN events v ON v.event_type = s.event_type AND v.event_id % 10 = 0 AND v.ts <= s.ts AND v.ts > s.ts - INTERVAL 1 DAY
    WHERE s.event_id % 10 <> 0 AND s.ts <= (SELECT max(ts) - INTERVAL 3 DAY FROM events) GROUP BY 1"""
)
def stream_versions(spark, sf):
    """Samples of a stream joined with a stream of versions: the last one at or before each, of a day at most."""
    samples = stream(spark, sf, "events").where("event_id % 10 <> 0").selectExpr("event_type AS queue", "event_id AS id", "ts")
    versions = stream(spark, sf, "events").where("event_id % 10 = 0").selectExpr("event_type AS queue", "event_id AS version", "ts")
    last = read(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    out = drained(A.with_versions(samples, versions, "1 DAY"), "append")
    return out.join(F.broadcast(last), F.col("ts") <= F.col("last") - F.expr("INTERVAL 3 DAY")).select("id", "version")
