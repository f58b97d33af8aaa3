"""Queue semantics on batches and streams.

Lateness is counted in parameter versions.  The batch forms work on a table of arrivals in their
order; the stateful form runs the bounded queue inside a stream.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.operators.frame import running_sum, with_position, with_range


def drop_oldest(df: DataFrame, capacity: int, order: str, by: list[str] = ()) -> DataFrame:
    """What a queue of ``capacity`` holds after all arrivals: the last ones; with ``dropped``, how
    many went.  Without ``by`` there is one queue, whose last rows are found by a top-k."""
    if not by:
        return df.orderBy(F.desc(order)).limit(capacity).withColumn("dropped", F.lit(max(0, df.count() - capacity)).cast("long"))
    w = W.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.desc(order)))
    n = F.count("*").over(w)
    return df.withColumn("_r", rank).withColumn("dropped", F.greatest(n - capacity, F.lit(0))).where(F.col("_r") <= capacity).drop("_r")


def max_required(require: int, threshold: float, interval: int) -> float:
    return require * (threshold + 1) * interval


def should_pause(df: DataFrame, capacity: int, required: float) -> DataFrame:
    """Add ``pause``: the queue is full or too many samples are stale."""
    return df.withColumn("pause", (F.col("queued") >= capacity) | (F.col("stale") >= required))


def batches_of(df: DataFrame, n: int, order: str, by: list[str] = ()) -> DataFrame:
    """Full groups of exactly n arrivals; what is left over waits."""
    if not by:
        full = df.count() // n
        return with_position(df, order, "_rn").withColumn("batch", F.floor(F.col("_rn") / n)).where(F.col("batch") < full).drop("_rn")
    w = W.partitionBy(*by)
    rn = F.row_number().over(w.orderBy(order)) - 1
    return df.withColumn("_rn", rn).withColumn("_n", F.count("*").over(w)).withColumn("batch", F.floor(F.col("_rn") / n)).where(
        F.col("batch") < F.floor(F.col("_n") / n)
    ).drop("_rn", "_n")


def staleness(df: DataFrame, order: str, by: list[str] = ()) -> DataFrame:
    """Rows version (of the trainer) and param_version (of the sample): add ``is_stale`` and how many
    there were so far."""
    x = df.withColumn("is_stale", (F.col("version") - F.col("param_version") >= 1).cast("int"))
    if not by:
        return running_sum(x, "is_stale", order, "stale_so_far")
    return x.withColumn("stale_so_far", F.sum("is_stale").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def version_as_of(samples: DataFrame, versions: DataFrame, time: str, by: list[str] = ()) -> DataFrame:
    """As-of join: the latest version at or before each sample, by a union and a running last value.

    Without ``by`` time is cut into ranges: the last version of a range is carried to later ones,
    of which there is one row each, and rows look back within their range only."""
    names = [*by, time]
    a = samples.withColumns({"_v": F.lit(None).cast("long"), "_s": F.lit(1)})
    b = versions.select(*names, F.col("version").cast("long").alias("_v"), F.lit(0).alias("_s"))
    both = a.unionByName(b, allowMissingColumns=True)
    if by:
        w = W.partitionBy(*by).orderBy(time, "_s").rowsBetween(W.unboundedPreceding, 0)
        return both.withColumn("version", F.last("_v", ignorenulls=True).over(w)).where("_s = 1").drop("_v", "_s")
    seconds = F.unix_micros(F.col(time).cast("timestamp")) if dict(both.dtypes)[time].startswith("timestamp") else F.col(time)
    x = with_range(both.withColumn("_t", seconds.cast("double")), "_t")
    own = F.last("_v", ignorenulls=True).over(W.partitionBy("_range").orderBy("_t", "_s").rowsBetween(W.unboundedPreceding, 0))
    last = x.groupBy("_range").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("_l"))
    carried = last.select("_range", F.last("_l", ignorenulls=True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_c"))
    x = x.withColumn("_own", own).join(carried, "_range")
    return x.where("_s = 1").withColumn("version", F.coalesce("_own", "_c")).drop("_v", "_s", "_t", "_range", "_own", "_c")


def ready_steps(df: DataFrame) -> DataFrame:
    """Replay buffer: the rows of status success of each step without a running row."""
    running = F.count_if(F.col("status") == "running").over(W.partitionBy("step"))
    return df.withColumn("_r", running).where((F.col("_r") == 0) & (F.col("status") == "success")).drop("_r")


def latest_tags(updates: DataFrame, key: str, order: str) -> DataFrame:
    """Upserts: the last update of each key."""
    names = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_u")).select(key, "_u.*")


def bounded_queue_stream(stream: DataFrame, capacity: int, key: str = "queue") -> DataFrame:
    """(queue, held, dropped, produced) after each micro-batch of a stream with columns queue and
    sample_id: state keeps the ids held, oldest first."""

    def run(k, frames, state):
        held, dropped, produced = state.get if state.exists else ([], 0, 0)
        held = deque(held, maxlen=capacity)  # a full one lets its oldest go
        for pdf in frames:
            held.extend(pdf["sample_id"])
            produced += len(pdf)
        held, dropped = list(held), max(0, produced - capacity)
        state.update((held, dropped, produced))
        yield pd.DataFrame({"queue": [k[0]], "held": [held], "dropped": [dropped], "produced": [produced]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.groupBy(key).applyInPandasWithState(
        run, "queue string, held array<string>, dropped long, produced long", "held array<string>, dropped long, produced long", "update",
        GroupStateTimeout.NoTimeout
    )


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extra, not of the queues: counts and sums of events by event-time window and type."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extra: sessions of each user, ended by a gap."""
    return stream.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def token_bucket(df: DataFrame, rate: float, capacity: float, by: str = "limiter") -> DataFrame:
    """Replay of a rate limiter: rows limiter, arrival (seconds), need; adds ``start``, when each
    request may go.  A request beyond the capacity goes into debt instead of waiting for ever."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["arrival", "request"]).reset_index(drop=True)
        tokens, at, starts = capacity, None, []
        for arrival, need in zip(pdf["arrival"], pdf["need"]):
            now = arrival if at is None else max(arrival, at)
            if at is not None:
                tokens = min(capacity, tokens + (now - at) * rate)
            wanted = min(need, capacity)
            if tokens < wanted:
                now += (wanted - tokens) / rate
                tokens = wanted
            tokens -= need
            at = now
            starts.append(now)
        return pdf.assign(start=starts)

    rows = df.select(
        F.col(by).cast("string").alias("limiter"), F.col("request").cast("long").alias("request"), F.col("arrival").cast("double").alias("arrival"),
        F.col("need").cast("double").alias("need")
    )
    return rows.groupBy("limiter").applyInPandas(run, "limiter string, request long, arrival double, need double, start double")


def sample_feed(df: DataFrame, epochs: int, total: int, order: str = "row_id") -> DataFrame:
    """(epoch, row, place): samples epoch by epoch until ``total`` of them, then an end marker,
    whose row is null."""
    n = df.count()
    x = with_position(df.select(order), order).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    x = x.withColumn("place", F.col("epoch") * n + F.col("rn")).where(F.col("place") < total)
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("int").alias("epoch"), F.lit(None).cast("long").alias("row"), F.lit(min(total, n * epochs)).cast("long").alias("place")
    )
    return x.select("epoch", F.col(order).cast("long").alias("row"), "place").unionByName(end)


def queue_stats(df: DataFrame, capacity: int, by: str = "queue", size: str | None = None) -> DataFrame:
    """Per queue: produced, held, dropped, and the bytes that what is held takes, about."""
    n = F.count("*")
    held = F.least(n, F.lit(capacity))
    out = df.groupBy(by).agg(n.alias("produced"), held.alias("held"), (n - held).alias("dropped"), *([F.avg(size).alias("_avg")] if size else []))
    return out.withColumn("bytes", (F.col("held") * F.col("_avg")).cast("long")).drop("_avg") if size else out


def is_valid_slot(sample: str, version: str, current: int, oldest: int) -> object:
    """A message that is a sample, of a version that is neither too old nor to come."""
    return F.col(sample).isNotNull() & (F.col(version) <= current) & (F.col(version) >= current - oldest)


def consumed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a replay buffer holds once consumed keys are removed."""
    return df.join(done.select(key), key, "left_anti")


def batch_of_samples(df: DataFrame, n: int, order: str, by: list[str] = ()) -> DataFrame:
    """Full batches of samples and what assembling them tells: times, spans of versions, diversity."""
    from quillstream.operators.metrics import assembly_stats

    return assembly_stats(batches_of(df, n, order, by), "seconds", "first_version", "last_version", [*by, "batch"])


def admitted(df: DataFrame, limit: int, order: str, seconds: str, by: str) -> DataFrame:
    """Replay of a concurrency limit: which of ``limit`` lanes takes a request and when it begins,
    if requests are dealt out in turn and a lane takes one at a time."""
    w = W.partitionBy(by).orderBy(order)
    x = df.withColumn("lane", ((F.row_number().over(w) - 1) % limit).cast("int"))
    lane = W.partitionBy(by, "lane").orderBy(order)
    # a request begins when it is there and the lane is free: the largest of arrival - work before it, plus that work
    work = F.coalesce(F.sum(seconds).over(lane.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("_w", work)
    return x.withColumn("begin", F.max(F.col("arrival") - F.col("_w")).over(lane.rowsBetween(W.unboundedPreceding, 0)) + F.col("_w")).drop("_w")
