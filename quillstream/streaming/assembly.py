"""Batches assembled as state of a stream, and samples joined with the versions they were made by.

A queue's samples are admitted until too many are stale, that is, admitted since the trainer's last
version; then the queue pauses and samples wait.  A new version makes those still pending the only
stale ones, and waiting samples are admitted in their order.  Every n admitted samples are a batch.
A queue that has been idle is drained by a timer.
"""

from __future__ import annotations

from collections import deque
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

BATCH = "queue string, batch long, version long, ids array<long>, drained boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """A session whose streams, started inside, keep lists and timers: these need the RocksDB store."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield spark
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Assembler(StatefulProcessor):
    def __init__(self, n: int, limit: int, idle_ms: int):
        if limit < n:
            raise ValueError("a limit below the batch size would pause for ever")
        self.n, self.limit, self.idle_ms = n, limit, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "id long")
        self.waiting = handle.getListState("waiting", "id long")
        self.now = handle.getValueState("now", "version long, stale long, batch long")

    def load(self):
        version, stale, batch = self.now.get() if self.now.exists() else (0, 0, 0)
        held = lambda s: [r[0] for r in s.get()] if s.exists() else []
        return version, stale, batch, held(self.pending), deque(held(self.waiting))

    def store(self, version, stale, batch, pending, waiting) -> None:
        self.now.update((version, stale, batch))
        for state, ids in ((self.pending, pending), (self.waiting, waiting)):
            state.put([(int(i),) for i in ids]) if ids else state.clear()

    def handleInputRows(self, key, rows, timerValues):
        version, stale, batch, pending, waiting = self.load()
        data = pd.concat(list(rows)).sort_values(["seq", "id"], kind="stable")
        out = []

        def admit(sample: int) -> None:
            nonlocal stale, batch
            pending.append(sample)
            stale += 1
            if len(pending) == self.n:
                out.append((key[0], batch, version, list(pending), False))
                pending.clear()
                batch += 1

        for sample, is_version in zip(data["id"].tolist(), data["is_version"].tolist()):
            if is_version:
                version, stale = version + 1, len(pending)
                while waiting and stale < self.limit:
                    admit(waiting.popleft())
            elif stale < self.limit:
                admit(sample)
            else:
                waiting.append(sample)
        self.store(version, stale, batch, pending, waiting)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.to_datetime(data["ts"]).max().timestamp() * 1000) + self.idle_ms)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        version, _, batch, pending, waiting = self.load()
        rest = [*pending, *waiting]
        parts = [rest[i : i + self.n] for i in range(0, len(rest), self.n)]
        self.store(version, 0, batch + len(parts), [], [])
        yield self.frame([(key[0], batch + k, version, part, True) for k, part in enumerate(parts)])

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BATCH.split(", ")])

    def close(self) -> None:
        return


def assembled(stream: DataFrame, n: int, limit: int, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(queue, batch, version, ids, drained) of a stream with columns queue, id, seq, ts, is_version.

    Rows of a queue come in the order of ``seq`` from one micro-batch to the next, and are put into it
    within one; rows with ``is_version`` tell that the trainer has a new version.  A queue pauses at
    ``limit`` stale samples.  Once the watermark, ``late`` behind the latest row, has passed a
    queue's last row by ``idle``, what it holds goes out in batches marked as drained, the last of which may be
    short.  Start it within ``keyed_state``.
    """
    seconds = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = stream.select("queue", "id", "seq", "ts", "is_version").withWatermark("ts", late)
    return rows.groupBy("queue").transformWithStateInPandas(Assembler(n, limit, seconds), BATCH, "Append", "EventTime")


def last_before(at: pd.Series, times: pd.Series, versions: pd.Series, horizon: pd.Series) -> pd.Series:
    """For each time of ``at`` the version that stands last of ``times``, which go up, at or before it, if it is of the horizon."""
    out = []
    for a, t, v, h in zip(at, times, versions, horizon):
        a, t, v = np.asarray(a, np.int64), np.asarray(t, np.int64), np.asarray(v, object)
        k = np.searchsorted(t, a, "right") - 1
        out.append([v[i] if i >= 0 and t[i] > x - h else None for i, x in zip(k.tolist(), a.tolist())])
    return pd.Series(out, dtype=object)


def with_versions(samples: DataFrame, versions: DataFrame, horizon: str, late: str = "1 hour") -> DataFrame:
    """(queue, id, ts, version): each sample with the last version of its queue at or before it, not
    older than ``horizon``; null without one.

    ``samples``: queue, id, ts; ``versions``: queue, version, ts; both are streams.  Time is cut into spans
    of a horizon: a span's samples meet its versions and those of the span before, once, in the order of time, so that
    state and work grow with the rows, not with their pairs.  A row is given out once the watermarks of both have
    passed its span; rows that are later than ``late`` are left out, and ``late_rows`` tells how many.
    """
    length = int(pd.Timedelta(horizon) / pd.Timedelta(microseconds=1))
    none = F.lit(None).cast("long")
    s = samples.select("queue", "ts", "id", none.alias("version"), F.lit(True).alias("_s")).withWatermark("ts", late)
    v = versions.select("queue", "ts", none.alias("id"), F.col("version").cast("long").alias("version"), F.lit(False).alias("_s")).withWatermark("ts", late)
    x = s.unionByName(v).withColumn("_t", F.unix_micros("ts")).withColumn("_w", F.window("ts", f"{2 * length} microseconds", f"{length} microseconds"))
    x = x.where(~F.col("_s") | (F.col("_t") >= F.unix_micros("_w.start") + length))
    spans = x.groupBy("queue", "_w").agg(
        F.array_distinct(F.collect_list(F.when(F.col("_s"), F.struct("_t", "id", "ts")))).alias("_a"),
        F.array_sort(F.collect_list(F.when(~F.col("_s"), F.struct("_t", "version")))).alias("_b"),
    )
    take = lambda a, name: F.transform(a, lambda e: e[name])
    known = F.when(F.col("queue").isNotNull(), F.col("_b")).otherwise(F.slice("_b", 1, 0))
    found = F.pandas_udf(last_before, "array<long>")(take("_a", "_t"), take(known, "_t"), take(known, "version"), F.lit(length))
    rows = spans.where(F.size("_a") > 0).select("queue", F.explode(F.arrays_zip(F.col("_a").alias("a"), found.alias("v"))).alias("_r"))
    return rows.select("queue", "_r.a.id", "_r.a.ts", F.col("_r.v").alias("version"))


def late_rows(running) -> int:
    """How many rows of a stream came too late, by all operators that keep state."""
    return sum(o["numRowsDroppedByWatermark"] for p in running.recentProgress for o in p["stateOperators"])
