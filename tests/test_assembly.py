"""Batches as state of a stream, across restarts; and samples with their versions."""

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillstream.streaming import assembly as A

ROWS = "queue string, id long, seq long, ts timestamp, is_version boolean"
START = dt.datetime(2024, 1, 1)


def arrivals(n, seed=0):
    rng = random.Random(seed)
    return [(rng.choice("ab"), i, i, START + dt.timedelta(seconds=i), rng.random() < 0.05) for i in range(n)]


def by_hand(rows, n, limit, drain):
    out = []
    for q in sorted({r[0] for r in rows}):
        version, stale, batch, pending, waiting = 0, 0, 0, [], deque()
        for _, i, _, _, is_version in sorted((r for r in rows if r[0] == q), key=lambda r: r[2]):
            if is_version:
                version, stale = version + 1, len(pending)
            else:
                waiting.append(i)
            while waiting and stale < limit:
                pending.append(waiting.popleft())
                stale += 1
                if len(pending) == n:
                    out.append((q, batch, version, pending, False))
                    pending, batch = [], batch + 1
        rest = [*pending, *waiting]
        if drain:
            out += [(q, batch + k, version, rest[i : i + n], True) for k, i in enumerate(range(0, len(rest), n))]
    return sorted(out, key=str)


def stream(spark, folder, schema=ROWS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def write(spark, rows, folder, name, schema=ROWS):
    """One file, later than those before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{name}.tmp"))
    part = next((folder / f"{name}.tmp").glob("part-*"))
    part.rename(folder / f"{name}.parquet")
    for left in (folder / f"{name}.tmp").glob("*"):
        left.unlink()
    for left in (folder / f"{name}.tmp").glob(".*"):
        left.unlink()
    (folder / f"{name}.tmp").rmdir()


def run(spark, df, out, checkpoint):
    running = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def test_batches_are_the_same_after_a_restart(spark, tmp_path):
    rows, source = arrivals(400), tmp_path / "in"
    source.mkdir()
    with A.keyed_state(spark):
        for k in range(4):  # each run starts from the checkpoint of the one before
            write(spark, rows[k * 100 : (k + 1) * 100], source, f"f{k}")
            run(spark, A.assembled(stream(spark, source), 4, 10, "1 day"), tmp_path / "out", tmp_path / "state")
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    want = by_hand(rows, 4, 10, False)
    assert got == want and len(got) > 50 and not any(r[4] for r in got)


def test_an_idle_queue_is_drained_by_a_timer(spark, tmp_path):
    rows, source = arrivals(103, 2), tmp_path / "in"
    source.mkdir()
    write(spark, rows, source, "f0")
    write(spark, [("z", 999, 999, START + dt.timedelta(days=3), False)], source, "f1")  # time goes on
    with A.keyed_state(spark):
        run(spark, A.assembled(stream(spark, source), 4, 6, "1 hour"), tmp_path / "out", tmp_path / "state")
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["queue"] != "z"), key=str)
    assert got == by_hand(rows, 4, 6, True) and any(r[4] for r in got)


def test_a_limit_below_a_batch_is_refused():
    with pytest.raises(ValueError):
        A.Assembler(8, 7, 0)


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    for name in ("s", "v"):
        (tmp_path / name).mkdir()
    at = lambda hours: START + dt.timedelta(hours=hours)
    s, v = "queue string, id long, ts timestamp", "queue string, version long, ts timestamp"
    write(spark, [("a", 1, at(1)), ("a", 2, at(5)), ("b", 3, at(5)), ("a", 4, at(40))], tmp_path / "s", "f0", s)
    write(spark, [("a", 10, at(0)), ("a", 11, at(4)), ("a", 12, at(5)), ("a", 13, at(6)), ("b", 14, at(-30)), ("a", 15, at(200))], tmp_path / "v", "f0", v)
    write(spark, [("a", 5, at(200)), ("b", 9, at(200))], tmp_path / "s", "f1", s)
    write(spark, [("b", 16, at(200))], tmp_path / "v", "f1", v)
    write(spark, [("a", 6, at(2))], tmp_path / "s", "f2", s)  # long after the watermark
    write(spark, [("b", 17, at(201))], tmp_path / "v", "f2", v)
    df = A.with_versions(stream(spark, tmp_path / "s", s), stream(spark, tmp_path / "v", v), "1 DAY")
    running = run(spark, df, tmp_path / "out", tmp_path / "state")
    got = {r["id"]: r["version"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4)} == {1: 10, 2: 12, 3: None, 4: None} and 6 not in got
    assert A.late_rows(running) == 1
    assert spark.conf.get(A.PROVIDER, "").endswith("RocksDBStateStoreProvider") is False
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_results_of_streams_come_from_files(spark, tmp_path):
    """No sink gathers them in the driver; ``complete`` gives what the last batch left, other modes what all did."""
    from pyspark.sql import functions as F

    from quillstream.plans.streams import drained

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    every = drained(source.where("id % 2 = 0"), "append")
    assert sorted(r[0] for r in every.collect()) == list(range(0, 30, 2)) and every.inputFiles()
    counts = drained(source.groupBy((F.col("id") % 3).alias("k")).agg(F.count("*").alias("n")), "complete")
    assert {tuple(r) for r in counts.collect()} == {(0, 10), (1, 10), (2, 10)} and counts.inputFiles()


def test_versions_meet_samples_without_pairs(spark, tmp_path):
    """Spans end where days do: the last version counts at the sample's time, not a day before it, also of the span before;
    no join of samples with versions is planned."""
    for name in ("s", "v"):
        (tmp_path / name).mkdir()
    at = lambda hours: START.replace(hour=0, minute=0, second=0, microsecond=0) + dt.timedelta(hours=hours)
    s, v = "queue string, id long, ts timestamp", "queue string, version long, ts timestamp"
    samples = [("ab"[i % 2], i, at(i * 1.5)) for i in range(80)] + [(None, 900, at(30)), ("c", 901, at(24)), ("c", 902, at(23.999)), ("c", 903, at(49)), ("c", 904, at(48))]
    versions = [("ab"[i % 3 % 2], 1000 + i, at(i * 3 % 31 * 4)) for i in range(40)] + [(None, 1900, at(30)), ("c", 1901, at(24)), ("c", 1902, at(24)), ("c", 1903, at(0))]
    write(spark, samples, tmp_path / "s", "f0", s)
    write(spark, versions, tmp_path / "v", "f0", v)
    write(spark, [("z", 999, at(9999))], tmp_path / "s", "f1", s)
    write(spark, [("z", 1999, at(9999))], tmp_path / "v", "f1", v)
    df = A.with_versions(stream(spark, tmp_path / "s", s), stream(spark, tmp_path / "v", v), "1 DAY")
    assert "Join" not in df._jdf.queryExecution().analyzed().toString()
    run(spark, df, tmp_path / "out", tmp_path / "state")
    got = {r["id"]: r["version"] for r in spark.read.parquet(str(tmp_path / "out")).where("queue IS NULL OR queue <> 'z'").collect()}
    near = lambda q, t: [(w, k) for p, k, w in versions if p is not None and p == q and t - dt.timedelta(days=1) < w <= t]
    assert got == {i: max(near(q, t), default=(None, None))[1] for q, i, t in samples} and got[901] == 1902 and got[904] is None
