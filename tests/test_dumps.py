"""Rollout dumps as a data source, and table functions."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains
from pyspark.sql.types import StructType

from quillstream.functions import tables as T
from quillstream.sources import dumps as D


def rows(spark, *steps, n=5):
    return spark.createDataFrame([(f"in{s}.{i}", f"out{i}", None, float(i), s) for s in steps for i in range(n)], D.ROWS)


def held(df):
    return sorted(tuple(r) for r in df.select("step", "input", "output", "score").collect())


def test_what_is_dumped_is_read_and_streamed(spark, tmp_path):
    path = str(tmp_path / "dump")
    D.write_dump(rows(spark, 1, 2), path)
    D.write_dump(rows(spark, 3).repartition(3), path)
    want = held(rows(spark, 1, 2, 3))
    assert held(D.read_dump(spark, path)) == want
    for test in ("step = 2", "step > 1", "step >= 2 AND step < 3", "step IN (1, 3)", "step = 2 AND output LIKE '%3%'", "step IS NULL"):
        assert held(D.read_dump(spark, path).where(test)) == held(rows(spark, 1, 2, 3).where(test)), test
    out = D.stream_dump(spark, path).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    out.trigger(availableNow=True).start().awaitTermination()
    assert held(spark.read.parquet(str(tmp_path / "out"))) == want
    D.write_dump(rows(spark, 4), path)
    out.trigger(availableNow=True).start().awaitTermination()  # from where it was
    assert held(spark.read.parquet(str(tmp_path / "out"))) == held(rows(spark, 1, 2, 3, 4))


def test_a_filter_on_the_step_lists_only_its_folders(tmp_path, monkeypatch):
    schema = StructType.fromDDL(D.ROWS)
    for step in range(6):
        (tmp_path / f"step={step}").mkdir()
        (tmp_path / f"step={step}" / D.DONE).write_text('["a.parquet", "b.parquet"]')
    (tmp_path / "step=6").mkdir()  # not done
    (tmp_path / "other").mkdir()
    asked = []
    done = D.Folder.done
    monkeypatch.setattr(D.Folder, "done", lambda self, s: asked.append(s) or done(self, s))
    reader = D.DumpReader(str(tmp_path), schema)
    like = StringContains(("output",), "x")
    assert list(reader.pushFilters([EqualTo(("step",), 3), like])) == [like]
    assert [p.name for p in reader.partitions()] == ["step=3/a.parquet", "step=3/b.parquet"] and asked == [3]
    reader = D.DumpReader(str(tmp_path), schema)
    assert list(reader.pushFilters([GreaterThan(("step",), 3), In(("step",), (4, 6))])) == []
    assert len(reader.partitions()) == 2
    assert D.DumpStream(str(tmp_path), schema).latestOffset() == {"step": 5}


def test_a_step_is_there_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "dump")
    D.write_dump(rows(spark, 1), path)
    with pytest.raises(Exception, match="dumped already"):
        D.write_dump(rows(spark, 1, 2), path)
    assert held(D.read_dump(spark, path)) == held(rows(spark, 1))
    assert not list((tmp_path / "dump" / "step=2").glob("*.parquet"))  # what was written is gone
    D.write_dump(rows(spark, 1, n=2), path, overwrite=True)
    assert held(D.read_dump(spark, path)) == held(rows(spark, 1, n=2)) and len(list((tmp_path / "dump" / "step=1").glob("*.parquet"))) <= 2
    bad = rows(spark, 7).withColumn("score", F.when(F.col("score") > 3, F.raise_error(F.lit("boom"))).otherwise(F.col("score")))
    with pytest.raises(Exception, match="boom"):
        D.write_dump(bad, path)
    assert D.read_dump(spark, path).where("step = 7").count() == 0
    with pytest.raises(Exception, match="without a step"):
        D.write_dump(rows(spark, 1).withColumn("step", F.lit(None).cast("long")), path)


def test_replay_and_other_columns(spark, tmp_path):
    path, made = str(tmp_path / "dump"), []
    make = lambda: made.append(1) or rows(spark, 9).drop("step")
    first = held(D.recorded(spark, path, 9, make))
    assert held(D.recorded(spark, path, 9, make)) == first == held(rows(spark, 9)) and made == [1]
    D.write_dump(rows(spark, 10).drop("gts").withColumn("more", F.lit(1)), path)
    assert D.read_dump(spark, path).where("step = 10 AND gts IS NULL").count() == 5
    assert D.read_dump(spark, path, "step long, more int").where("more = 1").count() == 5
    assert D.read_dump(spark, str(tmp_path / "none")).count() == 0


CHAT = "c long, t long, role string, text string, position string"


def test_turns_follow_their_order(spark):
    T.register(spark)
    df = spark.createDataFrame([(1, 3, "a", "xyz", "p"), (1, 1, "u", "ab", "p"), (1, 2, "u", None, "p"), (2, 1, None, "q", "p"), (None, 1, "u", "r", "p")], CHAT).drop("position")
    got = spark.sql("SELECT c, t, position, ahead, run, follows FROM turn_positions(TABLE(SELECT * FROM {d}), 'c', 't')", d=df).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 0, 0, 1, None), (1, 2, 1, 2, 2, "u"), (1, 3, 2, 2, 1, "u"), (2, 1, 0, 0, 1, None), (None, 1, 0, 0, 1, None)], key=str)
    assert spark.sql("SELECT * FROM turn_positions(TABLE(SELECT * FROM {d}), 'c', 't')", d=df.where("false")).count() == 0
    with pytest.raises(Exception, match="missing columns"):
        spark.sql("SELECT * FROM turn_positions(TABLE(SELECT * FROM {d}), 'x', 't')", d=df).collect()


def test_sessions_in_sql(spark):
    T.register(spark)
    got = spark.sql("SELECT k, x.* FROM VALUES ('a', 2), ('b', 0), (NULL, 1) AS v(k, n), LATERAL session_turns(k, 2, n) AS x").collect()
    assert sorted(r["key"] for r in got) == ["_0_0", "_1_0", "a_0_0", "a_0_1", "a_1_0", "a_1_1"]
