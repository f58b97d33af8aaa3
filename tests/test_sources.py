"""Scans, preparation and sinks round trips."""

import json

import pytest
from pyspark.sql import functions as F

from quillstream.sources import prepare, scans, sinks


def test_scan_suffixes(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.jsonl").write_text('{"id": 7, "x": "y"}\n')
    assert scans.scan(spark, str(tmp_path / "a.parquet"), str(tmp_path / "b.jsonl")).count() == 4
    with pytest.raises(ValueError):
        scans.scan(spark, "x.csv")


def test_anchor_cache_and_manifest(spark, tmp_path):
    item = {"y0": [1], "y1": [2, 3], "ref0_nll": 1.5, "ref0_token_count": 1, "ref0_ppl": 4.5, "ref1_nll": 2.0, "ref1_token_count": 2, "ref1_ppl": 2.7}
    (tmp_path / "c.json").write_text(json.dumps({"metadata": {"model": "m"}, "items": {"5": item, "9": item}}))
    assert sorted(r["index"] for r in scans.scan_anchor_cache(spark, str(tmp_path / "c.json")).collect()) == [5, 9]
    scans.check_metadata(scans.cache_metadata(spark, str(tmp_path / "c.json")), {"model": "m"})
    with pytest.raises(ValueError):
        scans.check_metadata({"model": "m"}, {"model": "n"})
    (tmp_path / "m.json").write_text('{"indices": [3, 1]}')
    assert sorted(r["index"] for r in scans.scan_manifest(spark, str(tmp_path / "m.json")).collect()) == [1, 3]


def test_split_has_no_overlap(spark):
    train, val = scans.train_val_split(spark.range(100), "id", 10, 3)
    assert val.count() == 10 and train.count() == 90 and train.join(val, "id").isEmpty()


def test_prepare(spark):
    df = spark.createDataFrame([(0, "q", "x #### 1,200")], "row_id long, question string, answer string")
    r = prepare.grade_school_math(df).first()
    assert r["reward_model"]["ground_truth"] == "1200" and r["prompt"][0]["role"] == "user"
    pairs = spark.createDataFrame([(i, "p", "c", "r") for i in range(4)], "row_id long, prompt string, chosen string, rejected string")
    assert prepare.preferences_to_sft(pairs).count() == 8
    a, b = prepare.preference_split(pairs)
    assert (a.count(), b.count()) == (3, 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, float("nan")), (1, 1.5)], "id long, x double")
    digest = sinks.write_canonical(df, str(tmp_path / "o"), "id")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert sorted(lines) == ['{"id":1,"x":1.5}', '{"id":2,"x":null}'] and digest == sinks.write_canonical(df, str(tmp_path / "p"), "id")
    sinks.dump_rollouts(df, str(tmp_path / "d"), 3)
    sinks.dump_rollouts(df, str(tmp_path / "d"), 4)
    assert {r["step"] for r in spark.read.json(str(tmp_path / "d")).collect()} == {3, 4}
    made = []
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert sinks.dump_or_replay(spark, str(tmp_path / "r"), 1, make).count() == 2
    assert len(made) == 1
    assert sinks.flatten_params({"a": {"b": 1}, "c": [1]}) == {"a/b": 1, "c": "[1]"}
    line = spark.range(1).select(sinks.console_line(F.create_map(F.lit("a"), F.lit(1.0)), F.lit(3)).alias("x")).first()["x"]
    assert line == "step:3 - a:1.0"


def test_report(spark, tmp_path):
    for i in (2, 1):
        (tmp_path / f"m{i}.json").write_text(json.dumps({"run": f"r{i}", "rate": i / 2}))
    text = sinks.write_report(spark, [str(tmp_path / f"m{i}.json") for i in (1, 2)], ["run", "rate", "absent"], str(tmp_path / "out"))
    assert text.splitlines()[2:] == ["| r1 | 0.5 |  |", "| r2 | 1.0 |  |"]
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/csv")).count() == 2


def test_makespan(spark):
    df = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 5.0), ("b", 3.0, 4.0)], "endpoint string, start double, end double")
    assert {r["endpoint"]: (r["seconds"], r["requests"]) for r in sinks.makespan(df).collect()} == {"a": (5.0, 2), "b": (1.0, 1)}
