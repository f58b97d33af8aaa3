"""Stages keep the columns, apply their decisions, and take hard rows; SQL cannot express them."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, HARD, SF, empty, hard
from tests.llm.test_operators import check_packing, components_by_hand, dedup_by_hand

from quillstream.llm import core, exact_dedup, mixing, packing

STAGES = dict(corpus_pipeline.STAGES)


def test_stage_order():
    assert list(STAGES) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_stages_on_hard_and_empty_tables(spark):
    for make in (hard, empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            docs = out
        docs.count()


def test_language_stage_drops_what_has_none(spark):
    got = {r["doc_id"] for r in STAGES["language_id"](spark, hard(spark), SF).collect()}
    assert got.isdisjoint({1, 2, 3, 9}) and got >= {10, 12}


def test_dedup_stage(spark):
    got = sorted(r["doc_id"] for r in STAGES["exact_dedup"](spark, hard(spark), SF).collect())
    assert got == sorted({k for _, k, *_ in dedup_by_hand(HARD)})


def test_near_stage(spark):
    got = {r["doc_id"] for r in STAGES["near_dedup"](spark, hard(spark), SF).collect()}
    assert got == {c for _, _, c in components_by_hand(HARD, 5, 80)}


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, SF).persist()
        assert docs.count() > 0.8 * before.count() or name == "near_dedup"
        assert docs.exceptAll(before).isEmpty()
    assert corpus_pipeline.run(spark, SF).agg({"length": "sum"}).first()[0] > 0


def test_null_ids_in_dedup_stages(spark):
    """A null-id copy takes no named row with it, a group without ids keeps one row, and large ids stay exact."""
    big, long = (1 << 53) + 1, " ".join(f"w{i}" for i in range(60))
    rows = [(big, "the cat sat on the mat"), (None, "the cat sat on the mat"), (None, "alone and without an id"), (None, "twice without an id"), (None, "twice without an id"), (5, long), (None, long + " more"), (6, "short"), (None, "sh ort")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    once = {(None, "alone and without an id"), (None, "twice without an id"), (big, "the cat sat on the mat")}
    exact = STAGES["exact_dedup"](spark, docs, SF)
    got = [(r["doc_id"], r["text"]) for r in exact.collect()]
    assert len(got) == 6 and set(got) == once | {(None, "sh ort"), (5, long), (None, long + " more")}
    for start in (exact, docs):
        got = [(r["doc_id"], r["text"]) for r in STAGES["near_dedup"](spark, start, SF).collect()]
        assert len(got) == len(set(got)) and {x for x in got if "short" not in x[1] and "sh ort" not in x[1]} == once | {(5, long)}


def test_null_ids_in_history(spark):
    old = spark.createDataFrame([(None, "a b"), (None, "c"), (9, "d")], "doc_id long, text string")
    past = exact_dedup.distinct_digests(exact_dedup.digest_rows(old))
    new = spark.createDataFrame([(1, "a b"), (2, "d"), (None, "d"), (None, "c")], "doc_id long, text string")
    got = sorted((r["text_sha256"], r["doc_id"] or 0, r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(new, past).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(sha("ab"), 1, 1, 2), (sha("d"), 2, 2, 3), (sha("d"), 0, 2, 3), (sha("c"), 0, None, 2)])


CLASHING = ("_id", "_h", "_k", "_n", "_stays", "_row", "_key", "_size", "_part", "_times", "__own", "size", "shard", "digest", "kept", "source_size", "taken", "component_id")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_clashing_columns_in_stages(spark, name):
    plain = STAGES[name](spark, hard(spark), SF)
    df = hard(spark)
    for c in CLASHING:
        df = df.withColumn(c, df["doc_id"] * 2)
    got = STAGES[name](spark, df, SF)
    assert got.columns == df.columns
    key = lambda r: (r["doc_id"], r["text"] or "", r["lang"] or "")
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))
    assert got.where(" OR ".join(f"{c} <> doc_id * 2" for c in CLASHING)).isEmpty()


def test_mixing_stage_by_hand(spark):
    """Rows come as often as the mix takes them whole, and once more by their draw; sources are near their targets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = STAGES["mixing"](spark, docs, SF)
    times = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    mixed = mixing.mix(docs.withColumn("key", F.xxhash64("doc_id", "text")), key="key").toPandas().set_index("doc_id")
    ids = {r["k"]: r["doc_id"] for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k")).collect()}
    for k, r in mixed.iterrows():
        low = int(r["taken"] // r["size"]) if r["size"] else 1
        assert low <= times.get(ids[k], 0) <= low + (1 if r["size"] and r["taken"] % r["size"] else 0)
    words = F.regexp_count("text", F.lit(core.WORD_RE))
    got = {r["source"]: r["w"] for r in out.groupBy("source").agg(F.sum(words).alias("w")).collect()}
    want = {r["source"]: r["target"] for r in mixing.source_targets(docs.groupBy("source").agg(F.sum(words).alias("source_size"))).collect()}
    # a draw takes whole rows, each of which may miss its part by half its words or so
    spread = {r["source"]: math.sqrt(r["q"]) for r in docs.groupBy("source").agg(F.sum(words * words).alias("q")).collect()}
    assert all(abs(got[s] - want[s]) < 2 * spread[s] for s in want)


def test_mixing_stage_tells_rows_apart(spark):
    """Rows without an id, or that share one, are taken by their own sizes."""
    rows = [(None, f"{'w ' * n}x{n}", "en", "a", 0) for n in (3, 50, 400)] + [(7, "short", "en", "a", 0), (7, "long " * 300, "en", "a", 0), (8, "same", "en", "b", 0), (8, "same", "en", "b", 0)]
    got = Counter((r["doc_id"], len(r["text"])) for r in STAGES["mixing"](spark, spark.createDataFrame(rows, DOCS), SF).collect())
    assert all(n <= 4 for n in got.values()) and len(got) >= 4


def test_packing_stage(spark):
    check_packing(STAGES["packing"](spark, hard(spark), SF).toPandas(), HARD)


def test_scratch_tables_go(spark):
    before = core.staged_so_far()
    kept = core.staged(spark.range(3), "kept")
    core.staged(spark.range(4), "gone")
    core.drop_staged_since(before, kept)
    assert core.staged_so_far() == before + 1 and kept.count() == 3


BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "packing"])
def test_stages_take_small_batches(spark, name):
    """What a Python worker gets at once is bounded in bytes, whatever the rows hold."""
    spark.conf.unset(BATCHES)
    STAGES[name](spark, empty(spark), SF)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))  # 30 MB in one task
    got = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert max(r["n"] for r in got) < 1.5 * core.BATCH_BYTES and sum(r["n"] for r in got) > 30_000_000
    spark.conf.set(BATCHES, "1m")
    STAGES[name](spark, empty(spark), SF)
    assert spark.conf.get(BATCHES) in ("1m", "1048576b")
    spark.conf.unset(BATCHES)


def test_packing_stage_starts_no_other_workers(spark):
    """The numbers of queues come as a local table, not from workers that read pickled rows."""
    plan = STAGES["packing"](spark, hard(spark), SF)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan


def test_packing_stage_frees_its_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "_encoders", {})
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "source": ["a"], "text": ["some words"]})
    for held in (False, True):
        assert len(list(packing._encode(public_tokenizers.path("word_bpe_49k.json"), 1, 10, True, held=held)(iter([rows])))) == 1
        assert len(packing._encoders) == held
