"""Ids by a tokenizer file, and runs and digests by ranges."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstream.functions import tokenized as K
from quillstream.operators import curation as C
from quillstream.operators import frame as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
CHAT = "m array<struct<role:string,content:string>>"


def test_ids_are_the_library_s(spark):
    texts = ["Hello, world!", "", None, "é 🙂\n\n x", "<|im_start|>", "a" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    own = Tokenizer.from_file(PATH)
    want = [None if t is None else own.encode(t, add_special_tokens=False).ids for t in texts]
    got = [r[0] for r in df.select(K.token_ids(F.col("t"), PATH)).collect()]
    assert got == want
    back = df.select(K.decoded(K.token_ids(F.col("t"), PATH), PATH)).collect()
    assert [r[0] for r in back] == texts


def test_ids_of_one_width(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([1],), ([],)], "i array<int>")
    for side, cut in (("right", [1, 2, 3]), ("left", [2, 3, 4])):
        got = [(list(r[0]["input_ids"]), list(r[0]["attention_mask"])) for r in df.select(K.fitted(F.col("i"), 3, 9, side)).collect()]
        assert got == [(cut, [1, 1, 1]), ([9, 9, 1], [0, 0, 1]), ([9, 9, 9], [0, 0, 0])]


def test_loss_is_on_what_the_assistant_says(spark):
    chats = [([("system", "Be brief."), ("user", "Hi?"), ("assistant", "Hello there."), ("user", "x"), ("assistant", "")],), ([],), (None,), ([("user", None)],), ([("assistant", "\n\nlater")],)]
    df = spark.createDataFrame(chats, CHAT).coalesce(1)
    r = [x["r"] for x in df.select(K.chat_row(F.col("m"), PATH).alias("r")).collect()]
    own = K.load(PATH, K.SPECIALS)
    whole = [own.decode(x["input_ids"], skip_special_tokens=False) if x else None for x in r]
    assert whole[0] == "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in chats[0][0]) and whole[1:4] == ["", None, "<|im_start|>user\n<|im_end|>\n"]
    said = own.decode([i for i, m in zip(r[0]["input_ids"], r[0]["loss_mask"]) if m], skip_special_tokens=False)
    assert said == "Hello there.<|im_end|>\n<|im_end|>\n" and r[0]["sane"] and r[1]["sane"] and r[2] is None
    assert not r[4]["sane"]  # its line feeds are encoded with the header's
    ids = spark.createDataFrame([([5, 6, 7], [0, 1, 1])], "i array<int>, m array<int>")
    assert list(ids.select(K.said(F.col("i"), F.col("m"))).first()[0]) == [6, 7]


@pytest.mark.parametrize("rows", [1, 7, 50])
def test_runs_of_a_whole_table(spark, monkeypatch, rows):
    """Over ranges of a few rows each, with gaps, nulls and runs that span many ranges."""
    monkeypatch.setattr(B, "RANGE_ROWS", rows)
    rng, key, table = random.Random(rows), "a", []
    for i in range(120):
        key = rng.choice(["a", "b", None]) if rng.random() < 0.2 else key
        table.append((i * i, key))
    df = spark.createDataFrame(table, "row_id long, k string")
    runs, places, last = [], [], object()
    for _, k in table:
        new = k != last
        runs.append(runs[-1] + new if runs else 1)
        places.append(0 if new else places[-1] + 1)
        last = k
    assert [r["run"] for r in B.consecutive_runs(df, "k").orderBy("row_id").collect()] == runs
    assert [r["trajectory"] for r in B.trajectory_index(df, "k").orderBy("row_id").collect()] == places
    assert B.consecutive_runs(df.where("false"), "k").count() == 0


def test_digest_of_a_set_of_ids(spark):
    ids = [3, 70, 71, 200, -5]
    df = spark.createDataFrame([(i,) for i in ids], "i long").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sha("\n".join(sha("\n".join(map(str, part))) for part in ([-5], [3], [70, 71], [200])))
    assert C.keyset_digest(df, "i", 64).first()[0] == want


def test_few_texts_are_encoded_and_decoded_at_once(spark, monkeypatch):
    """The library is called with bounded parts of a batch, and rows stay in order."""
    own, sizes = K.load(PATH), []

    class Told:
        def encode_batch(self, texts, **kw):
            sizes.append(sum(map(len, texts)))
            return own.encode_batch(texts, **kw)

    monkeypatch.setitem(K._loaded, (PATH, ()), Told())
    texts = ["two words " * (k % 7) for k in range(20_000)] + ["long " * 100_000]
    assert [list(x) for x in K.encode(texts, PATH)[:9]] == [own.encode(t, add_special_tokens=False).ids for t in texts[:9]]
    assert sum(sizes) == sum(map(len, texts)) and sorted(sizes)[-2] <= 200_000
    assert [len(x) for x in K.chunks([[0] * 150_000, [], [0] * 60_000], len)] == [2, 1]


def test_batches_are_bounded_by_bytes(spark):
    """Long rows come to a worker in small batches, however many rows a batch may have."""
    import pandas as pd
    from pyspark.sql import functions as F

    from quillstream.plans.queries import QUERIES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "256MB")
        QUERIES["tokenized_texts"](spark, "/root/testdata/sf0.001")

        def held(t: pd.Series) -> pd.Series:
            return pd.Series([int(t.str.len().sum())] * len(t))

        rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 500_000).alias("t"))
        assert rows.select(F.pandas_udf(held, "long")("t").alias("n")).agg(F.max("n")).first()[0] < 10_000_000
    finally:
        spark.conf.set(name, before)
