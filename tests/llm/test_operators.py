"""The operators against brute force, and on hard rows: nulls, empties, repeats, clashing names."""

import time
import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tests.llm.helpers import HARD, SF, documents, empty, hard, near_copies
from tokenizers import Tokenizer

from quillstream.llm.core import mix64
from quillstream.llm import components, core, exact_dedup, fingerprints, html_extraction, language_id, lm_scoring, mixing, ngram_join, packing, quality, sharding

DEL = str.maketrans("", "", " \t\n\x0b\x0c\r")


# --- hard rows: every operator runs, keeps every row, and is the same with extra columns

OPERATORS = {
    "dedup": exact_dedup.exact_dedup, "mix": mixing.mix, "lm": lm_scoring.score_texts, "join": ngram_join.jaccard_components, "shard": sharding.shard_rows, "print": fingerprints.fingerprint_rows,
    "lang": language_id.identify, "quality": lambda d: quality.classify(d, d.sparkSession.createDataFrame([(4, 1), (4, 0), (8, None), (99, 1)], "doc_id long, quality int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, name):
    got = OPERATORS[name](hard(spark)).toPandas()
    assert sorted(got["doc_id"]) == sorted(r[0] for r in HARD)
    again = OPERATORS[name](hard(spark, True).repartition(3)).toPandas()
    key = lambda p: sorted(map(repr, p[sorted(p.columns)].values.tolist()))
    assert key(got) == key(again)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](empty(spark)).count() == 0


# --- exact dedup


def dedup_by_hand(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(DEL)].append((-len(t or ""), i))
    return sorted((i, min(groups[k])[1], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, t, *_ in rows for k in [(t or "").translate(DEL)])


@pytest.mark.parametrize("rows", [HARD, None])
def test_exact_dedup(spark, rows):
    df = hard(spark) if rows else spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r)[:3] + (r["text_sha256"],) for r in exact_dedup.exact_dedup(df).collect())
    assert got == dedup_by_hand(rows or documents())


def test_dedup_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.sql(exact_dedup.OP2_SQL).df().sort_values("doc_id").reset_index(drop=True)
    ours = exact_dedup.op2_exact_dedup(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (ours[theirs.columns] == theirs).all().all()


def test_join_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.sql(ngram_join.OP6_SQL).df().sort_values("doc_id").reset_index(drop=True)
    ours = ngram_join.op6_ngram_join(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (ours[theirs.columns] == theirs).all().all()


def test_dedup_against_history(spark):
    old = spark.createDataFrame([(100, "the catsat on the mat  "), (101, "other")], "doc_id long, text string")
    past = exact_dedup.distinct_digests(exact_dedup.digest_rows(old))
    new = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "fresh"), (3, "fresh")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(new, past).collect()}
    assert got == {1: (100, 2), 2: (2, 2), 3: (2, 2)}


def test_the_index_gives_the_answer(spark):
    """Without the index, copies on both sides of history would not be found."""
    rows = exact_dedup.digest_rows(spark.createDataFrame([(i, f"text {i % 10}") for i in range(200)], "doc_id long, text string"))
    old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    past, new = exact_dedup.distinct_digests(rows.where(old)), exact_dedup.distinct_digests(rows.where(~old))
    with_index = {r["group_size"] for r in exact_dedup.resolve(past, new).collect()}
    without = {r["group_size"] for r in exact_dedup.resolve(past.where("false"), new).collect()}
    assert with_index == {20} and max(without) < 20
    # what the slots hold is what comes out
    forged = past.withColumns({"own_id": F.lit(-7).cast("long"), "own_len": F.lit(99).cast("long")})
    assert {r["keep_id"] for r in exact_dedup.resolve(forged, new).collect()} == {-7}


def test_hot_digests_are_told(spark, monkeypatch):
    monkeypatch.setattr(core, "HOT_ROWS", 2)
    got = sorted(tuple(r)[:3] + (r["text_sha256"],) for r in exact_dedup.exact_dedup(hard(spark)).collect())
    assert got == dedup_by_hand(HARD)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    if not n:
        return
    flat, sizes, slot = exact_dedup.build_mph(digests)
    assert sorted(slot.tolist()) == list(range(n))
    assert exact_dedup.slots_of(digests, flat, sizes).tolist() == slot.tolist()


# --- mixing


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: share * w[s] for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("kind", ["hard", "data"])
def test_mixing(spark, kind):
    df = hard(spark) if kind == "hard" else spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(df).toPandas()
    sizes = {None if pd.isna(k) else k: int(v) for k, v in got.groupby("source", dropna=False)["size"].sum().items()}
    want = targets_by_hand(sizes)
    for s, g in got.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert math.isclose(g["target"].iloc[0], want[s], abs_tol=1e-6) and (g["source_size"] == sizes[s]).all()
        assert abs(g["taken"].sum() - want[s]) <= max(32, 0.02 * want[s])
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()


def test_mixing_of_a_small_source_in_a_large_corpus(spark, monkeypatch):
    """A source of short texts meets its target however many shards the others have."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2_000)
    rows = [(i, "w " * 100, "a") for i in range(4000)] + [(10_000 + i, "x y", "b") for i in range(1000)] + [(20_000 + i, "z", "c") for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 1 + 0.01 * r["max(target)"], r


def seats_by_hand(weights, seats):
    won = Counter()
    for _ in range(seats):
        won[min(weights, key=lambda k: (-weights[k] / (2 * won[k] + 1), k))] += 1
    return dict(won)


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_apportionment(spark, seats):
    w = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 24.0, "f": 1.0}
    df = spark.createDataFrame([(k, v, seats) for k, v in w.items()], "k string, w double, n long")
    got = {r["k"]: r["won"] for r in mixing.sainte_lague(df, [], "k", "w", "n", "won").collect() if r["won"]}
    assert got == seats_by_hand({k: v for k, v in w.items() if v}, seats)


# --- language model


@pytest.mark.parametrize("heavy", [500_000, 40])
def test_lm_counts_and_scores(spark, monkeypatch, heavy):
    monkeypatch.setattr(lm_scoring, "HEAVY", heavy)
    monkeypatch.setattr(lm_scoring, "BUCKET_TOKENS", 8_000 if heavy == 40 else 3_000_000)
    got = lm_scoring.op4_lm_scoring(spark, SF).toPandas()
    tokens = {i: [*t.encode().lower().split(), b""] for i, t, *_ in documents()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got.itertuples():
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, held[r.doc_id])
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_lm_learns_order(spark):
    """A held-out text in the order of the training texts is likelier than the same words mixed."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(i, "a b c d e f") for i in ids] + list(zip(held, ["a b c d e f", "f a d b e c", "x y z"]))
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b, c = (got[i]["score"] for i in held)
    assert a > max(b, c) and math.isclose(got[held[0]]["perplexity"], 10 ** (-a / 7))


def test_lm_keeps_every_context(spark):
    """Each of 3,000 words, all equally frequent, has a follower of its own, and the model knows all of them."""
    train = (i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 != 2)
    held = (i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(next(train), f"u{k} v{k}") for k in range(3000) for _ in range(4)]
    asked = {k: (next(held), next(held)) for k in range(0, 3000, 10)}
    rows += [(i, f"u{k} v{(k + j) % 3000}") for k, two in asked.items() for j, i in enumerate(two)]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[a] - got[b] for a, b in asked.values()) > 1.0


class Restaurants:
    """The model by hand: customers are taken out and seated again one by one."""

    def __init__(self, m, types, rng):
        self.m, self.types, self.rng = m, types, rng
        self.child, self.parent = defaultdict(lambda: defaultdict(list)), defaultdict(list)

    def base(self, w):
        n, t = sum(map(sum, self.parent.values())), sum(map(len, self.parent.values()))
        return (sum(self.parent[w]) - self.m["d0"] * len(self.parent[w]) + (self.m["theta0"] + self.m["d0"] * t) / (self.types + 1)) / (self.m["theta0"] + n)

    def seat(self, tables, d, new):
        weights = [x - d for x in tables] + [new]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return tables[k] == 1

    def leave(self, tables):
        k = self.rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def add(self, u, w):
        t = sum(map(len, self.child[u].values()))
        if self.seat(self.child[u][w], self.m["d1"], (self.m["theta1"] + self.m["d1"] * t) * self.base(w)):
            t0 = sum(map(len, self.parent.values()))
            self.seat(self.parent[w], self.m["d0"], (self.m["theta0"] + self.m["d0"] * t0) / (self.types + 1))

    def remove(self, u, w):
        if self.leave(self.child[u][w]):
            self.leave(self.parent[w])

    def p(self, u, w):
        n, t = sum(map(sum, self.child[u].values())), sum(map(len, self.child[u].values()))
        own = sum(self.child[u][w]) - self.m["d1"] * len(self.child[u][w])
        return (own + (self.m["theta1"] + self.m["d1"] * t) * self.base(w)) / (self.m["theta1"] + n) if n else self.base(w)


@pytest.mark.parametrize("heavy", [500_000, 30])
def test_lm_against_the_model_by_hand(spark, monkeypatch, heavy):
    """Scores of held-out texts are near those of a sampler that moves single customers."""
    monkeypatch.setattr(lm_scoring, "HEAVY", heavy)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    after = {w: rng.sample(words, 4) for w in words}
    rows = []
    for i in range(120):
        text = [rng.choice(words)]
        while rng.random() < 0.9 and len(text) < 20:
            text.append(rng.choice(after[text[-1]]) if rng.random() < 0.8 else rng.choices(words, range(1, 31))[0])
        rows.append((i, " ".join(text)))
    report = {}
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), report=report).collect()}
    pairs = {i: list(zip(["", *t.split()], [*t.split(), ""])) for i, t in rows}
    train = [x for i in pairs if not got[i]["held_out"] for x in pairs[i]]
    model = Restaurants(report, len({w for _, w in train}), rng)
    for u, w in train:
        model.add(u, w)
    total = defaultdict(float)
    for sweep in range(30):
        for u, w in train:
            model.remove(u, w)
            model.add(u, w)
        if sweep >= 15:
            for x in {x for i in pairs if got[i]["held_out"] for x in pairs[i]}:
                total[x] += model.p(*x) / 15
    held = [i for i in pairs if got[i]["held_out"]]
    ours, theirs = sum(got[i]["score"] for i in held), sum(math.log10(total[x]) for i in held for x in pairs[i])
    assert len(held) > 5 and abs(ours / theirs - 1) < 0.02, (ours, theirs)
    assert max(abs(got[i]["score"] - sum(math.log10(total[x]) for x in pairs[i])) / len(pairs[i]) for i in held) < 0.1


def test_lm_counts_beyond_32_bits():
    row = lambda b, c: {"bucket": 0, "block": b, "words": lm_scoring._rise(np.array([5, 9], np.uint64)), "n": lm_scoring._squeeze(c, "<u4"), "pairs": lm_scoring._squeeze([1, 1], "<u4"), "ctx": lm_scoring._rise(np.array([7, 7], np.uint64)), "c": lm_scoring._squeeze(c, "<u4")}
    most = (1 << 32) - 1
    data = pa.Table.from_pylist([row(0, [most, 1]), row(1, [6, 1])])
    (merged,) = lm_scoring._merge(1)(data).to_pylist()
    n, word, ctx, c = lm_scoring._unpack(merged)
    assert n.tolist() == c.tolist() == [(1 << 32) + 5, 2] and merged["tokens"] == (1 << 32) + 7
    (part,) = lm_scoring._parts(merged, [c, c > 0], 1)
    assert lm_scoring._open(part["v"], "<i8").tolist() == [(1 << 32) + 7, 2]


def test_packed_numbers():
    rng = np.random.default_rng(2)
    for kind in ("<u4", "<i8", "<f4"):
        for n in (0, 1, 1000):
            x = (rng.random(n) * 1e6).astype(kind)
            assert (lm_scoring._open(lm_scoring._squeeze(x, kind), kind) == x).all()
    h = rng.integers(0, 1 << 63, 50, np.uint64) * np.uint64(2)
    assert (lm_scoring._risen(lm_scoring._rise(h)) == h).all() and len(lm_scoring._risen(lm_scoring._rise(h[:0]))) == 0


def test_tables_beyond_the_exact_draw():
    """The mean of tables of 1,000 customers, of which the first STIRLING are drawn exactly."""
    for d, a in ((0.5, 1.0), (0.8, 30.0), (0.3, 200.0)):
        exact = lm_scoring.log_stirling(d, 1000)[1000, 1:] + np.log(a) * np.arange(1, 1001)
        p = np.exp(exact - exact.max())
        mean = (p / p.sum() * np.arange(1, 1001)).sum()
        t = lm_scoring.draw_tables(np.full(4000, 1000), np.full(4000, a), d, lm_scoring.log_stirling(d), np.random.default_rng(1))
        assert abs(t.mean() / mean - 1) < 0.04, (d, a, t.mean(), mean)


def test_stirling_numbers_and_tables():
    d, s = 0.5, lm_scoring.log_stirling(0.5, 6)
    assert np.allclose(np.exp(s[3, 1:4]), [(1 - d) * (2 - d), 3 * (1 - d), 1.0])
    rng = np.random.default_rng(0)
    c = np.full(20000, 3)
    t = lm_scoring.draw_tables(c, np.full(20000, 2.0), d, lm_scoring.log_stirling(d), rng)
    p = np.exp(s[3, 1:4]) * 2.0 ** np.arange(1, 4)
    assert np.allclose(np.bincount(t, minlength=4)[1:] / 20000, p / p.sum(), atol=0.02)
    big = lm_scoring.draw_tables(np.array([1, 0, 5000]), np.array([1.0, 1.0, 1.0]), d, lm_scoring.log_stirling(d), rng)
    assert big[0] == 1 and big[1] == 0 and 1 <= big[2] <= 5000


def test_a_hundred_thousand_sources(spark):
    """Targets by water-filling on one list, and the mix of a table with as many sources."""
    n = 100_000
    sizes = spark.range(n).selectExpr("concat('s', lpad(id, 6, '0')) AS source", "1 + (id * 7919) % 97 AS source_size")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    size = {f"s{i:06}": 1 + (i * 7919) % 97 for i in range(n)}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(size))}
    left, weights = 1.5 * sum(size.values()), sum(weight.values())
    for s in sorted(size, key=lambda s: 2 * size[s] / weight[s]):
        if 2 * size[s] / weight[s] > left / weights:
            break
        left, weights = left - 2 * size[s], weights - weight[s]
    for s in size:
        assert got[s] == pytest.approx(min(2 * size[s], left / weights * weight[s]))
    docs = spark.range(n).selectExpr("id AS doc_id", "repeat('word ', 20) AS text", "concat('s', id) AS source").union(
        spark.range(30_000).selectExpr("id AS doc_id", "repeat('word ', 20) AS text", "'hot' AS source")
    )
    taken = mixing.mix(docs).groupBy(F.col("source") == "hot").agg(F.sum("taken"), F.sum("size"), F.max(F.col("taken") / F.col("size")), F.count("*"), F.max("target")).collect()
    by = {r[0]: r for r in taken}
    assert {r[4] for r in taken} == {n, 30_000} and max(r[3] for r in taken) <= 2
    assert by[True][1] == pytest.approx(by[True][5], rel=0.01) and by[True][1] + by[False][1] == pytest.approx(1.5 * 20 * (n + 30_000), rel=0.02)


def test_one_id_of_many_rows_lies_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    docs = spark.range(2000).selectExpr("CAST(NULL AS long) AS doc_id", "concat(repeat('word ', 20), id) AS text", "'a' AS source")
    got = mixing.mix(docs).agg(F.sum("taken"), F.max("target"), F.count("*")).first()
    assert got[0] == pytest.approx(got[1], rel=0.02) and got[2] == 2000


def test_shards_follow_the_larger_side(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 100)
    seen = []
    build = exact_dedup.build_index
    monkeypatch.setattr(exact_dedup, "build_index", lambda past, shards: seen.append(shards) or build(past, shards))
    rows = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    past = exact_dedup.distinct_digests(exact_dedup.digest_rows(rows.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") - 50)))
    got = exact_dedup.exact_dedup(rows, past)
    assert got.where("group_size = 2 AND keep_id < 0").count() == 10 and got.where("kept").count() == 1990
    assert seen == [21]


# --- packing


def check_packing(got, rows, tokenizer="word_bpe_49k.json", length=2048):
    """Every id in one piece, sequences full and gapless; only the last is cut into powers of two."""
    t = Tokenizer.from_file(public_tokenizers.path(tokenizer))
    ids = [(r[0], np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")) for r in rows]
    of = defaultdict(list)
    for i, x in ids:
        of[i].append(x)
    copies = defaultdict(Counter)
    for r in got.itertuples():
        hit = [x for x in of[r.doc_id] if r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())]
        assert hit and r.length > 0
        copies[r.doc_id].update(range(r.start, r.start + r.length))
    for i, xs in of.items():
        assert copies[i] == sum((Counter(range(len(x))) for x in xs), Counter())
    sizes = []
    for k, g in sorted(got.groupby("sequence_id")):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and k == len(sizes)
        sizes.append(int(g["length"].sum()))
    assert sizes == packing.sequence_sizes(sum(len(x) for _, x in ids), length)


@pytest.mark.parametrize("kind, group, queues, window", [("hard", 1 << 20, 50_000, 1), ("hard", 4096, 50_000, 2), ("hard", 2048, 2, 1), ("data", 1 << 20, 50_000, 1), ("data", 8192, 2, 1)])
def test_packing(spark, monkeypatch, kind, group, queues, window):
    monkeypatch.setattr(packing, "GROUP_TOKENS", group)
    monkeypatch.setattr(packing, "QUEUES", queues)
    monkeypatch.setattr(packing, "TOLD_OFFSETS", 0 if queues == 2 else 10_000)
    df = hard(spark, True).repartition(3) if kind == "hard" else spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(packing.pack(df, window=window).toPandas(), HARD if kind == "hard" else documents())


def test_packing_with_another_tokenizer(spark):
    assert not packing.is_known(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(packing.pack(hard(spark), tokenizer=public_tokenizers.path("byte_bpe_50k.json")).toPandas(), HARD, "byte_bpe_50k.json")


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_every_sequence_has_its_shares(spark, monkeypatch, weights):
    """A table laid out by source: each full sequence still has the shares, as long as both sources last."""
    monkeypatch.setattr(packing, "GROUP_TOKENS", 16_384)
    rows = [(i, f"{'ab'[i // 1000]} word " * (20 + i % 50), "ab"[i // 1000]) for i in range(2000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1), weights=weights).toPandas()
    check_packing(got, rows)
    got["a"] = got["length"].where(got["doc_id"] < 1000, 0)
    of = got.groupby("sequence_id")[["a", "length"]].sum()
    full = of[of.length == 2048]
    if weights is None:
        share = got["a"].sum() / got["length"].sum()
        assert (full["a"] / 2048 - share).abs().max() < 0.08 and abs((full["a"] / 2048).mean() - share) < 0.01
    else:
        both = full.iloc[: int(got["a"].sum() / 0.75 / 2048) - 2]
        assert (both["a"] / 2048 - 0.75).abs().max() < 0.08 and abs((both["a"] / 2048).mean() - 0.75) < 0.005


@pytest.mark.parametrize("n", [20, 100])
def test_windows_follow_many_sources(spark, n):
    """As shipped: windows of 20 and of 100 equal sources lie within 0.02 of the shares."""
    rows = [(i, f"w{i % n} is a word " * (30 + i % 40), f"s{i % n}") for i in range(4000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    check_packing(got, rows)
    got["source"] = got["doc_id"] % n
    share = got.groupby("source")["length"].sum() / got["length"].sum()
    table = got.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    table = table[table.sum(axis=1) == 2048].iloc[:-1] / 2048
    assert ((table - share).abs().sum(axis=1) / 2).mean() < 0.02


def test_pieces_are_laid_out_as_one_by_one():
    rng = np.random.default_rng(0)
    for _ in range(50):
        gives = rng.integers(0, 9, (rng.integers(1, 6), rng.integers(1, 5)))
        gives[0, gives.sum(0) == 0] = 1
        lengths = [list(rng.multinomial(t, [1 / 3] * 3)) for t in gives.sum(0)]
        lengths = [[x for x in q if x] for q in lengths]
        bounds = np.cumsum([0, *[x for q in lengths for x in q]])[:-1]
        first, edges = 5, np.arange(0, 200, 7)
        want, place, starts, done = [], first, np.cumsum(gives.sum(0)) - gives.sum(0), np.zeros(gives.shape[1], int)
        for row in gives:
            for q, n in enumerate(row):
                for _ in range(n):  # token by token
                    at = int(starts[q] + done[q])
                    if want and want[-1][0] + want[-1][2] == at and at not in bounds and place not in edges and done[q] and fresh is False:
                        want[-1][2] += 1
                    else:
                        want.append([at, place, 1])
                    fresh, done[q], place = False, done[q] + 1, place + 1
                fresh = True
        got = packing.lay_out(bounds, gives, first, edges)
        assert [list(x) for x in zip(*(g.tolist() for g in got))] == want


def test_packing_of_nothing(spark):
    assert packing.pack(empty(spark)).count() == 0


def test_windows_follow_shares():
    left = np.array([50_000, 30_000, 20_000])
    got = list(packing.fill_windows(left, left / left.sum(), np.zeros(3), 10_000))
    assert np.sum(got, 0).tolist() == left.tolist() and all(abs(g - [5000, 3000, 2000]).max() <= 1 for g in got)
    slow = list(packing.fill_windows(np.array([990_000, 10_000]), np.array([0.99, 0.01]), np.zeros(2), 2048, quantum=64))
    assert {int(g[1]) for g in slow[:-1]} <= {0, *range(64, 90)} and abs(np.cumsum([g[1] for g in slow])[200] - 0.01 * 201 * 2048) < 90
    dry = list(packing.fill_windows(np.array([100, 0, 5000]), np.array([0.5, 0.3, 0.2]), np.zeros(3), 1000))
    assert all(g.sum() == 1000 for g in dry[:-1]) and np.sum(dry, 0).tolist() == [100, 0, 5000]


def test_word_ids_are_the_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    w, t = packing.WordIds(path), Tokenizer.from_file(path)
    texts = ["é", "École straße ÷ naïve... it's don't I'M a.b,c!! 12,5 x² ß ſ ﬁ İ ÿ", "", "  \n", "foo-bar_baz <|endoftext|> café 日本語 🙂 a b\x1cc\x85d", "Ελλάς ΣΟΦΟΣ", "word.\tword,word. 'tis", "a" * 300, "a, b, c. d.. e), (f). g!", " x", "y\n", "A.\nB,\n C"]
    ids, n = w(pa.array([*texts, None]), 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x, add_special_tokens=False).ids + [1] for x in [*texts, ""]]


# --- n-gram join


def components_by_hand(rows, words, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return sorted((r[0], len(s), find(r[0])) for r, s in zip(rows, sets))


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 60)])
def test_ngram_join(spark, words, percent):
    rows = [(i, t) for i, t in enumerate(near_copies(words))] + [(1000 + r[0], r[1]) for r in HARD]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert sorted(map(tuple, got)) == components_by_hand(rows, words, percent)


@pytest.mark.parametrize("size", [60, 400])
def test_ngram_join_in_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(ngram_join, "PIECE_SHINGLES", size)
    monkeypatch.setattr(ngram_join, "TASK_SHINGLES", 500)
    monkeypatch.setattr(core, "HOT_ROWS", 3)
    rows = [(i, t) for i, t in enumerate(near_copies(9))]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == components_by_hand(rows, 3, 90)


def test_shared_passages_do_not_grow_a_component(spark, monkeypatch):
    """Documents that share passages only are one component of candidates, which is taken apart
    before sets meet in pieces; copies within it stay together, rows that repeat an id too."""
    rng = random.Random(4)
    passages = [[f"p{k}x{rng.randrange(10**6)}" for _ in range(60)] for k in range(41)]
    rows = [(k, " ".join(passages[k] + passages[k + 1] + [f"d{k}x{i}" for i in range(60)])) for k in range(40)]
    rows += [(100 + k, rows[k][1].replace(f"d{k}x7 ", "other ")) for k in range(0, 40, 4)] + [rows[3]]
    pieces = []
    joined = ngram_join.link_large
    monkeypatch.setattr(ngram_join, "PIECE_SHINGLES", 2000)
    monkeypatch.setattr(ngram_join, "link_large", lambda sets, percent: [pieces.append(sets.count()), joined(sets, percent)][1])
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(map(tuple, got)) == components_by_hand(rows, 5, 80)
    assert not pieces


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_segments_share_a_key(percent):
    """Sets at the very edge of the threshold have an equal key, whatever their sizes."""
    rng = np.random.default_rng(percent)
    cut = ngram_join.Segments(percent)
    for n in [1, 2, 3, 5, 9, 10, 19, 20, 50, 99, 200, 1000] * 4:
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        most = n * (100 - percent) // percent
        drop = int(rng.integers(0, most + 1))
        for removed in range(drop + 1):
            added = int(most - removed)
            b = np.unique(np.concatenate([a[rng.permutation(n)[removed:]], rng.integers(0, 1 << 63, max(0, added), np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if len(b) and 100 * inter >= percent * (len(a) + len(b) - inter):
                assert np.isin(cut.keys(a), cut.keys(b)).any(), (n, removed, added)


def test_lists_are_combined():
    """What blocks send of their segments gives the least sets that all entries give."""
    rng = np.random.default_rng(3)
    key, node = rng.integers(0, 40, 300).astype(np.uint64), rng.integers(-50, 50, 300)
    least = {}
    for block in np.array_split(np.arange(300), 7):
        k, v, edges = ngram_join._lists(key[block], node[block])
        assert (np.diff(k.astype(np.int64)) > 0).all() and (edges[:, 0] > edges[:, 1]).all()
        for a, b in zip(k.tolist(), v.tolist()):
            least[a] = min(least.get(a, b), b)
    assert least == {k: int(node[key == k].min()) for k in set(key.tolist())}


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_small_sets_have_common_variants(percent):
    """Small sets need no key that unlike ones share, and every linked pair has one of its own."""
    cut = ngram_join.Segments(percent)
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.choice(30, n, False)).astype(np.uint64) for n in rng.integers(1, cut.partner + 1, 600)]
    keys = [cut.keys(s) for s in sets]
    assert max(cut.variants_of(len(s)) for s in sets) <= ngram_join.VARIANTS
    linked = 0
    for i in range(600):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                linked += 1
                assert np.isin(keys[i], keys[j]).any()
    assert linked


@pytest.mark.parametrize("hot", [50_000, 2])
def test_connected_components(spark, monkeypatch, hot):
    monkeypatch.setattr(core, "HOT_ROWS", hot)
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(500, 540)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r["u"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


# --- sharding


def jump_by_hand(key, n):
    m = (1 << 64) - 1
    k = (key + 0x9E3779B97F4A7C15) & m
    k ^= k >> 30
    k = k * 0xBF58476D1CE4E5B9 & m
    k ^= k >> 27
    k = k * 0x94D049BB133111EB & m
    k ^= k >> 31
    b, j = -1, 0
    while j < n:
        b = j
        k = (k * 2862933555777941757 + 1) & m
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, -1, 12345, 1 << 62, *range(1000)])
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_hash(keys, n).tolist() == [jump_by_hand(int(k), n) for k in keys]
    a, b = sharding.jump_hash(np.arange(90_000), 8), sharding.jump_hash(np.arange(90_000), 9)
    assert set(b[a != b]) == {8} and 0.1 < (b == 8).mean() < 0.122
    assert np.bincount(a).max() < 1.03 * 90_000 / 8


@pytest.mark.parametrize("slots", [50_000, 3])
def test_shard_rows(spark, monkeypatch, slots):
    monkeypatch.setattr(sharding, "SLOT_ROWS", slots)
    got = sharding.shard_rows(hard(spark)).toPandas()
    for r in HARD:
        same = got[got.doc_id == r[0]]
        assert (same["size"] == len((r[1] or "").encode()) + 1).all() and (same["text_crc32"] == zlib.crc32((r[1] or "").encode())).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (got["law"] == "key").all()


def test_written_shards(spark, tmp_path):
    sharding.write_shards(hard(spark), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(HARD)


# --- fingerprints


def prefix_by_hand(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def likeness_by_hand(a, b):
    """From the texts themselves, without prefix hashes: spans, the least of each bin, knots."""
    if a == b:
        return 1.0
    bins = []
    for t in (a, b):
        least = {}
        w = min(fingerprints.SPAN, len(t))
        for i in range(len(t) - w + 1 if t else 0):
            h = 0
            for p, base in zip(fingerprints.PRIMES, fingerprints.BASES):
                h = h << 31 | sum((ord(c) + 1) * pow(base, k, p) for k, c in enumerate(t[i : i + w])) % p
            h = int(mix64(np.array([h], np.uint64))[0])
            least[h >> 58] = min(least.get(h >> 58, h), h)
        bins.append(least)
    used = set(bins[0]) | set(bins[1])
    j = sum(bins[0].get(k) == bins[1].get(k) for k in used) / max(1, len(used))
    common = prefix_by_hand(a, b)
    return max(2 * j / (1 + j), max([k for k in fingerprints.KNOTS.tolist() if k <= common], default=0) / max(1, len(a), len(b)))


@pytest.mark.parametrize("size, repeated", [(1, False), (60, False), (10_000_000, False), (50, True)])
def test_fingerprints(spark, monkeypatch, size, repeated):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", size)
    monkeypatch.setattr(fingerprints, "TASK_ROWS", 5)
    key = lambda t: xxhash.xxh64(t.encode(), 42).intdigest() - (1 << 64) * (xxhash.xxh64(t.encode(), 42).intdigest() >> 63)
    rows = [(i % 3 if repeated and i else i, t or "") for i, t, *_ in HARD if i != 10 or not repeated]
    rows.sort(key=lambda r: (r[0], key(r[1])))
    df = spark.createDataFrame([(i, t or None) for i, t in rows], "doc_id long, text string")
    got = sorted((r["doc_id"], key_of, r) for r in fingerprints.fingerprint_rows(df.repartition(3)).collect() for key_of in [(r["n_chars"], r["edited_sha256"], r["near_next"])])
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        short = len(t) < 2000
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), prefix_by_hand(t, edited), prefix_by_hand(t, after), likeness_by_hand(t, edited) if short else None, likeness_by_hand(t, after) if short else None))
    assert sorted(w[:5] for w in want) == sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["prefix_edited"], r["prefix_next"]) for _, _, r in got)
    by_hand = sorted((w[0], w[2], round(w[5], 9), round(w[6], 9)) for w in want if w[5] is not None)
    assert by_hand == sorted((r["doc_id"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for _, _, r in got if r["n_chars"] < 2000)
    prints = defaultdict(set)
    for _, _, r in got:
        prints[r["doc_id"]].add(r["fingerprint"])
    assert repeated or prints[4] == prints[5] != prints[6]


def test_fingerprints_of_chunks():
    """A range whose columns come in several chunks keeps all of its rows."""
    pack = zstandard.ZstdCompressor().compress
    part = lambda a, b: pa.table({"bucket": pa.array([0] * (b - a), pa.int32()), "doc_id": range(a, b), "tail": [False] * (b - a), "k": range(a, b), "packed": [pack(f"text of {i}".encode()) for i in range(a, b)]})
    data = pa.concat_tables([part(0, 5), part(5, 9), part(9, 10)])
    assert data.column("packed").num_chunks == 3 and fingerprints._table_prints(data).column("doc_id").to_pylist() == list(range(9))


def test_ranges_of_ids():
    rng = np.random.default_rng(1)
    rows = sorted((int(i), int(k)) for i, k in zip(rng.integers(0, 20, 400), rng.integers(-50, 50, 400)))
    edges = [rows[0], *sorted(set(rows[40::40]))]
    got = fingerprints.range_of(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert got.tolist() == [max(k for k, e in enumerate(edges) if e <= r) for r in rows]


def test_likeness_follows_what_is_shared():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(97, 123, 4000).astype(np.uint32) for _ in range(2))
    p = lambda x: fingerprints.sketch(fingerprints.Prefixes(x))
    half = np.concatenate([a[:2000], b[:2000]])
    near, shifted = a.copy(), np.concatenate([b[:10], a])
    near[[100, 2000, 3000]] = 33
    assert fingerprints.likeness(p(a), p(a)) == 1.0 and fingerprints.likeness(p(a), p(b)) < 0.1
    assert 0.3 < fingerprints.likeness(p(a), p(half)) < 0.7 and 0.9 < fingerprints.likeness(p(a), p(near)) < 1.0 and fingerprints.likeness(p(a), p(shifted)) > 0.9
    x = fingerprints.parse(str(p(a)))
    assert fingerprints.likeness(x, p(a)) == 1.0 and x.n == 4000 and (x.bins == p(a).bins).all() and (x.knots == p(a).knots).all()
    assert fingerprints.common_prefix(p(a), p(half)) == max(k for k in fingerprints.KNOTS.tolist() if k <= 2000)


def test_spans_and_extensions():
    text = "abracadabra abracadabra!"
    x = fingerprints.Prefixes(fingerprints.code_points(text))
    for i in range(len(text)):
        for j in range(len(text)):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            assert fingerprints.common_extension(x, i, x, j) == n
    assert x.span(0, 11) == x.span(12, 23) and x.span(0, 4) != x.span(1, 5)


# --- quality and language


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op9_quality(spark, sf).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    out = got[got.held_out].merge(labels, on="doc_id")
    assert (out["predicted"] == out["quality"]).mean() >= 0.9
    assert out[out.quality == 1]["predicted"].mean() == 1.0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:2000], y[:2000])
    assert {tuple(p[:2]) for p in m["pairs"]} >= {(0, 1)}
    assert ((quality.score_all(x[2000:], **m) > 0) == y[2000:]).mean() > 0.9


def test_additive_scores_by_hand():
    """Vectorised bin additions against a lookup for each feature and pair of each row."""
    rng = np.random.default_rng(7)
    x = rng.random((400, 3))
    m = quality.fit(x, ((x[:, 0] > 0.4) & (x[:, 1] > 0.3) | (x[:, 2] > 0.9)).astype(float))
    bin_of = lambda edges, v: sum(v >= e for e in edges)
    assert m["pairs"]
    for row, got in zip(x[:60], quality.score_all(x[:60], **m)):
        want = m["base"] + sum(t[bin_of(e, v)] for e, t, v in zip(m["edges"], m["tables"], row))
        want += sum(t[bin_of(m["coarse"][i], row[i])][bin_of(m["coarse"][j], row[j])] for i, j, t in m["pairs"])
        assert math.isclose(got, want, rel_tol=1e-9)


def test_trees_by_hand():
    """The best split of ordered bins, found by trying all of them."""
    rng = np.random.default_rng(2)
    g, h, n = rng.normal(size=12), rng.random(12) + 0.5, np.full(12, 20)
    got = quality.tree(g, h, n, leaves=2)
    value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
    cut = max(range(1, 12), key=lambda k: value(0, k) + value(k, 12))
    want = [g[a:b].sum() / (h[a:b].sum() + 1.0) for a, b in ((0, cut), (cut, 12)) for _ in range(a, b)]
    assert np.allclose(got, want)


def ngrams_by_hand(text):
    """Counts of hashed 1- to 3-grams, one n-gram at a time."""
    marks = [ord(c) if unicodedata.category(c)[0] == "L" else 32 for c in text.lower()]
    marks = [32, *marks, 32]
    marks = [c for i, c in enumerate(marks) if not (c == 32 and i and marks[i - 1] == 32)]
    out = Counter()
    for n in language_id.ORDERS:
        for i in range(len(marks) - n + 1):
            h = 0
            for c in marks[i : i + n]:
                h = (h * 0x01000193 ^ c * 0x9E3779B1) & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
            out[h >> 18] += 1
    return out


def test_language_scores_by_hand():
    rng = np.random.default_rng(4)
    model = {"names": ["a", "b", "c"], "idf": rng.random(language_id.DIMS).astype(np.float32) + 1, "w": rng.normal(size=(language_id.DIMS, 3)).astype(np.float32), "b": rng.normal(size=3), "t": 0.7}
    texts = ["The cat, the dog.", "été à la plage!! 42", "ß", "日本語 text", "  x  ", "1234", "", None]
    names, scores = language_id.predict(texts, model)
    for text, name, score in zip(texts, names, scores):
        if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        count = ngrams_by_hand(text)
        assert {k: v for k, v in enumerate(language_id.counts(text).tolist()) if v} == dict(count)
        v = {k: math.log1p(n) * float(model["idf"][k]) for k, n in count.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        logit = [(sum(x / norm * float(model["w"][k, y]) for k, x in v.items()) + model["b"][y]) / 0.7 for y in range(3)]
        p = [math.exp(z - max(logit)) for z in logit]
        assert name == "abc"[p.index(max(p))] and math.isclose(score, max(p) / sum(p), rel_tol=1e-4)


def test_temperature_by_hand():
    rng = np.random.default_rng(0)
    logits, y = rng.normal(size=(200, 3)) * 5, rng.integers(0, 3, 200)
    loss = lambda t: -np.mean([z[k] / t - math.log(sum(math.exp(x / t) for x in z)) for z, k in zip(logits, y)])
    grid = np.geomspace(0.05, 20, 121)
    assert math.isclose(language_id.temperature(logits, y), min(grid, key=loss), rel_tol=1e-9)


def test_language_on_held_out_rows(spark):
    got = language_id.op10_language_id(spark, SF).toPandas().merge(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").df(), on="doc_id")
    out = got[got.held_out]
    assert (out["lang_pred"] == out["lang"]).mean() >= 0.97 and got["score"].between(0, 1).all()


def test_language_of_texts_without_letters(spark):
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(hard(spark)).collect()}
    assert {i for i, p in got.items() if p == "und"} == {1, 2, 3, 9}


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{x}</style><script>var a="</p><p>no";</script></head><body class="page has-sidebar">
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div id="cookie-notice">We use cookies on this site and you can say no to them all if you like.</div>
<main><h1>A short title</h1><p>The cat &amp; the dog sat   on the mat for all of the day, and it was a good day for them to be in.
<p>Tiny.<br>Line <b>two</b><p><a href="/x">Read more of this and that here on another page of the site</a></p>
<form><p>Your name please, so that we can send you all of the news of the week</p></form>
<div class="ad">Buy the best of all things now at the shop in the town for less than that</div>
<p>Caf&eacute; &#233;t&#x00E9; and the rest of it is here to be read by those who are in the room with us.</p></main>
<section class="comments"><p>It was a very good post and I have read all of it to the end with my friends</p></section>
<aside>The side of the page has the links to all of the other things</aside><footer>&copy; all of the rights</footer></body></html>"""


def test_extraction():
    assert html_extraction.extract(PAGE).split("\n") == [
        "A short title",
        "The cat & the dog sat on the mat for all of the day, and it was a good day for them to be in.",
        "Tiny. Line two",
        "Café été and the rest of it is here to be read by those who are in the room with us.",
    ]


def test_extraction_without_an_article():
    page = "<div class=menu><a href=1>One</a></div><div>The man in the house was not at home when they came to see him, and so it was for all of that week.</div><div>Short one.</div><div>It is the end of the story of the man in the house, which has been told to them all by now.</div><ul><li><a href=2>Two of the links in a list of them</a></ul>"
    assert html_extraction.extract(page).split("\n")[1] == "Short one." and len(html_extraction.extract(page).split("\n")) == 3


@pytest.mark.parametrize("page", ["", "<", "<!--", "<p", "text only", "<script>x", "<div>" * 3000, "&#xD800; &bad; &amp", "<a href='>'>x</a>", "<p>" + "word " * 50_000])
def test_broken_pages(page):
    assert isinstance(html_extraction.extract(page), str)


def test_pages_query(spark):
    got = html_extraction.op1_html_extraction(spark, SF).toPandas()
    assert (got["n_chars"] == got["text"].str.len()).all() and (got["n_chars"] > 0).all()
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    assert [r["text"] for r in html_extraction.extract_text(df).collect()] == ["", "", ""]
    assert html_extraction.extract_text(df.where("false")).count() == 0


def test_holds_every_article_paragraph():
    """The paragraphs of the article are all there and nothing of menus, adverts and footers is."""
    import html as H
    import re

    for (page,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        text = html_extraction.extract(page)
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<p>|</p>|</?h1>", article)]
        assert text.split("\n") == [x for x in want if x]


LINE = "The man in the house was not at home when they came to see him, and so it was for all of that week."
FOREIGN = {
    "ru": "Это было давно и неправда, потому что мы жили тогда в большом городе на берегу реки и не знали забот.",
    "zh": "这是一个关于城市历史的故事，讲述了人们如何在河边建立家园。后来城市逐渐扩大，人口不断增加，成为著名的商业中心。",
    "ar": "كانت المدينة القديمة تقع على ضفة النهر الكبير، وكان الناس يعيشون فيها حياة بسيطة وهادئة منذ زمن بعيد.",
}


@pytest.mark.parametrize("line", FOREIGN.values(), ids=FOREIGN.keys())
def test_pages_of_languages_without_a_list(line):
    page = f'<div class="menu"><a href="/a">{line}</a></div><div><p>{line}</p><p>{line}</p><p>{line[:9]}</p><p>{line}</p></div><div class="footer">{line}</div>'
    assert html_extraction.extract(page).split("\n") == [line, line, line[:9].strip(), line]


@pytest.mark.parametrize("page, want", [
    (f'<article class="post tag-search category-legal"><p>{LINE}</p></article>', [LINE]),
    (f'<div class="share-price"><p>{LINE}</p></div>', [LINE]),
    (f'<div id="search-page-form"><p>{LINE}</p></div><div class="search-form">{LINE}</div>', [LINE, LINE]),
    (f'<p>{LINE}</p><p>{LINE}</p><div class="search-form">{LINE}</div>', [LINE, LINE]),
    (f'<p><a href="/x">one</p><p>{LINE}</p><p>{LINE}</p>', [LINE, LINE]),
    (f'<div><p>{LINE}</p><p>{LINE} {LINE}</p></div><article><a href="/t">Teaser</a><p>{LINE}</p></article>', [LINE, f"{LINE} {LINE}", LINE]),
    (f'<article><header><h1>Title</h1><p>By me</p></header><p>{LINE}</p><figure><figcaption>Of it.</figcaption></figure></article>', ["Title", LINE, "Of it."]),
    (f'<p class="a>{LINE}</p><p class="b">{LINE}</p>', [LINE, LINE]),
    (f'<script src=/a/>code</script><p>{LINE}</p>', [LINE]),
    (f'<p>{LINE} <![CDATA[abcdef', [f"{LINE} abcdef"]),
    (f'<form id="aspnetForm"><p>{LINE}</p><p>{LINE}</p><input></form><div class="copyright">{LINE}</div>', [LINE, LINE]),
    (f'<article><p>{LINE}</p></article><div id="comments"><article class="comment-body"><p>{LINE} {LINE} {LINE}</p></article></div>', [LINE]),
    (f'<p>A <svg><p>no</p></svg>b. {LINE}</p><button>press</button>', [f"A b. {LINE}"]),
    (f'<a href="/1"><div>{LINE}</div><div>{LINE}</div></a><div>{LINE}</div>', [LINE]),
    ("<p>Hello world</p>", ["Hello world"]),
])
def test_no_page_is_lost(page, want):
    assert html_extraction.extract(page).split("\n") == want


LAYOUTS = (
    "elementor-widget-container content-sidebar-wrap blog-widget-area sidebar-right page-with-sidebar sidebar-first nav-closed menu-open modal-open ad-free promo-free newsletter-article subscribe-layout"
    " related-stories-on comments-open comments-page nav-left popup-guide cookie-recipe recommended-reading-page login-page elementor-widget-theme-post-content"
).split()


@pytest.mark.parametrize("name", [*LAYOUTS, "widget Blog"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_no_name_of_a_wrapper_is_a_verdict(name, attribute):
    """The article stays in a wrapper of any name; true sidebars and comments go, beside it and in it."""
    article = f"<p>{LINE * 4}</p><p>{LINE * 3}</p>"
    want = [" ".join((LINE * 4).split()), " ".join((LINE * 3).split())]
    side, talk = f'<div class="sidebar"><p>{LINE}</p></div>', f'<div class="comments"><div class="comment"><p>{LINE} {LINE}</p></div></div>'
    for body in (article, f"<article>{article}</article>"):
        for before, after in (("", ""), (side, talk), ("", talk * 2), (side * 2, "")):
            for page in (f'{before}<div {attribute}="{name}">{body}</div>{after}', f'<div {attribute}="{name}">{before}{body}{after}</div>'):
                assert html_extraction.extract(page).split("\n") == want, page


def test_long_comments_are_comments():
    article, talk = f"<p>{LINE * 3}</p>", f'<div class="comments">{f"<div class=comment><p>{LINE * 2}</p></div>" * 4}</div>'
    want = [" ".join((LINE * 3).split())]
    assert html_extraction.extract(f"<div class=post>{article}</div>{talk}").split("\n") == want
    assert html_extraction.extract(f"<main>{article}</main>{talk * 3}").split("\n") == want
    # containers of one name are judged together
    parts = "".join(f'<div class="widget"><div class="widget-container"><p>{LINE} {k}</p></div></div>' for k in range(5))
    assert len(html_extraction.extract(parts).split("\n")) == 5


@pytest.mark.parametrize("tag", ["svg", "canvas", "button", "object"])
def test_nested_mute_elements_take_linear_time(tag):
    begun = time.process_time()
    html_extraction.extract(f"<p>{LINE}</p>" + f"<{tag}>" * (1_000_000 // len(tag)) + f"</{tag}>")
    assert time.process_time() - begun < 8  # about 1; the quadratic search took a quarter of an hour


@pytest.mark.parametrize("piece", ["<a ", "<script ", '<p title="', "<p title='x>", "<!--", "<![CDATA[", "<div>", "</p>", "<svg>", "<a href=x>y", "<div class=form>x", "&amp", "<b <"])
def test_time_of_broken_pages(piece):
    begun = time.process_time()
    html_extraction.extract(piece * (200_000 // len(piece)))
    assert time.process_time() - begun < 2  # linear: about 0.2; the quadratic ones took minutes


def test_clashing_columns_of_pages(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LINE}</p>", "x", 5)], "page_id long, url string, html string, text string, n_chars long")
    assert [tuple(r) for r in html_extraction.extract_text(df).collect()] == [(1, "u", LINE, len(LINE))]


@pytest.mark.parametrize("column", ["text", "doc_id", "source"])
def test_columns_of_nulls(spark, column):
    df = hard(spark).withColumn(column, F.lit(None).cast(dict(hard(spark).dtypes)[column]))
    for f in OPERATORS.values():
        assert f(df).count() == len(HARD)
    assert packing.pack(df).count() >= len(HARD)
