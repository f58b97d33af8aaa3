"""Pieces, importance resampling and conversation repair against the library, SQL and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from quillstream.llm import conversation_repair as R
from quillstream.llm import importance as I
from quillstream.llm import pieces as P
from tests.llm.helpers import documents, empty, hard

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def segments():
    return P.Segments(MODEL)


def odd_texts(vocabulary, n, seed=0):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "a", "the", "▁", "\x01", "é", "🙂", "00", "<s>", "<0x0A>", " ", "�"]
    out = ["", " ", "  ", "▁", " ▁", "\n", " \n", "   a", "a" * 3000, " " * 100, "\x01", "\0a", "aaaa  aaaa " * 500]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:
            out.append("".join(rng.choice("abet nos  ") for _ in range(rng.randint(1, 60))))
        elif kind < 0.7:
            out.append("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))))
        else:
            out.append("".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))).replace("▁", " "))
    return out


def test_pieces_are_the_library_s(segments, library):
    texts = odd_texts(list(segments.model.ids), 6000) + [t[1] or "" for t in documents()]
    ids, decoded = segments(pa.array(texts))
    expected = library.encode(texts)
    for text, got, back, want in zip(texts, ids.to_pylist(), decoded.to_pylist(), expected):
        assert got == want, text
        assert back == library.decode(want) == segments.model.decode(want), text


def test_ids_of_any_kind_decode_as_the_library_does(segments, library):
    rng, lone = random.Random(1), segments.model.ids["▁"]
    for _ in range(5000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 300), rng.randint(3, 258), lone]) for _ in range(rng.randint(0, 6))]
        assert segments.model.decode(ids) == library.decode(ids), ids


def test_pairs_are_compatible_if_they_are_what_both_texts_encode_to(segments):
    model, rng = segments.model, random.Random(2)
    usual = list(model.ids.values())
    short = [i for i in usual if set(model.texts[i]) <= set("▁aent")]
    for _ in range(3000):
        a, b = rng.choice(short), rng.choice(short)
        assert model.compatible(a, b) == (merged(model, model.texts[a] + model.texts[b]) == [a, b])


def merged(model, text):
    """Merging the best pair until none is left."""
    parts = list(text)
    while pairs := [(model.rank[i], k) for k in range(len(parts) - 1) if (i := model.ids.get(parts[k] + parts[k + 1])) is not None]:
        k = min(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [model.ids[p] for p in parts]


def test_memory_of_segments_is_bounded(library):
    few = P.Segments(MODEL, cached=10)
    for k in range(3):
        texts = [f"word{k}{i} again" for i in range(50)]
        assert few(pa.array(texts))[0].to_pylist() == library.encode(texts)
    assert len(few.known) <= 10 + 51


def test_other_models_are_refused():
    class Other:
        def encode(self, text, out_type):
            return ["▁x"]

    model = P.Segments(MODEL).model
    with pytest.raises(ValueError):
        model.check(Other())


def test_hard_rows_are_encoded(spark, library):
    rows = P.encode_pieces(hard(spark, extra=True), MODEL).collect()
    texts = {r["doc_id"]: r["text"] for r in hard(spark).collect()}
    assert len(rows) == hard(spark).count()
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]] or "") and r["decoded"] == library.decode(r["ids"])
    assert P.encode_pieces(empty(spark), MODEL).count() == 0
    nulls = hard(spark).selectExpr("CAST(NULL AS long) AS doc_id", "CAST(NULL AS string) AS text")
    assert {(r["doc_id"], len(r["ids"]), r["decoded"]) for r in P.encode_pieces(nulls, MODEL).collect()} == {(None, 0, "")}
    back = P.decode_pieces(P.encode_pieces(hard(spark), MODEL), MODEL, out="again").where("again <> decoded").count()
    assert back == 0


def test_query_of_pieces(spark, library):
    from tests.llm.helpers import SF

    got = {r["doc_id"]: r for r in P.op11_sentencepiece(spark, SF).collect()}
    for doc_id, text, *_ in documents():
        ids = library.encode(text or "")
        r = got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# Importance resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall((text or "").encode().lower())
    return [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)], len(words)


def drawn_by_hand(docs, target, longest, buckets, percent, least):
    count = [Counter(), Counter()]
    for c, texts in zip(count, ([t for _, t in docs], target)):
        for t in texts:
            c.update(zlib.crc32(f) % buckets for f in features(t, longest)[0])
    sums = [sum(c.values()) for c in count]
    gain = lambda b: math.floor(1000 * math.log((count[1][b] + 1) * (sums[0] + buckets) / ((count[0][b] + 1) * (sums[1] + buckets))))
    out, able = [], []
    for at, (doc_id, text) in enumerate(docs):
        found, words = features(text, longest)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
        if words >= least:
            able.append(((-score, doc_id is None, doc_id or 0, len(found), weight), at))
    for rank, (_, at) in enumerate(sorted(able)[: len(able) * percent // 100], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_draw_is_the_one_by_hand(spark, monkeypatch, longest):
    monkeypatch.setattr(I, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(I, "TRIE_NODES", 500)  # tries are summed up and started anew
    monkeypatch.setattr(I, "ORDER_ROWS", 20)
    docs = [(d[0], d[1]) for d in documents()] + [(d[0], d[1]) for d in documents()[:20]] + [(None, "the of and " * 9), (None, None), (1, ""), (2, "É é É word-word_word 1a2b " * 30)]
    target = [t for _, t in docs[:30]]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(t,) for t in target], "text string")
    got = I.resample(d, t, longest=longest, buckets=997, percent=30)
    assert sorted(map(tuple, got.collect()), key=str) == drawn_by_hand(docs, target, longest, 997, 30, 20)


def test_resampling_of_hard_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in hard(spark).collect()]
    for target in (hard(spark), empty(spark)):
        texts = [r["text"] for r in target.collect()]
        got = I.resample(hard(spark, extra=True), target, percent=50, least_words=3)
        assert sorted(map(tuple, got.collect()), key=str) == drawn_by_hand(docs, texts, 1, 10_000, 50, 3)
    assert I.resample(empty(spark), hard(spark)).count() == 0
    assert I.resample(empty(spark), empty(spark)).count() == 0


def test_words_are_cut_in_bytes():
    texts = ["Ab1-cd_É x\0y", "", "ÀB c", "...", "z"]
    words, counts = I.split_words([t.encode() for t in texts])
    assert words.to_pylist() == [w for t in texts for w in WORD.findall(t.encode().lower())]
    assert counts.tolist() == [len(WORD.findall(t.encode().lower())) for t in texts]


def test_states_of_nodes_are_the_crc_of_their_runs():
    trie = I.WordTrie(3)
    text = b"the cat sat on the cat mat the cat sat"
    trie.add([text, b"cat sat on", b""])
    found = Counter()
    for t in (text, b"cat sat on"):
        found.update(zlib.crc32(f) for f in features(t.decode(), 3)[0])
    states = {int(c): int(n) for crc, count in zip(trie.crc, trie.count) for c, n in zip(crc, count)}
    assert states == dict(found)


# Conversation repair

ROLES, TEXTS = ["user", "assistant", "system", "tool", None, "", "useful"], ["Hi.", "Why?", "cut of", " ", "", None, "Hi.\n", "So!\t", "é", "a.b", "no "]
CHAT = "conv_id long, turn long, role string, text string"


def chats(seed, n, rows):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randint(1, rows)):
            turn = None if rng.random() < 0.05 else t + 3 * (rng.random() < 0.1)
            good = rng.random() < 0.5
            out.append((None if c == 3 else c, turn, ["user", "assistant"][t % 2] if good else rng.choice(ROLES), f"{t}." if good else rng.choice(TEXTS)))
    rng.shuffle(out)
    return out


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    con.execute(f"CREATE TABLE found AS {R.OP13_SQL}")
    names = ", ".join(["conv_id", *(c.split()[0] for c in R.RESULT.split(", "))])
    return sorted(con.execute(f"SELECT {names} FROM found").fetchall(), key=str)


@pytest.mark.parametrize("long_rows", [50_000, 7])
def test_repair_is_sql_s(spark, long_rows):
    rows = chats(1, 40, 40)
    got = R.repair_conversations(spark.createDataFrame(rows, CHAT), long_rows=long_rows)
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(rows)


def test_a_conversation_of_many_rows_is_cut_into_spans(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), f"{t % 900}" + rng.choice([".", ""])) for t in range(3000)] + chats(2, 5, 9)
    df = spark.createDataFrame(rows, CHAT).where("conv_id <> 1 OR turn >= 0")
    whole = sorted(map(tuple, R.repair_conversations(df).collect()), key=str)
    assert sorted(map(tuple, R.repair_conversations(df, long_rows=250).collect()), key=str) == whole


def test_hard_conversations(spark):
    for rows in ([], [(1, 1, None, None)], [(None, None, None, None)] * 3, [(7, 0, "user", "x" * 100_000 + ".")] * 4, [(c, 0, "user", "Hi.") for c in range(60)]):
        df = spark.createDataFrame(rows, CHAT).selectExpr("*", "conv_id AS kind", "turn AS copy", "role AS audit", "text AS cost")
        for long_rows in (50_000, 2):
            assert sorted(map(tuple, R.repair_conversations(df, long_rows=long_rows).collect()), key=str) == by_sql(rows)


def least_edits(initials, faults):
    """All audits within a bound of their length, tried out."""
    best = None
    shape = re.compile(r"(s?(ua)+)?")

    def go(i, made, letters, cost, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(initials) and shape.fullmatch(made):
            best = min(best or (cost, letters), (cost, letters))
        if inserts < len(initials) + 2:
            for x in "ua":
                go(i, made + x, letters + "I", cost + 3, inserts + 1)
        if i < len(initials):
            go(i + 1, made, letters + "D", cost + 4, inserts)
            if faults[i] in (R.OK, R.TRUNCATED):
                more = 3 if faults[i] == R.TRUNCATED else 0
                go(i + 1, made + initials[i], letters + "K", cost + more, inserts)
                for x in "ua":
                    go(i + 1, made + x, letters + "R", cost + 3 + more, inserts)

    best = (4 * len(initials), "D" * len(initials))
    go(0, "", "", 0, 0)
    return best


def test_audits_are_the_least_of_the_cheapest():
    rng = random.Random(3)
    cases = [("", [])] + [("".join(rng.choice("suax") for _ in range(n)), [rng.randrange(4) for _ in range(n)]) for n in (1, 2, 3, 4) for _ in range(60)]
    cases += [("".join(x), [0] * 3) for x in product("sua", repeat=3)]
    for initials, faults in cases:
        far = R.distances(list(initials), faults, R.END)
        letters = R.walk(list(initials), faults, far, R.NOTHING, True)[0]
        assert (far[R.NOTHING], letters) == least_edits(list(initials), faults), (initials, faults)


def test_distances_take_in_tables_of_spans():
    rng = random.Random(4)
    for _ in range(50):
        n = rng.randint(2, 30)
        initials, faults = [rng.choice("suax") for _ in range(n)], [rng.randrange(4) for _ in range(n)]
        cut = rng.randint(1, n - 1)
        behind = R.distances(initials[cut:], faults[cut:], R.END)[:4]
        assert R.distances(initials[:cut], faults[:cut], behind)[:4] == R.distances(initials, faults, R.END)[:4]
        assert np.all(np.array(behind) < R.FAR)
