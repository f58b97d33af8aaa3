"""Target-distribution importance resampling with word tries.

A partition's texts are laid into a trie of words: a node stands for a run of words, and holds how
often it came and the CRC state of its bytes, from which its children's follow without reading the
run again.  Counts of nodes give totals of hashed buckets, which are summed up over partitions.
Texts are then scored by walking the same paths, each node with its bucket's gain attached: how
much likelier the bucket is in the target than in all documents.  Gumbel noise from a hash of the
id turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.core import Interner, blocks, ranges, staged, table, trim, unused, utf8
from quillstream.shipping import ship

BLOCK_BYTES, TRIE_NODES = 2_000_000, 400_000
#: Rows ordered by one task, about, and tasks at most.
ORDER_ROWS, ORDER_TASKS = 50_000, 20_000
# words are runs of ASCII digits, letters and anything beyond ASCII
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def split_words(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """(all words, words of each text): A-Z lower-cased, cut at all other ASCII."""
    raw = LOWER[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    inside = IN_WORD[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    after = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return words, np.diff(np.searchsorted(starts, after), prepend=0)


class WordTrie:
    """Nodes level by level: level k holds the runs of k + 1 words."""

    def __init__(self, longest: int):
        self.longest = longest
        self.reset()

    def reset(self) -> None:
        self.nodes = [Interner() for _ in range(self.longest)]  # word, or parent << 32 | word -> node
        self.crc = [np.zeros(0, np.uint32) for _ in range(self.longest)]
        self.count = [np.zeros(0, np.int64) for _ in range(self.longest)]

    def __len__(self) -> int:
        return sum(map(len, self.nodes))

    def walk(self, texts: list[bytes]):
        """For each level, (node of each run, text of each run); the nodes are made on the way."""
        words, counts = split_words(texts)
        coded = words.dictionary_encode()
        word = self.nodes[0].ids(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        self._new(0, lambda w: zlib.crc32(w))
        of = np.repeat(np.arange(len(texts)), counts)
        left = np.repeat(counts, counts) - ranges(counts)  # words from here to the text's end
        node = word
        yield node, of
        spelled, first = self.nodes[0].words, word
        for k in range(1, self.longest):
            here = np.flatnonzero(left > k)
            parent = np.full(len(word), -1, np.int64)
            parent[np.flatnonzero(left > k - 1)] = node
            keys, back = np.unique(parent[here] << 32 | first[here + k], return_inverse=True)
            node = self.nodes[k].ids(keys.tolist())[back]
            above = self.crc[k - 1]
            self._new(k, lambda key, above=above: zlib.crc32(b" " + spelled[key & 0xFFFFFFFF], int(above[key >> 32])))
            yield node, of[here]

    def _new(self, k: int, state) -> None:
        new = self.nodes[k].words[len(self.crc[k]) :]
        self.crc[k] = np.concatenate([self.crc[k], np.fromiter(map(state, new), np.uint32, len(new))])
        self.count[k] = np.concatenate([self.count[k], np.zeros(len(new), np.int64)])

    def add(self, texts: list[bytes]) -> None:
        for k, (node, _) in enumerate(self.walk(texts)):
            self.count[k] += np.bincount(node, minlength=len(self.count[k]))

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for crc, count in zip(self.crc, self.count):
            np.add.at(out, crc % np.uint32(buckets), count)
        return out

    def weigh(self, texts: list[bytes], gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, features, sum of the gains of all features) of each text."""
        words, features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
        for k, (node, of) in enumerate(self.walk(texts)):
            n = np.bincount(of, minlength=len(texts))
            words = n if k == 0 else words
            features += n
            sums = np.concatenate([[0], np.cumsum(gains[self.crc[k] % np.uint32(len(gains))][node])])
            ends = np.cumsum(n)
            weight += sums[ends] - sums[ends - n]
        return words, features, weight


def bucket_totals(df: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; empty buckets are left out.

    A task sends a row for each bucket and trie, whatever its texts; a trie that has grown beyond
    TRIE_NODES nodes is summed up and started anew.
    """
    ship(df.sparkSession)

    def run(batches):
        trie = WordTrie(longest)
        sums = np.zeros(buckets, np.int64)
        for batch in blocks(batches, "_text", BLOCK_BYTES):
            trie.add(utf8(batch.column("_text")))
            if len(trie) > TRIE_NODES:
                sums += trie.totals(buckets)
                trie.reset()
        sums += trie.totals(buckets)
        at = np.flatnonzero(sums)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    found = df.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), with the counts
    s of ``documents`` and t of ``target`` in the bucket, their sums S and T, and B buckets."""
    spark = documents.sparkSession
    s = bucket_totals(documents, text, longest, buckets).withColumnRenamed("n", "s")
    t = bucket_totals(target, text, longest, buckets).withColumnRenamed("n", "t")
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    whole = both.crossJoin(F.broadcast(both.agg(F.sum("s").alias("S_all"), F.sum("t").alias("T_all"))))  # one row
    ratio = (F.col("t") + 1).cast("double") * (F.col("S_all") + buckets) / ((F.col("s") + 1).cast("double") * (F.col("T_all") + buckets))
    return whole.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weigh(df: DataFrame, gains: np.ndarray, text: str = "text", longest: int = 1) -> DataFrame:
    """``df`` without its text, and n_words, n_features and weight of each row."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != text]
    (inner,) = unused(df, "t")

    def run(batches):
        trie = WordTrie(longest)
        for batch in blocks(batches, inner, BLOCK_BYTES):
            found = trie.weigh(utf8(batch.column(inner)), gains)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, found)], names=[*keep, "n_words", "n_features", "weight"])
            if len(trie) > TRIE_NODES:
                trie.reset()
        trim()

    schema = df.select(*keep).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return df.select(*keep, F.col(text).cast("string").alias(inner)).mapInArrow(run, schema)


def noise(key: str = "doc_id", seed: int = 2024):
    """Gumbel noise of an id in thousandths: a hash of the seed and the id (null: nothing) is its draw."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(draw, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``documents``.

    Of the rows with ``least_words`` words, floor(percent * rows / 100) with the highest scores are
    drawn, ties to the smaller id (null ids last); their rank counts from 1, others have none.  Rows
    that share id and score are ranked one after the other.  Null and empty texts have no features
    and weight 0; an empty target is one without features; of an empty table nothing is drawn.
    Only ids and text are read, so other columns may have any names.  What is told to all tasks are
    the gains, one number a bucket.  Ranks come from ranges of the scores and the counts of earlier
    ranges, so that no task orders all rows.
    """
    found = bucket_gains(documents, target, text, longest, buckets).collect()  # as many rows as buckets
    gains = np.zeros(buckets, np.int64)
    gains[[r["bucket"] for r in found]] = [r["gain"] for r in found]
    rows = weigh(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), gains, "text", longest)
    rows = staged(rows.withColumn("score", F.col("weight") + noise("doc_id", seed)), "weights")
    n, able = rows.agg(F.count("*"), F.count_if(F.col("n_words") >= least_words)).first()
    order = [F.col("n_words") < least_words, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]
    tasks = min(ORDER_TASKS, 1 + n // ORDER_ROWS)
    # the number of a row holds its task's and its place in it, after sorting
    rows = staged(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumns({"_task": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    ahead = rows.groupBy("_task").agg(F.count("*").alias("_n"))  # at most ORDER_TASKS rows
    ahead = ahead.select("_task", (F.sum("_n").over(W.orderBy("_task")) - F.col("_n")).alias("_ahead"))
    rank = F.col("_ahead") + F.col("_place") + 1
    drawn = able * percent // 100
    return rows.join(F.broadcast(ahead), "_task").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def op12_importance(spark, sf_dir):
    """A tenth of the documents with 20 words or more, drawn towards the benchmark's single words."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of a list of bytes, in SQL: the usual table by its rule, then one step a byte.
CRC_TABLE_SQL = "list_transform(range(256), lambda n: list_reduce(list_concat([n::UBIGINT], range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END))"


def crc_sql(text: str, crcs: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes; ``crcs`` names the table's column."""
    digits = f"hex(encode({text}))"
    read = f"list_transform(range(1, length({digits}) // 2 + 1), lambda i: ('0x' || substr({digits}, 2 * i::BIGINT - 1, 2))::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {read}), lambda c, b: xor(c >> 8, {crcs}[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"


OP12_SQL = rf"""
WITH crcs AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS v),
lists AS MATERIALIZED (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
words AS MATERIALIZED (SELECT side, doc_id, w, count(*) AS n FROM (SELECT side, doc_id, unnest(ws) AS w FROM lists) GROUP BY ALL),
spelled AS MATERIALIZED (SELECT w, ({crc_sql("w", "v")} % 10000)::BIGINT AS bucket FROM (SELECT DISTINCT w FROM words), crcs),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM words JOIN spelled USING (w) GROUP BY bucket
),
alls AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, alls
),
weighed AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM words JOIN spelled USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT l.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || l.doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM lists l LEFT JOIN weighed w ON l.doc_id = w.doc_id WHERE side = 'd'
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END::BIGINT AS rank
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""
