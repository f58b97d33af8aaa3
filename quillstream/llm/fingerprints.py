"""Document fingerprints from prefix polynomial hashes.

``P[i]`` is the sum of c_j * B^j over the first i code points, modulo a prime, for two primes.
The hash of any span is (P[j] - P[i]) / B^i, so spans of any length compare in O(1), and the
longest common extension of two places is found by binary search.  A fingerprint has the length
and whole hash of a text; the hashes of its prefixes at fixed knots, whose lengths grow by a
quarter; and of the hashes of all its spans of SPAN code points, the least in each of BINS bins.
Two fingerprints are alike as they share bins, or as far as their prefixes agree, which binary
search over the knots tells.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.core import arrays, blocks, mix64, staged, table
from quillstream.shipping import ship

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
SPAN, BINS = 8, 64
#: Text in a range of ids, about; ranges at most (their edges, 16 bytes each, are told to all tasks).
BUCKET_BYTES, BUCKETS = 2_000_000, 1_000_000
#: Rows whose sizes one task sums up, about.
TASK_ROWS = 1_000_000
#: Lengths of the prefixes that a fingerprint holds: 8 and up, a quarter more each.
KNOTS = np.unique(np.floor(8 * 1.25 ** np.arange(90)).astype(np.int64))
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_edited long, prefix_next long"


class _Powers:
    """B^i and B^-i modulo each prime, grown by doubling."""

    def __init__(self) -> None:
        one = np.ones(1, np.uint64)
        self.up, self.down = [one, one], [one, one]

    def need(self, n: int) -> None:
        for k, (p, b) in enumerate(zip(PRIMES, BASES)):
            while len(self.up[k]) < n:
                for tables, base in ((self.up, b), (self.down, pow(b, -1, p))):
                    t = tables[k]
                    tables[k] = np.concatenate([t, t * np.uint64(pow(base, len(t), p)) % np.uint64(p)])


POWERS = _Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Prefixes:
    """Prefix hashes of one text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        POWERS.need(self.n + 1)
        self.arrays = []
        for k, p in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, np.uint64)
            term = (points.astype(np.uint64) + np.uint64(1)) * POWERS.up[k][: self.n]
            term %= np.uint64(p)
            np.cumsum(term, out=sums[1:])  # below 2^31 each: no overflow below 2^33 code points
            sums %= np.uint64(p)
            self.arrays.append(sums)

    def spans(self, length: int) -> np.ndarray:
        """A 62-bit hash of the span at each place."""
        out = np.zeros(self.n - length + 1, np.uint64)
        for k, p in enumerate(PRIMES):
            a = self.arrays[k]
            h = (a[length:] + np.uint64(p) - a[: self.n - length + 1]) * POWERS.down[k][: self.n - length + 1]
            h %= np.uint64(p)
            out = (out << np.uint64(31)) | h
        return out

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash of code points i to j: equal spans, equal hashes, wherever they stand."""
        return tuple(int((int(a[j]) + p - int(a[i])) * int(POWERS.down[k][i]) % p) for k, (a, p) in enumerate(zip(self.arrays, PRIMES)))


def common_extension(x: Prefixes, i: int, y: Prefixes, j: int) -> int:
    """How many code points x from i and y from j have in common, by binary search."""
    low, high = 0, min(x.n - i, y.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x.span(i, i + mid) == y.span(j, j + mid) else (low, mid - 1)
    return low


class Print:
    """What a fingerprint holds; ``bins`` are least span hashes as 16 bits, -1 where a bin has
    none.  A text shorter than SPAN is one span; an empty one has none."""

    def __init__(self, n: int, whole: int, knots: np.ndarray, bins: np.ndarray):
        self.n, self.whole, self.knots, self.bins = n, whole, knots, bins

    def __str__(self) -> str:
        return f"{self.n:x}:{self.whole:016x}:" + "".join(f"{v:04x}" for v in self.knots.tolist()) + ":" + "".join("----" if v < 0 else f"{v:04x}" for v in self.bins.tolist())


def sketch(x: Prefixes) -> Print:
    bins = np.full(BINS, -1, np.int64)
    if not x.n:
        return Print(0, 0, np.zeros(0, np.int64), bins)
    h = mix64(x.spans(min(SPAN, x.n)))
    bin_of = (h >> np.uint64(58)).astype(np.int64)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bin_of, h)
    has = np.bincount(bin_of, minlength=BINS) > 0
    bins[has] = (mix64(least[has]) & np.uint64(0xFFFF)).astype(np.int64)
    at = KNOTS[: np.searchsorted(KNOTS, x.n, "right")]
    knots = (mix64((x.arrays[0][at] << np.uint64(31)) | x.arrays[1][at]) & np.uint64(0xFFFF)).astype(np.int64)
    a, b = x.span(0, x.n)
    return Print(x.n, (a << 31) | b, knots, bins)


def parse(text: str) -> Print:
    n, whole, knots, bins = text.split(":")
    return Print(
        int(n, 16), int(whole, 16), np.array([int(knots[i : i + 4], 16) for i in range(0, len(knots), 4)], np.int64),
        np.array([-1 if bins[i] == "-" else int(bins[i : i + 4], 16) for i in range(0, 4 * BINS, 4)]),
    )


def common_prefix(a: Print, b: Print) -> int:
    """The longest knot up to which two texts agree, by binary search: prefixes agree up to a
    place and not beyond."""
    low, high = 0, min(len(a.knots), len(b.knots))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.knots[mid - 1] == b.knots[mid - 1] else (low, mid - 1)
    return int(KNOTS[low - 1]) if low else 0


def likeness(a: Print, b: Print) -> float:
    """1 if length and whole hash agree, else the larger of the share of spans two texts have in
    common, 2J / (1 + J) by their bins, and the share of their common prefix in the longer; 0 if
    only one text is empty."""
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    used = (a.bins >= 0) | (b.bins >= 0)
    j = float(((a.bins == b.bins) & used).sum() / max(1, used.sum()))
    return max(2 * j / (1 + j), common_prefix(a, b) / max(1, a.n, b.n))


def _prints(ids: list, tails: list, keys: list, packed: list):
    """Rows of one range: each document and, as a tail, the one after its last."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    order = sorted(range(len(ids)), key=lambda i: (tails[i], ids[i], keys[i]))
    own = [i for i in order if not tails[i]]
    if not own:
        return
    read = lambda i: code_points(unpack.decompress(packed[i]).decode("utf-8", "surrogatepass"))
    # a text's prefix hashes are dropped once it has been held against the next
    after = own[1:] + [i for i in order if tails[i]][:1]
    now = read(own[0])
    x = Prefixes(now)
    mine = sketch(x)
    for i, j in zip(own, after):
        following = read(j)
        y = Prefixes(following)
        theirs = sketch(y)
        m = len(now) // 2
        edited = np.concatenate([now[: len(now) - m], following[:m]])
        z = Prefixes(edited)
        other = sketch(z)
        digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        yield ids[i], len(now), digest, str(mine), str(other), likeness(mine, other), likeness(mine, theirs), common_extension(x, 0, z, 0), common_extension(x, 0, y, 0)
        now, x, mine = following, y, theirs


def _table_prints(data: pa.Table) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RESULT.split(", ")])
    found = list(_prints(*(data.column(c).to_pylist() for c in ("doc_id", "tail", "k", "packed"))))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema) if found else schema.empty_table()


def range_of(ids: np.ndarray, keys: np.ndarray, edge_ids: np.ndarray, edge_keys: np.ndarray) -> np.ndarray:
    """The range that holds each (id, key): the last whose edge is not above it."""
    out = np.searchsorted(edge_ids, ids, "left") - 1
    for i in np.unique(ids[np.isin(ids, edge_ids)]):
        a, b = np.searchsorted(edge_ids, i, "left"), np.searchsorted(edge_ids, i, "right")
        at = np.flatnonzero(ids == i)
        out[at] = a + np.searchsorted(edge_keys[a:b], keys[at], "right") - 1
    return out


def _compress(edges):
    """Texts as zstandard frames, so that the one shuffle of whole texts is small; a text at an
    edge also ends the range before."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        edge_ids, edge_keys = edges.value
        n = len(edge_ids)
        for batch in blocks(batches, "text", 4_000_000):
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("k").to_numpy()
            bucket = range_of(ids, keys, edge_ids, edge_keys)
            packed = [pack.compress(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            edge = np.flatnonzero((edge_ids[bucket] == ids) & (edge_keys[bucket] == keys))
            at = np.concatenate([np.arange(len(ids)), edge])
            tail = np.arange(len(at)) >= len(ids)
            where = np.where(tail, (bucket[at] - 1) % n, bucket[at])
            yield arrays(bucket=where.astype(np.int32), doc_id=ids[at], tail=tail, k=keys[at], packed=pa.array([packed[i] for i in at.tolist()], pa.binary()))

    return run


def range_edges(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least (id, key) of each range, ranges having about equal text: running sums over the
    ids in order, within tasks that hold ranges of ids, on top of the sums of the tasks before."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    each = max(BUCKET_BYTES, total // BUCKETS + 1)
    placed = staged(rows.repartitionByRange(1 + n // TASK_ROWS, "doc_id", "k").withColumn("pid", F.spark_partition_id()), "sizes")
    ahead = placed.groupBy("pid").agg(F.sum("bytes").alias("t"))
    ahead = ahead.select(F.col("pid").alias("_pid"), (F.sum("t").over(W.orderBy("pid")) - F.col("t")).alias("ahead"))  # one row a task
    seen = F.sum("bytes").over(W.partitionBy("pid").orderBy("doc_id", "k"))  # rows of one id and key have one sum
    found = placed.withColumn("_seen", seen).join(F.broadcast(ahead), F.col("pid") == F.col("_pid"))
    found = found.withColumn("b", F.floor((F.col("ahead") + F.col("_seen") - 1) / each)).groupBy("b").agg(F.min(F.struct("doc_id", "k")).alias("e"))
    found = found.select("e.doc_id", "e.k").distinct().orderBy("doc_id", "k").collect()  # BUCKETS rows at most
    return np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)


def fingerprint_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and their likeness to the edited and
    the next text; ``prefix_edited`` and ``prefix_next`` are how many code points a text has in
    common with these from the start, by common_extension.  Null texts are empty; a table of one
    row is its own next; rows that share an id follow each other by a hash of the text; a null id
    counts as -1; an empty table stays empty; other columns are ignored.

    Ids are cut into ranges of about equal text, so a range and the first document after it hold
    all neighbours, and no task orders the whole table.  Equal rows of one id share a range.
    """
    spark = df.sparkSession
    ship(spark)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("k"))
    edges = range_edges(rows.select("doc_id", "k", (F.octet_length("text") + 1).alias("bytes")))
    if not len(edges[0]):
        return spark.createDataFrame([], RESULT)
    edges = spark.sparkContext.broadcast(edges)
    packed = rows.mapInArrow(_compress(edges), "bucket int, doc_id long, tail boolean, k long, packed binary")
    return packed.groupBy("bucket").applyInArrow(_table_prints, RESULT)


def op8_fingerprints(spark, sf_dir):
    return fingerprint_rows(table(spark, sf_dir, "documents"))
