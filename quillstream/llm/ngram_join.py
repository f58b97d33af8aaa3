"""N-gram Jaccard join of all documents, with links reported as components.

A document is the set of its word shingles; equal sets are one set from the start.

Candidates.  The hash space is cut into segments, and a set's segments are hashed.  Sets that
link differ in D shingles at most, so a set with more than D filled segments has one that is
equal in the other: equal segments give edges (each set to the least one with that segment, not
pairs; a block of texts sends the least one of a segment only), and their components hold all
links.  Small sets, which may not fill enough segments,
are hashed without each choice of the few shingles that a linked set may lack.  As a segment has several shingles, documents that
only share a passage, or frequent phrases, have no edge.

Within a component sets are joined exactly.  Index skipping: lists hold a set under the shingles
of its prefix, ordered by the position there; if two sets have their first common shingle at
positions i and j they differ in i + j at least, so a list is read only up to a position and the
block after it is skipped.  A set whose lists hold no open set is done.  Answer skipping: a
set's overlaps with all others are counted from full lists once; those of a similar set follow
from them by adding the lists of shingles it has more and subtracting those it has less.  Sets
are taken as they are reached, and only sets not reached yet are looked at, so what is found is
exactly the components of the links.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.components import connected_components
from quillstream.llm.core import Interner, arrays, blocks, free_shuffles, hot_join, mix64, ranges, small_batches, staged, table, trim, unused, utf8
from quillstream.shipping import ship

WORDS, PERCENT = 3, 90
BLOCK_BYTES, CACHED_WORDS = 2_000_000, 150_000
#: Segment hashes sorted by one task, about; shingles joined by one task, about, and of a
#: component that is joined as one piece, at most.
TASK_SEGMENTS, TASK_SHINGLES, PIECE_SHINGLES = 1_000_000, 200_000, 800_000
#: Hashes that a small set is given, at most.
VARIANTS = 128
#: Sets with so many copies, at most so many of them, are told to all tasks, which then leave
#: the copies out; other copies only repeat edges.
COPIES, HOT_SETS = 16, 65_536
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class Shingler:
    """Distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int):
        self.words, self.known, self.hash = words, Interner(), np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > CACHED_WORDS:
            self.known, self.hash = Interner(), np.zeros(0, np.uint64)
        ids = [self.known.ids(t.lower().split()) for t in texts]  # bytes.lower() maps A-Z only
        new = self.known.words[len(self.hash) :]
        self.hash = np.concatenate([self.hash, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        return [self._shingles(self.hash[i]) for i in ids]

    def _shingles(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        if n < self.words:  # the whole sequence, whose length is part of its hash
            return mix64(np.array([sum(int(x) * (2 * k + 3) for k, x in enumerate(h.tolist(), 1)) + n & (1 << 64) - 1], np.uint64)) if n else h
        m = n - self.words + 1
        s = np.zeros(m, np.uint64)
        for k in range(self.words):
            s += mix64(h[k : k + m] + np.uint64(k)) * np.uint64(_MULTIPLIERS[k % 5] + 2 * (k // 5))
        return np.unique(mix64(s))


def signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def node_of(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def _sign(words: int):
    def run(batches):
        shingler = Shingler(words)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            sets = shingler.sets(utf8(batch.column("text")))
            sigs = [signature(s) for s in sets]
            yield arrays(doc_id=batch.column("doc_id"), n=pa.array([len(s) for s in sets], pa.int64()), sig=pa.array(sigs, pa.binary()), node=pa.array(map(node_of, sigs), pa.int64()))

    return run


@functools.cache
def choices(n: int, i: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), i)), np.int64).reshape(math.comb(n, i), i)


class Segments:
    """How sets are cut at a threshold.

    Sizes are classed so that sets that link are in the same or adjacent classes; scheme k is for
    pairs within class k and of class k with k + 1, so a set is cut by two schemes.  Segments have
    so many shingles on average that more than D of them hold ``least`` or more for most sets.
    """

    def __init__(self, percent: int):
        t = percent / 100
        self.percent, self.base = percent, math.log(1 / t) * 1.0001
        self.share = (1 - t) / t  # D over the size of the smaller set

        def filled(x: float, least: int) -> float:
            return (1 - sum(math.exp(-x) * x**i / math.factorial(i) for i in range(least))) / x

        self.least, self.mean = 1, 0.5
        for least in range(8, 1, -1):
            good = [x / 20 for x in range(2, 400) if filled(x / 20, least) >= 1.08 * self.share]
            if good and good[0] <= good[-1] * t * t:
                self.least, self.mean = least, good[-1]
                break

        #: Sets of at most ``small`` shingles are joined by variants, which those of at most
        #: ``partner`` have, the largest that can link with them.
        self.small = self.partner = 0
        while self.variants_of(100 * (self.small + 1) // percent) <= VARIANTS:
            self.small += 1
            self.partner = 100 * self.small // percent

    def removed(self, n: int) -> int:
        """The most shingles that a set of n has beyond its intersection with a linked one."""
        return n - -(-self.percent * n // 100)

    def variants_of(self, n: int) -> int:
        return sum(math.comb(n, i) for i in range(self.removed(n) + 1))

    def variants(self, mixed: np.ndarray) -> np.ndarray:
        """Hashes of a set without each choice of shingles that a linked one may lack: two sets
        that link have one in common, that of their intersection."""
        n, total = len(mixed), mixed.sum(dtype=np.uint64)
        out = []
        for i in range(self.removed(n) + 1):
            out.append(mix64(total - mixed[choices(n, i)].sum(1, dtype=np.uint64) + np.uint64((n - i) * 0x9E3779B1)))
        return np.concatenate(out)

    @functools.lru_cache(4096)  # noqa: B019  one object for each task
    def count(self, k: int) -> int:
        """Segments of scheme k, from the largest set that it cuts."""
        return max(1, math.ceil(math.exp((k + 2) * self.base) / self.mean))

    def differences(self, n: int) -> int:
        """The most shingles in which a set of n can differ from a linked one of n or more."""
        return n * (100 - self.percent) // self.percent

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Hashes of the variants of a small set, and of the segments of a sorted set that is not,
        under both of its schemes.

        Segments of fewer than ``least`` shingles are left out where the others are more than D.
        Else all filled ones are given; and if even those are D or fewer, one key more, which all
        such sets of a scheme share.  Of two sets that link either has more than D, or both have
        the shared key, so one equal key is always given by both.
        """
        n, out = len(s), []
        d, own = self.differences(n), int(math.log(n) / self.base)
        mixed = mix64(s + np.uint64(0x9E3779B97F4A7C15))
        if n <= self.partner:
            out.append(self.variants(mixed))
        for k in () if n <= self.small else (own - 1, own):
            m = self.count(k)
            segment = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            size = np.diff(np.append(first, n))
            h = mix64(np.add.reduceat(mixed, first) ^ mix64(segment[first].astype(np.uint64) + np.uint64((k + 2) * 0x100000001)))
            large = size >= self.least
            if large.sum() > d:
                h = h[large]
            elif len(h) <= d:
                h = np.append(h, mix64(np.array([(k + 2) * 0x9E3779B1 + 7], np.uint64)))
            out.append(h)
        return np.concatenate(out)


def _segments(words: int, percent: int, buckets: int, hot):
    def run(batches):
        shingler, cut, leads = Shingler(words), Segments(percent), hot.value
        for batch in blocks(batches, "text", BLOCK_BYTES):
            keys, nodes = [], []
            for i, s in zip(batch.column("doc_id").to_pylist(), shingler.sets(utf8(batch.column("text")))):
                if len(s) and leads.get(sig := signature(s), i) == i:
                    h = cut.keys(s)
                    keys.append(h)
                    nodes.append(np.full(len(h), node_of(sig)))
            if not keys:
                continue
            key, node, edges = _lists(np.concatenate(keys), np.concatenate(nodes))
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edge))
            part = lambda x: pa.array([x[edge[b] : edge[b + 1]].tobytes() for b in some], pa.binary())
            # the block's own edges go along, a part with each bucket
            own = pa.array([x.astype("<i8").tobytes() for x in np.array_split(edges, len(some))], pa.binary())
            yield arrays(bucket=some.astype(np.int32), keys=part(key), nodes=part(node), edges=own)

    return run


def _lists(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys in order, the least node of each, edges of other nodes to it)"""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    lead = node[np.flatnonzero(first)][np.cumsum(first) - 1]
    return key[first], node[first], np.unique(np.stack([node, lead], 1)[node != lead], axis=0)


def _edges(data: pa.Table) -> pa.Table:
    """Each set to the least one with the same segment."""
    joined = lambda c: b"".join(data.column(c).to_pylist())
    _, _, e = _lists(np.frombuffer(joined("keys"), "<u8"), np.frombuffer(joined("nodes"), "<i8"))
    e = np.concatenate([e, np.frombuffer(joined("edges"), "<i8").reshape(-1, 2)])
    return pa.table({"u": e[:, 0], "v": e[:, 1]})


#: Bits of the filter of wanted ids: for each id, at least, and in all, from and to.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST, FILTER_CHUNK = 16, 1 << 20, 1 << 29, 1 << 17


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _chunks(bits: int):
    def run(batches):
        for batch in batches:
            at = np.unique(_bit(batch.column("lead").to_numpy(), bits))
            yield arrays(chunk=at // FILTER_CHUNK, place=at % FILTER_CHUNK)

    return run


def _chunk(data: pa.Table) -> pa.Table:
    on = np.zeros(FILTER_CHUNK, bool)
    on[data.column("place").to_numpy()] = True
    return pa.table({"chunk": data.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})


def id_filter(wanted: DataFrame, count: int) -> np.ndarray:
    """A bit for each hash of a wanted id: at most 64 MB, whatever the input.  Beyond that more
    unwanted rows pass, and the join behind it drops them."""
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_SHARE * count).bit_length()))
    out = np.zeros((bits // FILTER_CHUNK, FILTER_CHUNK // 8), np.uint8)
    for r in wanted.mapInArrow(_chunks(bits), "chunk long, place long").groupBy("chunk").applyInArrow(_chunk, "chunk long, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _pack_texts(spread):
    def run(batches):
        import zstandard

        pack, bits = zstandard.ZstdCompressor(level=1), spread.value
        for batch in batches:
            at = _bit(batch.column("doc_id").to_numpy(), 8 * len(bits))
            batch = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            for part in blocks([batch], "text", BLOCK_BYTES):
                yield arrays(doc_id=part.column("doc_id"), packed=pa.array([pack.compress(x) for x in utf8(part.column("text"))], pa.binary()))

    return run


def _unpack_sets(words: int):
    def run(batches):
        import zstandard

        shingler, unpack = Shingler(words), zstandard.ZstdDecompressor()
        for batch in blocks(batches, "packed", BLOCK_BYTES // 4):
            sets = shingler.sets([unpack.decompress(x) for x in batch.column("packed").to_pylist()])
            same = [signature(s) == x for s, x in zip(sets, batch.column("sig").to_pylist())]
            keep = pa.array(same, pa.bool_())
            nodes = pa.array(map(node_of, batch.column("sig").filter(keep).to_pylist()), pa.int64())
            yield arrays(pieces=batch.column("pieces").filter(keep), component=batch.column("component").filter(keep), lead=batch.column("lead").filter(keep), node=nodes, shingles=pa.array([s.tobytes() for s, k in zip(sets, same) if k], pa.binary()))

    return run


def link_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the first set of the component of links that it is in."""
    m = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")  # sets by size
    n = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    values, token = np.unique(flat, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(n)])
    by_token = np.argsort(token, kind="stable")
    member = np.repeat(np.arange(m), n)[by_token]
    frequency = np.bincount(token, minlength=len(values))
    list_at = np.concatenate([[0], np.cumsum(frequency)])
    own = [token[first[i] : first[i + 1]] for i in range(m)]

    # prefixes, rare shingles first; lists of them by position
    prefix = []
    for i in range(m):
        rare = own[i][np.argsort(frequency[own[i]], kind="stable")]
        prefix.append(rare[: n[i] - -(-percent * n[i] // 100) + 1])
    p_size = np.array([len(p) for p in prefix])
    p_token, p_pos, p_member = np.concatenate(prefix), ranges(p_size), np.repeat(np.arange(m), p_size)
    by = np.lexsort((p_pos, p_token))
    p_pos, p_member = p_pos[by], p_member[by]
    p_at = np.searchsorted(p_token[by], np.arange(len(values) + 1))

    def overlaps(tokens: np.ndarray) -> np.ndarray:
        size = list_at[tokens + 1] - list_at[tokens]
        return np.bincount(member[np.repeat(list_at[tokens], size) + ranges(size)], minlength=m)

    def candidates(y: int, low: int, high: int) -> bool:
        """Whether y's lists, up to the positions that matter, hold an open set of fitting size."""
        most = (100 - percent) * (n[y] + 100 * n[y] // percent) // (100 + percent)
        for i, t in enumerate(prefix[y].tolist()):
            a, b = p_at[t], p_at[t + 1]
            if b - a > 1:
                found = p_member[a : a + np.searchsorted(p_pos[a:b], most - i, "right")]
                if (open_[found] & (found >= low) & (found < high)).any():
                    return True
        return False

    root, open_ = np.arange(m), np.ones(m, bool)
    for r in range(m):
        if not open_[r]:
            continue
        open_[r] = False
        count_r, queue = None, [r]
        while queue:
            y = queue.pop()
            low, high = np.searchsorted(n, -(-percent * n[y] // 100)), np.searchsorted(n, 100 * n[y] // percent, "right")
            if not open_[low:high].any() or not candidates(y, low, high):
                continue
            if count_r is None:
                count_r = overlaps(own[r])
            more, less = np.setdiff1d(own[y], own[r], True), np.setdiff1d(own[r], own[y], True)
            if y == r:
                count = count_r
            elif len(more) + len(less) < len(own[y]):
                count = count_r + overlaps(more) - overlaps(less)
            else:
                count = overlaps(own[y])
            c = count[low:high]
            found = low + np.flatnonzero(open_[low:high] & (100 * c >= percent * (n[y] + n[low:high] - c)))
            open_[found] = False
            root[found] = r
            queue += found.tolist()
    out = np.empty(m, np.int64)
    out[order] = order[root]
    return out


def _join(percent: int):
    def run(data: pa.Table) -> pa.Table:
        component, lead = data.column("component").to_numpy(), data.column("lead").to_numpy()
        shingles = data.column("shingles").to_pylist()
        order = np.lexsort((lead, component))
        u, v = [], []
        for part in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            root = link_components([np.frombuffer(shingles[i], "<u8") for i in part], percent)
            leads = lead[part]
            least = np.full(len(part), np.iinfo(np.int64).max)
            np.minimum.at(least, root, leads)
            u.append(leads)
            v.append(least[root])
        del shingles
        trim()
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    return run


def _fetch(rows: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(pieces, component, lead, node, shingles) of ``members``: the texts of other rows stay where
    they are, but for those that a bounded filter lets pass."""
    spread = rows.sparkSession.sparkContext.broadcast(id_filter(members.select("lead"), members.count()))
    texts = rows.mapInArrow(_pack_texts(spread), "doc_id long, packed binary")
    fetched = texts.join(members.select("sig", "lead", "component", "pieces").hint("merge"), texts["doc_id"] == F.col("lead"))
    return fetched.select("pieces", "component", "lead", "sig", "packed").mapInArrow(_unpack_sets(words), "pieces int, component long, lead long, node long, shingles binary")


def _joined(sets: DataFrame, percent: int) -> DataFrame:
    return sets.select("task", "component", "lead", "shingles").groupBy("task").applyInArrow(_join(percent), "u long, v long")


def _pieces(shingles: Column) -> Column:
    return F.ceil(shingles / PIECE_SHINGLES).cast("int")


def _by_component(sets: DataFrame, total: int) -> DataFrame:
    """Tasks of whole components, with TASK_SHINGLES of ``total`` shingles each, about."""
    return sets.withColumn("task", F.pmod(F.xxhash64("component"), F.lit(1 + total // TASK_SHINGLES)).cast("string"))


def _listed(step: int):
    """(node, n, shingle) of the shingles whose hashes are multiples of ``step``."""

    def run(batches):
        for batch in blocks(batches, "shingles", BLOCK_BYTES):
            sets = [np.frombuffer(x, "<u8") for x in batch.column("shingles").to_pylist()]
            some = [s[s % np.uint64(step) == 0] for s in sets]
            size = [len(s) for s in some]
            node, n = (np.repeat(x, size) for x in (batch.column("node").to_numpy(), np.array([len(s) for s in sets], np.int32)))
            yield arrays(node=node, n=n, shingle=np.concatenate([*some, np.zeros(0, np.uint64)]).view(np.int64))

    return lambda sets: sets.select("node", "shingles").mapInArrow(run, "node long, n int, shingle long")


def refined(sets: DataFrame, percent: int) -> DataFrame:
    """(pieces, component, lead, node, shingles) of the sets that may link, in components of a
    stricter candidate edge: what links segments of a few shingles grows together as a corpus grows.

    A set with more shingles of its own than a linked one may lack links with nothing; half of the
    hash space shows most of these.  Of the others, two that link share one of the rarest shingles,
    as many as may be lacking and one, since all sets order shingles alike: by their number of sets
    here, then by hash.  Shingles of one set alone are among these, but need no list.
    """
    lacking = F.expr(f"n * {100 - percent} div 100")
    alone = _listed(2)(sets).groupBy("shingle").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.count("*").alias("in")).where("in = 1")
    alone = alone.groupBy("node", "n").agg(F.count("*").alias("own")).where(F.col("own") > lacking).select("node")
    few = staged(sets.join(alone, "node", "left_anti"), "few")
    listed = _listed(1)(few).withColumn("in", F.count("*").over(W.partitionBy("shingle"))).where("in > 1")
    shared = listed.groupBy("node", "n").agg(F.sort_array(F.collect_set(F.struct("in", "shingle"))).alias("shared"))
    rarest = F.greatest(lacking + 1 - F.col("n") + F.size("shared"), F.lit(0)).cast("int")
    keys = shared.select("node", F.explode(F.slice("shared", F.lit(1), rarest)).alias("x")).select("node", "x.shingle")
    edges = keys.select(F.col("node").alias("u"), F.min("node").over(W.partitionBy("shingle")).alias("v"))
    found = connected_components(edges)
    roots = staged(found.select(F.col("u").alias("node"), "root").union(found.select("root", "root").distinct()), "roots")
    fine = few.drop("component", "pieces").join(roots, "node").withColumnRenamed("root", "component")
    n = F.octet_length("shingles") / 8
    size = roots.join(few.select("node", n.alias("n")), "node").groupBy(F.col("root").alias("component")).agg(_pieces(F.sum("n")).alias("pieces"))
    return staged(fine.join(size, "component").select("pieces", "component", "lead", "node", "shingles"), "fine")


def _crossed(sets: DataFrame, some: DataFrame, percent: int) -> DataFrame:
    """Links of components between ``some`` of their sets and all: each chunk of these meets each
    piece of all."""
    chunks = some.groupBy("component").agg(_pieces(F.sum(F.octet_length("shingles") / 8)).alias("chunks"))
    task = lambda part, chunk: F.concat_ws(":", "component", part, chunk)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = sets.join(chunks, "component").withColumn("_i", upto("chunks")).withColumn("task", task("piece", "_i"))
    part = some.join(chunks, "component").withColumn("_i", F.pmod(F.xxhash64(F.lit(1), "lead"), F.col("chunks")))
    part = part.withColumn("_p", upto("pieces")).withColumn("task", task("_p", "_i"))
    columns = ["task", "component", "lead", "shingles"]
    return _joined(whole.select(*columns).union(part.select(*columns)), percent)


def link_large(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between linked sets of components that are too large for one task, such that
    their components are those of all links.

    Pieces of a component are joined on their own, then the first sets of the groups found in all
    pieces with each other.  Groups that this makes one need no comparing within; what is not in
    the largest group of its component is compared with all.  A component of near copies thus
    takes one pass over its sets, however large; only sets that are not in its largest group then
    cost a pass over the component for each PIECE_SHINGLES shingles of them.
    """
    sets = staged(sets.withColumn("piece", F.pmod(F.xxhash64("lead"), F.col("pieces")).cast("int")), "large")
    alone = staged(_joined(sets.withColumn("task", F.concat_ws(":", "component", "piece")), percent), "links")
    first = sets.join(alone.select(F.col("v").alias("lead")).distinct(), "lead", "left_semi").drop("pieces", "piece")
    size = first.groupBy("component").agg(_pieces(F.sum(F.octet_length("shingles") / 8)).alias("pieces"))
    first = first.join(size, "component").withColumn("piece", F.pmod(F.xxhash64("lead"), F.col("pieces")).cast("int"))
    across = staged(_crossed(first, first, percent), "links")
    links = alone.union(across)
    roots = connected_components(links).withColumnRenamed("u", "lead")
    grouped = staged(sets.select("component", "lead").join(roots, "lead", "left").select("component", "lead", F.coalesce("root", "lead").alias("root")), "groups")
    sizes = grouped.groupBy("component", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("component").agg(F.max(F.struct("n", "root")).alias("m")).select("component", F.col("m.root").alias("main"))
    other = grouped.join(main, "component").where("root <> main").select("lead")
    return links.union(_crossed(sets, sets.join(other, "lead", "left_semi"), percent))


def jaccard_components(df: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row.

    Rows link when 100 * intersection >= percent * union of their shingle sets; a component's id
    is its smallest doc_id.  Null, empty and blank texts have no shingles and are linked with
    nothing; a text of fewer than ``words`` words has one; repeated rows link with each other; a
    null id counts as -1; an empty table stays empty; other columns are ignored.

    No list, component or copy is expanded into pairs.  A component of candidates beyond
    PIECE_SHINGLES is joined in pieces (link_large), so memory is bounded and no link is lost.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("doc_id"), F.col(text).alias("text"))
    signed = staged(rows.mapInArrow(_sign(words), "doc_id long, n long, sig binary, node long"), "signed")
    sets = staged(signed.groupBy("sig").agg(F.min("doc_id").alias("lead"), F.first("n").alias("n"), F.first("node").alias("node"), F.count("*").alias("copies")), "sets")
    hot = sets.where(F.col("copies") >= COPIES).orderBy(F.desc("copies"), "sig").limit(HOT_SETS).select("sig", "lead").collect()
    hot = spark.sparkContext.broadcast({bytes(r["sig"]): r["lead"] for r in hot})
    total, n_rows = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    buckets = 1 + int(total * 2.2 * Segments(percent).share) // TASK_SEGMENTS
    edges = rows.mapInArrow(_segments(words, percent, buckets, hot), "bucket int, keys binary, nodes binary, edges binary").groupBy("bucket").applyInArrow(_edges, "u long, v long")
    found = connected_components(edges)
    free_shuffles(spark)
    roots = found.select(F.col("u").alias("node"), F.col("root").alias("component")).union(found.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct())
    members = sets.where("n > 0").select("sig", "lead", "n", "node").join(roots, "node").drop("node")
    size = members.groupBy("component").agg(F.sum("n").alias("size"), F.count("*").alias("sets")).withColumn("pieces", _pieces(F.col("size")))
    members = staged(hot_join(members, size, "component", "sets", n_rows), "members")
    total, most = members.where("pieces = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], members.agg(F.coalesce(F.max("pieces"), F.lit(0))).first()[0]
    free_shuffles(spark)
    links = _joined(_by_component(_fetch(rows, members.where("pieces = 1"), words), total), percent)
    links = staged(links.where("u <> v").groupBy("u").agg(F.min("v").alias("root")), "links")
    free_shuffles(spark)
    if most > 1:
        fine = refined(staged(_fetch(rows, members.where("pieces > 1"), words), "wide"), percent)
        free_shuffles(spark)
        small = fine.where("pieces = 1")
        total = small.agg(F.coalesce(F.sum(F.octet_length("shingles") / 8), F.lit(0)).cast("long")).first()[0]
        small = _joined(_by_component(small, total), percent).where("u <> v").groupBy("u").agg(F.min("v").alias("root"))
        links = links.unionByName(staged(small, "links"))
        if not (large := fine.where("pieces > 1")).isEmpty():
            links = links.unionByName(connected_components(link_large(large, percent)))
        free_shuffles(spark)
    ids = sets.join(links, sets["lead"] == links["u"], "left").select("sig", F.coalesce("root", "lead").alias("component"), "copies")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return hot_join(signed, staged(ids, "ids"), "sig", "copies", n_rows).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op6_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


#: All pairs by a join on shingles, and what they reach: for tables that a test can hold.
OP6_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w),
sets AS (SELECT list_sort(s) AS s, min(doc_id) AS lead, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS (SELECT lead, n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.lead AS a, b.lead AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.g = b.g AND a.lead < b.lead AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 90 * (na + nb - c) UNION ALL SELECT b, a FROM pairs WHERE 100 * c >= 90 * (na + nb - c)),
reach AS (SELECT lead AS x, lead AS y FROM sets UNION SELECT reach.x, links.b FROM reach JOIN links ON reach.y = links.a),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(root, s.doc_id) AS component_id
FROM s LEFT JOIN sets ON list_sort(s.s) = sets.s LEFT JOIN roots ON sets.lead = roots.x
"""


def stage_near_dedup(spark, docs, sf_dir):
    """Pipeline stage: of each component at five words and 0.8, the row of the smallest doc_id.

    A row without an id counts by a hash of its text, from 2^62 up, so that smaller ids come
    before it and unlike rows stay apart; of equal texts without ids one row stays.  Empty texts
    stay; rows that repeat an id come as often as they do; an empty table stays empty; other
    columns, whatever their names, are kept.
    """
    small_batches(spark)
    names = docs.columns
    row, kept_row = unused(docs, "row", "kept")
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 2) + F.lit(1 << 62)
    unnamed = docs.where("doc_id IS NULL").withColumn(row, place).dropDuplicates([row])
    docs = docs.where("doc_id IS NOT NULL").withColumn(row, F.col("doc_id").cast("long")).unionByName(unnamed)
    kept = jaccard_components(docs, 5, 80, row).where("doc_id = component_id").select(F.col("doc_id").alias(kept_row)).distinct()
    return docs.join(kept, docs[row] == kept[kept_row], "left_semi").select(*names)
