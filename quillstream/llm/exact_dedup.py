"""Exact dedup against a minimal perfect hash over historical distinct digests.

History is a table of distinct digests, each with its winner.  It is cut into shards by the
digest; each shard becomes one row: the levels of a minimal perfect hash (bit arrays in which
a key's first unshared bit, counted by rank, is its slot) and the slots, which hold the full
digest and the winner's locator.  Incoming digests (one row each, after a map-side combine)
meet their shard, are hashed to a slot and compared byte for byte: equal ones repeat history and
are counted in their slot, whose winner they may replace; the others are groups of their own.

A table without a history is its own: a fixed law of the id makes half of its rows the history
and the other half the incoming ones, and what is said of a row comes from its slot or, where
both agree that history has no such text, from its group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.core import hot_join, mix64, staged, table, unused
from quillstream.shipping import ship

#: Digests in a shard of the index, about: 32 + 24 bytes each.
SHARD_DIGESTS = 100_000
SPACES = r"[\x20\x09-\x0D]"
INDEX = "shard int, n long, bits binary, sizes binary, digests binary, keep_ids binary, nones binary, lengths binary, copies binary"
FOUND = "digest binary, keep_len long, keep_id long, keep_none long, size long"
#: Rows that a stage drops are told to all tasks up to this number, and joined by a shuffle beyond.
TOLD_ROWS = 100_000


def _words(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each digest that its shard does not depend on."""
    m = np.frombuffer(b"".join(digests), "<u8").reshape(len(digests), 4)
    return m[:, 1], m[:, 2]


def build_mph(digests: list[bytes], gamma: float = 2.0) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(bits, level sizes, slot of each digest) of a minimal perfect hash; digests are distinct."""
    a, b = _words(digests)
    left, bits, sizes, at = np.arange(len(digests)), [], [], np.full(len(digests), -1)
    base = 0
    while len(left):
        m = max(64, int(gamma * len(left)))
        pos = (mix64(a[left] + np.uint64(len(sizes)) * b[left]) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(pos, minlength=m) == 1
        won = alone[pos]
        at[left[won]] = base + pos[won]
        bits.append(alone)
        sizes.append(m)
        base += m
        left = left[~won]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return flat, sizes, (np.cumsum(flat) - 1)[at]


def slots_of(digests: list[bytes], flat: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The slot each digest would have, -1 if it surely has none."""
    a, b = _words(digests)
    rank, out, open_, base = np.cumsum(flat) - 1, np.full(len(digests), -1), np.ones(len(digests), bool), 0
    for level, m in enumerate(sizes):
        pos = base + (mix64(a + np.uint64(level) * b) % np.uint64(m)).astype(np.int64)
        hit = open_ & flat[pos]
        out[hit] = rank[pos[hit]]
        open_ &= ~hit
        base += m
    return out


def _index_shard(shard: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    digests = pdf["digest"].tolist()
    flat, sizes, slot = build_mph(digests)
    order = np.argsort(slot)
    pack = lambda c: pdf[c].to_numpy("<i8")[order].tobytes()
    return pd.DataFrame([{
        "shard": shard[0], "n": len(digests), "bits": np.packbits(flat).tobytes(), "sizes": np.array(sizes, "<i8").tobytes(),
        "digests": b"".join(digests[i] for i in order), "keep_ids": pack("own_id"), "nones": pack("own_none"), "lengths": pack("own_len"), "copies": pack("own_size"),
    }])


def _lookup_shard(pdf: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The shard's slots, with what incoming digests add to them, and the incoming nonmembers."""
    digests, n = pdf["digest"].tolist(), len(pdf)
    own = np.stack([pdf[c].to_numpy("<i8") for c in ("own_len", "own_id", "own_none", "own_size")]) if n else np.zeros((4, 0), np.int64)
    member, out = np.zeros(n, bool), []
    if len(index):
        x = index.iloc[0]
        sizes = np.frombuffer(x["sizes"], "<i8").tolist()
        flat = np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: sum(sizes)].astype(bool)
        held = x["digests"]
        names = [held[k : k + 32] for k in range(0, len(held), 32)]
        slots = np.stack([np.frombuffer(x[c], "<i8") for c in ("lengths", "keep_ids", "nones", "copies")]).copy()
        if n:
            slot = slots_of(digests, flat, sizes)
            member = np.fromiter((s >= 0 and names[s] == d for s, d in zip(slot.tolist(), digests)), bool, n)
            at, new = slot[member], own[:, member]
            slots[3, at] += new[3]
            old = slots[:3, at]
            # more code points, then an id at all, then the smaller one
            better = (new[0] > old[0]) | (new[0] == old[0]) & ((new[2] < old[2]) | (new[2] == old[2]) & (new[1] < old[1]))
            slots[:3, at[better]] = new[:3, better]
        out.append((names, slots))
    out.append(([d for d, m in zip(digests, member) if not m], own[:, ~member]))
    values = np.concatenate([v for _, v in out], 1)
    return pd.DataFrame({"digest": pd.Series([d for names, _ in out for d in names], dtype=object), "keep_len": values[0], "keep_id": values[1], "keep_none": values[2], "size": values[3]})


def digest_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_cp, digest) of each row; null texts are empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).cast("long").alias("doc_id"), F.length(t).cast("long").alias("n_cp"), F.unhex(F.sha2(F.regexp_replace(t, SPACES, "").cast("binary"), 256)).alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row for each digest: its winner (most code points, then smallest id, null last) and
    its copies."""
    best = F.min(F.struct((-F.col("n_cp")).alias("l"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i")))
    return rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("own_size")).select("digest", (-F.col("b.l")).alias("own_len"), F.col("b.i").alias("own_id"), "own_size")


def with_shard(digests: DataFrame, shards: int) -> DataFrame:
    """Adds the shard, and own_none: 1 where own_id was null.  Batches hold 0 for it, as integers
    with nulls would come to pandas as floats."""
    digests = digests.withColumns({"own_none": F.col("own_id").isNull().cast("long"), "own_id": F.coalesce("own_id", F.lit(0))})
    return digests.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index, one row for each shard of ``history`` (rows of ``distinct_digests``)."""
    return with_shard(history, shards).groupBy("shard").applyInPandas(_index_shard, INDEX)


def exact_dedup(df: DataFrame, history: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``df``.

    ``history``: rows of ``distinct_digests`` over documents seen before, whose winners compete
    with the new rows and whose copies count; without it, history is made of half of the rows.
    Null and empty texts are one group; repeated rows of one id all carry that id as keep_id,
    and all count; an empty table gives an empty result; other columns are ignored.  Null ids
    come after all others; where the winner has none, keep_id is null, and kept is null in rows
    without an id, and where keep_id is null, as in the SQL.
    """
    ship(df.sparkSession)
    rows = staged(digest_rows(df, key, text), "digests")
    if history is None:
        old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
        past, new = distinct_digests(rows.where(old)), distinct_digests(rows.where(~old))
    else:
        past, new = history, distinct_digests(rows)
    return rows_of(rows, resolve(past, new))


def resolve(past: DataFrame, new: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of all digests of ``past``, through its index, and of those
    of ``new`` that it does not have; both are rows of ``distinct_digests``."""
    past, new = staged(past, "history"), staged(new, "incoming")
    shards = 1 + max(past.count(), new.count()) // SHARD_DIGESTS
    found = with_shard(new, shards).groupBy("shard").cogroup(build_index(past, shards).groupBy("shard")).applyInPandas(_lookup_shard, FOUND)
    return found.select("digest", F.when(F.col("keep_none") == 0, F.col("keep_id")).alias("keep_id"), F.col("size").alias("group_size"))


def rows_of(rows: DataFrame, answer: DataFrame) -> DataFrame:
    """The answer of each row's digest."""
    told = hot_join(rows, staged(answer, "answer"), "digest", "group_size", rows.count())
    return told.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""


def stage_exact_dedup(spark, docs, sf_dir):
    """Pipeline stage: the rows that stay, with the columns they had.  Of rows that repeat an
    id and its text, one stays; so does one of a group whose winner has no id.

    Documents are not shuffled: they are held against the (id, digest) pairs that go, or that
    occur more than once, which are few; only if they aren't, both sides are shuffled.  Null texts
    are empty; an empty table stays empty; other columns, whatever their names, are kept.
    """
    names = docs.columns
    of, sha, stays, n, own = unused(docs, "id", "sha", "stays", "n", "own")
    pairs = exact_dedup(docs).groupBy(F.col("doc_id").alias(of), F.col("text_sha256").alias(sha)).agg(F.max(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias(stays), F.count("*").alias(n))
    pairs = staged(pairs.where(~F.col(stays) | (F.col(n) > 1)).select(of, sha, stays), "dropped")
    if pairs.count() <= TOLD_ROWS:
        pairs = F.broadcast(pairs)
    t = F.coalesce(F.col("text"), F.lit(""))
    full = docs.withColumn(own, F.sha2(F.regexp_replace(t, SPACES, "").cast("binary"), 256))
    full = full.join(pairs, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(own) == F.col(sha)), "left")
    again = full.where(stays).dropDuplicates(["doc_id", own])
    return full.where(F.col(stays).isNull()).unionByName(again).select(*names)
