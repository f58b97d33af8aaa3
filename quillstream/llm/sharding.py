"""Sharding by jump consistent hashing: no ring table, and an appended shard takes only its share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.core import mix64, staged, table
from quillstream.shipping import ship

#: Rows numbered by one task, about.
SLOT_ROWS = 50_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, by the jump recurrence, for all keys at once.  A key's
    jumps depend on the key alone, so going from n to n + 1 shards moves keys only into n."""
    k = mix64(np.asarray(keys).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    b, j = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    live = np.ones(len(k), bool)
    while live.any():
        b[live] = j[live]
        k[live] = k[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((k[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = j < shards
    return b


def jump_shard(key, shards: int):
    """Column: the shard of a long key, an Arrow-batched function; null keys count as -1."""

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(ids.to_numpy(), shards).astype(np.int32))

    return shard(F.coalesce(F.col(key).cast("long"), F.lit(-1)))


def shard_rows(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    The law is ``key``: id and shard count decide.  ``slot`` numbers a shard's rows without a
    gap: rows are numbered within hashed buckets of a shard, whose counts are then summed up, so
    no task orders a whole shard.  Null texts have size 1 and the checksum of nothing; repeated
    ids share a shard, each with its own slot; null ids share one; empty tables stay empty.
    """
    ship(df.sparkSession)
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # the size is taken before Python sees the ids, so that no text is sent to it; staged again,
    # as both uses below would hash the ids again
    rows = staged(df.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32")), "sizes")
    rows = staged(rows.withColumns({"shard": jump_shard("doc_id", shards), "grown_shard": jump_shard("doc_id", shards + 1)}), "shards")
    n = 1 + rows.count() // (SLOT_ROWS * shards)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(n)))
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("shard", "_b").orderBy("doc_id", "size", "text_crc32")))
    ahead = rows.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    ahead = ahead.withColumn("_a", F.sum("_n").over(W.partitionBy("shard").orderBy("_b")) - F.col("_n")).drop("_n")
    return rows.join(ahead, ["shard", "_b"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_a") + F.col("_r") - 1).alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int = 8, key: str = "doc_id") -> None:
    """Write ``df`` as one folder for each shard."""
    df.withColumn("shard", jump_shard(key, shards)).write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"))
