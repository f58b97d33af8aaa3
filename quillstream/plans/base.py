"""How the star-schema tables stand for rollouts.

An order is a rollout (row_id, uid: its customer), its line items are the tokens, in a total
order.  Token values are small multiples of powers of two, so sums are exact in any order.
Orders without line items are rollouts without a response.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, and its SQL."""

    def add(f):
        n = name or f.__name__
        QUERIES[n] = f
        if sql:
            ORACLES[n] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Deal rows out to tasks, by a key if there is one: files that hold few row groups are read by
    few tasks, and the work on their rows costs more than moving them."""
    return df.repartition(*key) if key else df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def r6(x: Column | str, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, places) + F.lit(0.0)


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]


VALUES = {
    "r": "CAST(CAST(l_quantity AS BIGINT) % 7 AS DOUBLE)", "m": "CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END", "v": "l_partkey % 11 / 4.0D", "logp": "-(l_partkey % 64) / 32.0D", "old_logp": "-(l_suppkey % 64) / 32.0D",
    "rollout_logp": "-((l_partkey + l_suppkey) % 64) / 32.0D", "ref_logp": "-(l_partkey * 3 % 64) / 32.0D", "q": "l_partkey % 16 / 16.0D", "adv": "(l_partkey + l_suppkey) % 9 / 4.0D - 1",
}


def _items(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """row_id, the columns that order a rollout's tokens, and the named values; dealt out by row."""
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), *ORDER, *[F.expr(VALUES[n]).alias(n) for n in names])
    return spread(li, "row_id")


def tokens(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """row_id, uid, t and the named values (all by default) in long form."""
    names = tuple(n for n in names or VALUES if n in VALUES)
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"))
    t = F.row_number().over(W.partitionBy("row_id").orderBy(*ORDER)) - 1
    x = _items(spark, sf, *names).select("row_id", t.cast("long").alias("t"), *names)
    return x.join(o, "row_id").select("row_id", "uid", "t", *names)


TOK = """tok AS (SELECT l_orderkey AS row_id, o_custkey AS uid,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount,
    l_tax) - 1 AS t,
  CAST(CAST(l_quantity AS BIGINT) % 7 AS DOUBLE) AS r, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS m,
  CAST(l_partkey % 11 AS DOUBLE) / 4 AS v, CAST(-(l_partkey % 64) AS DOUBLE) / 32 AS logp, CAST(-(l_suppkey % 64) AS DOUBLE) / 32 AS old_logp,
  CAST(-((l_partkey + l_suppkey) % 64) AS DOUBLE) / 32 AS rollout_logp, CAST(-(l_partkey * 3 % 64) AS DOUBLE) / 32 AS ref_logp,
    CAST(l_partkey % 16 AS DOUBLE) / 16 AS q,
  CAST((l_partkey + l_suppkey) % 9 AS DOUBLE) / 4 - 1 AS adv
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ARRAYS = {
    "token_level_rewards": "r", "response_mask": "m", "values": "v", "log_probs": "logp", "old_log_probs": "old_logp",
    "rollout_log_probs": "rollout_logp", "ref_log_prob": "ref_logp", "sum_pi_squared": "q", "advantages": "adv"
}


def rollouts(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """row_id, uid and the named arrays, one row for each order: one exchange on the order key, and
    one sort of each row's tokens."""
    names = names or tuple(ARRAYS)
    values = sorted({ARRAYS[n] for n in names})
    x = _items(spark, sf, *values).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct(*ORDER, *values))).alias("_x"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"))
    out = o.join(x, "row_id", "left")
    return out.select(
        "row_id", "uid",
        *[
            F.coalesce(
                F.transform("_x", lambda e: e[ARRAYS[n]]), F.array().cast("array<int>" if n == "response_mask" else "array<double>")
            ).alias(n) for n in names
        ]
    )


ROWS = (
    TOK
    + """, rows AS (SELECT o_orderkey AS row_id, o_custkey AS uid, coalesce(sum(r), 0.0) AS s, CAST(coalesce(sum(m), 0) AS BIGINT) AS n
  FROM orders LEFT JOIN tok ON row_id = o_orderkey GROUP BY 1, 2)"""
)
