"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.core import drop_staged, hot_join, staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """The edges with ``m``, the least v of each u: minima are combined before the shuffle, and
    those of vertices with very many edges are told to all tasks."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")  # read three times
    return hot_join(edges, least, "u", "n", total).drop("n")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) for each vertex of ``edges`` (u long, v long) but the roots: the least vertex that
    it reaches.  Each step points the neighbours of a vertex at the least of them, until nothing
    changes; every vertex then points at its root.  Steps are cut by staged tables, of which the
    last one stays.  Repeated edges, loops and edges either way are taken; null vertices are not;
    without edges the result is empty."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = staged(edges, "edges")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        small = _with_least(large, before[0])
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # a vertex with other neighbours than the least one has that one too, so it points there
        done, edges = edges, staged(small.where("u <> v").distinct(), "edges")
        drop_staged(done)
        drop_staged(large)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select("u", F.col("v").alias("root"))
