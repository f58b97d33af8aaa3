"""Work balancing: partitions of weighted items with near-equal sums.

These heuristics are sequential over the items of one batch, which are few; many batches are
balanced side by side, one group of ``applyInPandas`` each.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def workload(length: Column) -> Column:
    """Cost of a sequence: linear layers and attention."""
    return 24576 * length + length * length


def differencing(weights: list[float], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: states of k partial sums, joined largest spread first, heavy parts
    of one with light parts of the other."""
    if not weights:
        return [[] for _ in range(k)]
    order = sorted(range(len(weights)), key=lambda i: (weights[i], i))
    if equal_size:
        if len(weights) % k:
            raise ValueError("the number of items must be a multiple of the number of parts")
        starts = [order[i : i + k] for i in range(0, len(order), k)]
    else:
        starts = [[i] for i in order]
    heap = []
    for serial, items in enumerate(starts):
        parts = sorted([(weights[i], [i]) for i in items] + [(0, []) for _ in range(k - len(items))], key=lambda p: (-p[0], p[1]))
        heap.append((-(parts[0][0] - parts[-1][0]), serial, parts))
    heapq.heapify(heap)
    serial = len(starts)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (-(joined[0][0] - joined[-1][0]), serial, joined))
        serial += 1
    return [sorted(p[1]) for p in heap[0][2]]


def lightest_first(weights: list[float], k: int) -> list[list[int]]:
    """Items in their given order, each to the lightest part."""
    heap, parts = [(0, p) for p in range(k)], [[] for _ in range(k)]
    for i, w in enumerate(weights):
        total, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (total + w, p))
    return parts


def longest_first(weights: list[float], k: int) -> list[list[int]]:
    heap, parts = [(0, p) for p in range(k)], [[] for _ in range(k)]
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        total, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (total + weights[i], p))
    return [sorted(p) for p in parts]


METHODS = {"differencing": differencing, "equal": lambda w, k: differencing(w, k, True), "lightest": lightest_first, "longest": longest_first}


def balance(df: DataFrame, batch: str, item: str, weight: str, k: int, method: str = "differencing") -> DataFrame:
    """(batch, item, weight, part): each batch's items in k parts.  Fewer items than parts is an error."""
    split = METHODS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item").reset_index(drop=True)
        if len(pdf) < k:
            raise ValueError(f"{len(pdf)} items can't fill {k} parts")
        part = pd.Series(0, index=pdf.index)
        for p, members in enumerate(split(pdf["weight"].tolist(), k)):
            part.iloc[members] = p
        return pdf.assign(part=part.astype("int32"))

    rows = df.select(F.col(batch).alias("batch"), F.col(item).cast("long").alias("item"), F.col(weight).cast("double").alias("weight"))
    kind = dict(rows.dtypes)["batch"]
    return rows.groupBy("batch").applyInPandas(run, f"batch {kind}, item long, weight double, part int")


def micro_batches(df: DataFrame, batch: str, item: str, length: str, limit: int) -> DataFrame:
    """Parts of at most about ``limit`` tokens each: ceil(sum / limit) of them, by workload."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item").reset_index(drop=True)
        k = max(1, min(len(pdf), -(-int(pdf["length"].sum()) // limit)))
        part = pd.Series(0, index=pdf.index)
        for p, members in enumerate(differencing([24576 * n + n * n for n in pdf["length"]], k)):
            part.iloc[members] = p
        return pdf.assign(part=part.astype("int32"))

    rows = df.select(F.col(batch).alias("batch"), F.col(item).cast("long").alias("item"), F.col(length).cast("long").alias("length"))
    return rows.groupBy("batch").applyInPandas(run, f"batch {dict(rows.dtypes)['batch']}, item long, length long, part int")


def centre_out(df: DataFrame, by: str, weight: str, key: str) -> DataFrame:
    """Add ``place``: heavy items in the middle, alternating sides as they get lighter."""
    w = W.partitionBy(by)
    rank = F.row_number().over(w.orderBy(F.desc(weight), key)) - 1
    n = F.count("*").over(w)
    middle = F.floor((n - 1) / 2)
    step = F.floor((rank + 1) / 2)
    return df.withColumn("place", F.when(rank % 2 == 1, middle + step).otherwise(middle - step).cast("int"))


def imbalance(df: DataFrame, part: str = "part", weight: str = "weight", by: str = "batch") -> DataFrame:
    sums = df.groupBy(by, part).agg(F.sum(weight).alias("s"))
    return sums.groupBy(by).agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("spread"))


def share_prefixes(df: DataFrame) -> DataFrame:
    """One prompt for each run of consecutive equal uids, with its responses in order."""
    from quillstream.operators.frame import consecutive_runs

    runs = consecutive_runs(df, "uid")
    return runs.groupBy("run", "uid").agg(
        F.min_by("prompt", "row_id").alias("prompt"),
        F.transform(F.sort_array(F.collect_list(F.struct("row_id", "response"))), lambda x: x["response"]).alias("responses")
    )


def balance_groups(df: DataFrame, batch: str, group: str, item: str, weight: str, k: int) -> DataFrame:
    """As ``balance``, but items of one group stay together: groups are the items, by their sums,
    and parts get equally many of them."""
    groups = df.groupBy(F.col(batch).alias("batch"), F.col(group).cast("long").alias("_g")).agg(F.sum(weight).alias("_w"))
    parts = balance(groups, "batch", "_g", "_w", k, "equal").select("batch", F.col("item").alias("_g"), "part")
    rows = df.select(
        F.col(batch).alias("batch"), F.col(group).cast("long").alias("_g"), F.col(item).cast("long").alias("item"),
        F.col(weight).cast("double").alias("weight")
    )
    return rows.join(parts, ["batch", "_g"]).withColumnRenamed("_g", "group")


def balanced_order(df: DataFrame, by: str = "batch") -> DataFrame:
    """Add ``place``, where an item stands once a batch is laid out part by part, and ``original``,
    where it stood: with it the order is restored."""
    w = W.partitionBy(by)
    place = F.row_number().over(w.orderBy("part", "item")) - 1
    return df.withColumns({"place": place, "original": F.row_number().over(w.orderBy("item")) - 1})
