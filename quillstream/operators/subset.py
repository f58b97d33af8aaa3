"""Search for a representative subset: many seeded draws, and swaps that bring the best nearer.

A draw takes a quota of each stratum in the order of a seeded hash.  All draws are taken in one
scan: a row stays only where its hash is below what the quota needs, so that about quota times draws
rows are shuffled, not rows times draws.  The distance of a subset from the whole is the sum of
the Kolmogorov-Smirnov distances of its numbers and of the weighted total variations of its
categories.  Swaps within a stratum are tried on histograms: a swap moves one count of each
variable, so its distance is known in the time of the bins, whatever the size of the subset.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quillstream.operators.metrics import md5_draw

#: Bins of a number and levels of a category, at most; rarer levels count together as one.
BINS, LEVELS = 512, 200
#: Standard deviations above its expectation that a draw's threshold lies.
SLACK = 8.0
#: A level with less than this part of what it should have is missing; what that costs (fixed values).
COVERED, MISSING = 0.8, 100.0


def seeded_rows(df: DataFrame, quotas: DataFrame, draws: int, key: str = "stratum", spare: float = 0.0, slack: float = SLACK) -> DataFrame:
    """The rows of ``df`` (row_id, ``key``, …) that each draw takes, with ``draw`` and ``_k``, the place in its
    stratum from 1: the quota's number of rows, and ``spare`` times it more where there are so many.

    ``quotas``: key, n, quota.  A row is a candidate of a draw if its hash is below the share of
    the quota and SLACK deviations; the strata of a draw with too few candidates, which happens by
    chance less than once in 10^14, are taken again without a threshold.
    """
    want = F.least(F.ceil(F.col("quota") * (1 + spare)), F.col("n"))
    bound = (want + slack * F.sqrt(want) + int(slack > 0)) / F.col("n") * float(1 << 32)
    limits = quotas.select(F.col(key).alias("_key"), want.cast("long").alias("_want"), F.when(want >= F.col("n"), float(1 << 32)).otherwise(bound).alias("_bound")).where("_want > 0")
    told = df.join(limits, F.col(key) == F.col("_key")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    told = told.withColumn("_h", md5_draw(F.col("draw").cast("string"), F.col("row_id").cast("string")))
    placed = W.partitionBy("draw", key).orderBy("_h", "row_id")
    names = [*df.columns, "draw", "_h", "_want"]
    few = told.where("_h < _bound").select(*names)
    pairs = quotas.select(F.col(key).alias("_key"), want.cast("long").alias("_w")).where("_w > 0").withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    held = few.groupBy("draw", key).agg(F.count("*").alias("_n"))
    short = pairs.join(held, (F.col("_d") == F.col("draw")) & (F.col("_key") == F.col(key)), "left").where(F.coalesce("_n", F.lit(0)) < F.col("_w")).select("_key", "_d").collect()  # none, but for chance
    if short:
        again = df.sparkSession.createDataFrame([(r["_key"], r["_d"]) for r in short], T.StructType([T.StructField("_k2", quotas.schema[key].dataType), T.StructField("_d2", T.IntegerType())]))
        missed = (F.col(key) == F.col("_k2")) & (F.col("draw") == F.col("_d2"))
        few = few.join(F.broadcast(again), missed, "left_anti").unionByName(told.join(F.broadcast(again), missed, "left_semi").select(*names))
    return few.withColumn("_k", F.row_number().over(placed)).where("_k <= _want").drop("_h", "_want")


class Whole:
    """The distribution of the whole table: edges and distribution functions of numbers, levels and shares of categories."""

    def __init__(self, df: DataFrame, numbers: list[str], categories: dict[str, float]):
        self.numbers, self.categories = numbers, categories
        marks = [i / BINS for i in range(BINS + 1)]
        quantiles = df.agg(*[F.percentile_approx(F.col(c).cast("double"), marks).alias(c) for c in numbers], F.count("*").alias("_n")).first() if numbers else {"_n": df.count()}
        self.n = quantiles["_n"]
        self.edges = [np.unique(np.array(quantiles[c] or [], float)) for c in numbers]  # BINS at most
        self.levels, self.share = {}, {}
        for c in categories:
            top = df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(LEVELS).collect()
            names = {r["v"]: k for k, r in enumerate(top)}
            counts = [r["n"] for r in top]
            self.levels[c], self.share[c] = names, np.array([*counts, max(0, self.n - sum(counts))], float) / max(1, self.n)
        self.cdf = self._cdf(df)

    def _cdf(self, df: DataFrame) -> np.ndarray:
        """Of each number, the part of rows up to each edge: a task sends one row for each bin."""
        if not self.numbers:
            return np.zeros((0, BINS + 2))
        numbers, edges, width = self.numbers, self.edges, BINS + 2

        def run(batches):
            counts = np.zeros((len(numbers), width), np.int64)
            for batch in batches:
                for k, c in enumerate(numbers):
                    counts[k] += np.bincount(bins_of(batch.column(c).to_numpy(zero_copy_only=False).astype(float), edges[k]), minlength=width)
            v, b = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"v": pa.array(v, pa.int32()), "b": pa.array(b, pa.int32()), "n": pa.array(counts[v, b], pa.int64())})

        found = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).mapInArrow(run, "v int, b int, n long").groupBy("v", "b").agg(F.sum("n").alias("n")).collect()
        out = np.zeros((len(numbers), width))
        for r in found:  # variables times bins rows
            out[r["v"], r["b"]] = r["n"]
        return np.cumsum(out, 1) / max(1, self.n)

    def coded(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(bin of each number, level of each category) of rows."""
        b = np.stack([bins_of(pdf[c].to_numpy(float, na_value=np.nan), e) for c, e in zip(self.numbers, self.edges)], 1) if self.numbers else np.zeros((len(pdf), 0), np.int64)
        level = lambda c: [self.levels[c].get(None if pd.isna(v) else str(v), len(self.levels[c])) for v in pdf[c]]
        g = np.array([level(c) for c in self.categories], np.int64).T if self.categories else np.zeros((len(pdf), 0), np.int64)
        return b, g.reshape(len(pdf), len(self.categories))


def bins_of(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 for what is missing, then one bin up to each edge, and one beyond."""
    return np.where(np.isnan(values), 0, np.searchsorted(edges, values, "left") + 1)


class Subset:
    """The counts of a subset, and its distance from the whole."""

    def __init__(self, whole: Whole, bins: np.ndarray, levels: np.ndarray):
        self.whole, self.k = whole, max(1, len(bins))
        self.gap = np.stack([np.cumsum(np.bincount(bins[:, v], minlength=BINS + 2)) for v in range(bins.shape[1])]) / self.k - whole.cdf if bins.shape[1] else whole.cdf.copy()
        self.counts = [np.bincount(levels[:, c], minlength=len(whole.share[name])).astype(float) for c, name in enumerate(whole.categories)]

    def parts(self) -> tuple[list[float], list[float], float]:
        """(KS of each number, total variation of each category, least coverage)."""
        ks = np.abs(self.gap).max(1).tolist() if len(self.gap) else []
        tv, cover = [], [1.0]
        for counts, share in zip(self.counts, self.whole.share.values()):
            tv.append(0.5 * float(np.abs(counts / self.k - share).sum()))
            cover.append(float((counts[share > 0] / (share[share > 0] * self.k)).min()))
        return ks, tv, min(cover)

    def distance(self) -> float:
        ks, tv, cover = self.parts()
        return sum(ks) + sum(w * t for w, t in zip(self.whole.categories.values(), tv)) + (MISSING if cover < COVERED else 0.0)

    def swap(self, out: tuple, into: tuple) -> None:
        """One row for another: a distribution function changes between their bins only."""
        for v, (a, b) in enumerate(zip(out[0], into[0])):
            if a < b:
                self.gap[v, a:b] -= 1 / self.k
            elif b < a:
                self.gap[v, b:a] += 1 / self.k
        for counts, a, b in zip(self.counts, out[1], into[1]):
            counts[a] -= 1
            counts[b] += 1


def _polish(whole: Whole, swaps: int, seed: int, names: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", "_k"], ignore_index=True)
        draw = int(pdf["draw"].iloc[0])
        bins, levels = whole.coded(pdf)
        on = pdf["_in"].to_numpy(bool).copy()
        now = Subset(whole, bins[on], levels[on])
        before = best = now.distance()
        group = pd.factorize(pdf["_s"])[0]
        chosen = [i for i in np.flatnonzero(on).tolist() if not pdf["_fixed"].iloc[i]]
        free = {s: [i for i in np.flatnonzero(~on & (group == s)).tolist()] for s in set(group[chosen].tolist())}
        rng, done = np.random.default_rng([seed, draw]), 0
        rows = list(zip(map(tuple, bins.tolist()), map(tuple, levels.tolist())))
        for _ in range(swaps if chosen else 0):
            a = int(rng.integers(len(chosen)))
            others = free[group[chosen[a]]]
            if not others:
                continue
            b = int(rng.integers(len(others)))
            i, j = chosen[a], others[b]
            now.swap(rows[i], rows[j])
            d = now.distance()
            if d < best - 1e-12:
                best, chosen[a], others[b], done = d, j, i, done + 1
                on[i], on[j] = False, True
            else:
                now.swap(rows[j], rows[i])
        ks, tv, cover = Subset(whole, bins[on], levels[on]).parts()
        return pd.DataFrame([(draw, before, best, done, max(ks, default=0.0), max(tv, default=0.0), cover, pdf["row_id"].to_numpy()[on].tolist())], columns=names)

    return run


POLISHED = "draw int, before double, after double, swaps int, ks double, tv double, coverage double, row_ids array<long>"


def polished(
    df: DataFrame, quotas: DataFrame, draws: int, numbers: list[str], categories: dict[str, float], swaps: int = 2000, key: str = "stratum", spare: float = 1.0, seed: int = 0, fixed: str | None = None,
) -> DataFrame:
    """One row for each draw: its distance before and after swaps, how many were made, its largest
    KS distance and total variation, its least coverage, and the ids it ends with.

    ``df``: row_id, ``key``, numbers and categories (name: weight of its total variation); ``quotas``:
    key, n, quota.  A draw swaps rows for the next ones of their stratum in its order, ``spare``
    times the quota, so a task holds (1 + spare) subsets whatever the size of the table; draws are
    side by side.  Rows whose column ``fixed`` is true are in every subset, count towards the
    quota of their stratum, and are not swapped.  Missing numbers are a bin, missing categories a
    level of their own; a stratum with no spare rows keeps its own.
    """
    whole = Whole(df, numbers, categories)
    told = df.sparkSession.sparkContext.broadcast(whole)  # bins and levels: bounded
    rows = df.select("row_id", key, *numbers, *categories, (F.coalesce(F.col(fixed), F.lit(False)) if fixed else F.lit(False)).alias("_fixed"))
    kept = rows.where("_fixed")
    sizes = kept.groupBy(F.col(key).alias("_f")).agg(F.count("*").alias("_nf"))
    open_ = quotas.join(sizes, F.col(key) == F.col("_f"), "left").fillna({"_nf": 0}).select(key, (F.col("n") - F.col("_nf")).alias("n"), F.greatest(F.col("quota") - F.col("_nf"), F.lit(0)).alias("quota"))
    drawn = seeded_rows(rows.where("NOT _fixed"), open_, draws, key, spare)
    drawn = drawn.join(F.broadcast(open_.select(F.col(key).alias("_q"), "quota")), F.col(key) == F.col("_q")).withColumn("_in", F.col("_k") <= F.col("quota")).drop("_q", "quota")
    if fixed:
        again = kept.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumns({"_k": F.lit(0), "_in": F.lit(True)})
        drawn = drawn.unionByName(again)
    names = [c.split()[0] for c in POLISHED.split(", ")]
    return drawn.withColumnRenamed(key, "_s").groupBy("draw").applyInPandas(lambda pdf: _polish(told.value, swaps, seed, names)(pdf), POLISHED)


def best_subset(found: DataFrame) -> DataFrame:
    """The draw that ends nearest the whole (the first of equals), one row for each of its ids."""
    best = found.orderBy("after", "draw").limit(1)
    return best.select("draw", "before", "after", "ks", "tv", "coverage", F.explode("row_ids").alias("row_id"))
