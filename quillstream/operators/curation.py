"""Representative subsets: strata, quotas, seeded draws, distribution tests, panels and shards."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.operators.frame import running_sum, with_position
from quillstream.operators.metrics import md5_draw
from quillstream.operators.subset import seeded_rows

#: Ranges of letters by script (fixed values of Unicode blocks).
SCRIPTS = {
    "ascii": "A-Za-z",
    "cjk": "\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}",
    "cyrillic": "\\x{0400}-\\x{052F}",
    "arabic": "\\x{0600}-\\x{06FF}",
    "devanagari": "\\x{0900}-\\x{097F}",
    "hangul": "\\x{1100}-\\x{11FF}\\x{AC00}-\\x{D7AF}",
}


def script_ratios(text: str) -> dict[str, Column]:
    """Share of each script's letters in all code points, and of other letters."""
    n = F.greatest(F.length(text), F.lit(1))
    out = {k: F.regexp_count(F.col(text), F.lit(f"[{v}]")) / n for k, v in SCRIPTS.items()}
    out["other"] = F.regexp_count(F.col(text), F.lit(f"[\\p{{L}}&&[^{''.join(SCRIPTS.values())}]]")) / n
    return out


def is_loop(text: str | None, least: int = 50) -> bool:
    """At least ``least`` words, with few distinct ones or one 8-gram in over half the places."""
    w = (text or "").split()
    if len(w) < least:
        return False
    grams = Counter(zip(*[w[i:] for i in range(8)]))
    return len(set(w)) / len(w) < 0.15 or max(grams.values()) / (len(w) - 7) > 0.5


def loops(text: Column) -> Column:
    """Arrow-batched: array expressions would build the words anew for each 8-gram."""

    @F.pandas_udf(T.BooleanType())
    def run(t: pd.Series) -> pd.Series:
        return t.map(is_loop)

    return run(text)


def availability(flags: list[str]) -> Column:
    """Bit mask of the runs that have a row."""
    return sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))


def item_difficulty(df: DataFrame, items: str, score: str) -> DataFrame:
    """(row_id, difficulty): the mean score of each item over rows, averaged back over a row's
    items with multiplicity; rows without a score only receive."""
    x = df.select("row_id", score, F.explode(items).alias("item"))
    mean = x.groupBy("item").agg(F.avg(score).alias("m"))
    return x.join(mean, "item").groupBy("row_id").agg(F.avg("m").alias("difficulty"))


def id_pairs(df: DataFrame, items: str) -> DataFrame:
    """(a, b, n): rows that have both items, a < b.  Pairs are of a row's own few items."""
    ids = F.sort_array(F.array_distinct(F.col(items)))
    pairs = F.flatten(F.transform(ids, lambda a: F.transform(F.filter(ids, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def quantile_bucket(df: DataFrame, column: str, k: int, out: str) -> DataFrame:
    """Buckets by quantile edges, equal edges merged: equal values share a bucket."""
    edges = df.agg(F.array_distinct(F.percentile(column, [i / k for i in range(1, k)])).alias("_edges"))
    return df.join(F.broadcast(edges)).withColumn(out, F.size(F.filter("_edges", lambda e: F.col(column) > e))).drop("_edges")


def rank_share(column: str, by: list[str] = ()) -> Column:
    """Mean rank of equal values over the count."""
    w = W.partitionBy(*by)
    return (F.rank().over(w.orderBy(column)) + (F.count("*").over(W.partitionBy(*by, column)) - 1) / 2) / F.count("*").over(w)


def finest_stratum(df: DataFrame, levels: list[str], share: float, least: float = 5.0) -> DataFrame:
    """Add ``stratum``: the finest key (levels go from coarse to fine) whose expected draw is at
    least ``least``; the coarsest otherwise."""
    choice = F.concat(F.lit("0:"), F.col(levels[0]).cast("string"))
    for i, key in enumerate(levels[1:], 1):
        enough = F.count("*").over(W.partitionBy(*levels[: i + 1])) * share >= least
        choice = F.when(enough, F.concat(F.lit(f"{i}:"), F.concat_ws("|", *[F.col(x).cast("string") for x in levels[: i + 1]]))).otherwise(choice)
    return df.withColumn("stratum", choice)


def largest_remainder(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """(key, n, quota): ``total`` seats in proportion, by floors and then largest fractions."""
    one = W.partitionBy(F.lit(0))
    exact = F.col(n) * F.lit(total) / F.sum(n).over(one)
    x = counts.withColumn("_f", F.floor(exact)).withColumn("_r", exact - F.floor(exact))
    x = x.withColumn("_k", F.row_number().over(one.orderBy(F.desc(F.round("_r", 9)), key)))
    return x.withColumn(
        "quota", (F.col("_f") + F.when(F.col("_k") <= F.lit(total) - F.sum("_f").over(one), 1).otherwise(0)).cast("long")
    ).drop("_f", "_r", "_k")


def nearest_quota(counts: DataFrame, key: str, n: str, total: int, fixed: str | None = None) -> DataFrame:
    """Quotas nearest the proportional ones in L2 with at least ``fixed`` and at most n each.

    A seat goes to who is furthest below, so all stop at one level, which is found by bisection
    over the strata (one row each), not seat by seat; of equals the smaller key gets the seat."""
    rows = counts.withColumns({"_n": F.col(n).cast("long"), "_base": (F.col(fixed) if fixed else F.lit(0)).cast("long")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size, base = pdf["_n"].to_numpy(), pdf["_base"].to_numpy()
        ideal = size * total / max(1, size.sum())
        left = max(0, total - int(base.sum()))
        upto = lambda c: np.clip(np.floor(ideal + c), base, np.maximum(size, base)).astype(np.int64)
        low, high = -float(total + 1), float(size.max() + 1)
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if (upto(mid) - base).sum() <= left else (low, mid)
        quota = upto(low - 1e-7)  # equals stay open
        pdf["quota"] = quota
        rest = left - int((quota - base).sum())
        open_ = pdf[quota < size].assign(_m=np.round(2 * (quota + 1 - ideal) - 1, 9)[quota < size]).sort_values(["_m", key])
        pdf.loc[open_.index[:rest], "quota"] += 1
        return pdf.drop(columns=["_n", "_base"])

    schema = ", ".join(f"`{c}` {t}" for c, t in counts.dtypes) + ", quota long"
    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda pdf: run(pdf.drop(columns="_one")), schema)


def stratified_draw(df: DataFrame, quotas: DataFrame, seed: int, key: str = "stratum") -> DataFrame:
    """The quota's number of rows of each stratum, in the order of a seeded md5 of row_id."""
    d = df.withColumn("_h", md5_draw(F.lit(str(seed)), F.col("row_id").cast("string")))
    d = d.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("_h", "row_id")))
    return d.join(quotas.select(key, "quota"), key).where("_k <= quota").drop("_h", "_k", "quota")


def rerandomise(df: DataFrame, quotas: DataFrame, draws: int, covariates: list[str], key: str = "stratum") -> DataFrame:
    """Of ``draws`` seeded stratified draws, the one whose covariate means are nearest the whole's
    (sum of squared standardised differences): (draw, score), best first."""
    d = seeded_rows(df.select("row_id", key, *covariates), quotas, draws, key)
    whole = df.agg(*[x for c in covariates for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    means = d.groupBy("draw").agg(*[F.avg(c).alias(c) for c in covariates]).join(F.broadcast(whole))
    score = sum((F.pow((F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(1e-12)), F.lit(2)) for c in covariates), F.lit(0.0))
    return means.select("draw", score.alias("score")).orderBy("score", "draw")


def ks_distance(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Largest gap between two empirical distribution functions.  Values are counted first, and
    counts run up in ranges of values, so that no task orders all of them."""
    x = a.groupBy(column).agg(F.count("*").alias("na")).join(
        b.groupBy(column).agg(F.count("*").alias("nb")), column, "full"
    ).where(F.col(column).isNotNull())
    x = x.select(column, F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    totals = x.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    x = running_sum(running_sum(x, "na", column, "ca"), "nb", column, "cb").join(F.broadcast(totals))
    return x.agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("ks"))


def total_variation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Half the sum of differences between shares; 0 if either side is empty."""
    na, nb = a.agg(F.count("*").alias("ta")), b.agg(F.count("*").alias("tb"))
    x = a.groupBy(column).agg(F.count("*").alias("na")).withColumnRenamed(column, "_k").join(
        b.groupBy(column).agg(F.count("*").alias("nb")), F.col("_k").eqNullSafe(F.col(column)), "full"
    )
    x = x.join(F.broadcast(na)).join(F.broadcast(nb))
    share = lambda n, t: F.coalesce(F.col(n), F.lit(0)) / F.col(t)
    return x.where("ta > 0 AND tb > 0").agg(F.coalesce(0.5 * F.sum(F.abs(share("na", "ta") - share("nb", "tb"))), F.lit(0.0)).alias("tv"))


def coverage(whole: DataFrame, subset: DataFrame, column: str, share: float) -> DataFrame:
    """The least ratio of observed to expected counts over the values of the whole."""
    x = whole.groupBy(column).agg(F.count("*").alias("n")).join(subset.groupBy(column).agg(F.count("*").alias("k")), column, "left")
    return x.agg(F.min(F.coalesce("k", F.lit(0)) / (F.col("n") * share)).alias("coverage"))


def mean_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``, the mean rank of equal values: values are counted, and counts run up in ranges."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = running_sum(counts, "_n", "_v", "_to").select("_v", (F.col("_to") - F.col("_n") / 2 + 0.5).alias(out))
    return df.join(ranks, F.col(column) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    return mean_ranks(mean_ranks(x, "a", "ra"), "b", "rb").agg(F.corr("ra", "rb").alias("spearman"))


def panels(df: DataFrame, order: str, k: int = 4) -> DataFrame:
    """Add ``panel``: rows in order, k at a time, dealt forwards and backwards in turn."""
    x = with_position(df, order, "_r", ["row_id"])
    return x.withColumn("panel", F.when(F.floor(F.col("_r") / k) % 2 == 0, F.col("_r") % k).otherwise(k - 1 - F.col("_r") % k).cast("int")).drop("_r")


def acceptance(limits: dict[str, float]) -> Column:
    """All metrics are below their limits."""
    ok = F.lit(True)
    for name, limit in limits.items():
        ok = ok & (F.col(name) < limit)
    return ok


def keyset_digest(df: DataFrame, key: str, width: int = 1 << 16) -> DataFrame:
    """SHA-256 of the digests of ranges of ids, in order; a range's digest is that of its ids, ordered, one to
    a line.  Ranges are ``width`` ids wide and hashed where they lie; one task sees a digest for each."""
    ranges = df.groupBy(F.floor(F.col(key) / width).alias("r")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda i: i.cast("string")), "\n").alias("ids"))
    parts = ranges.select("r", F.sha2(F.col("ids").cast("binary"), 256).alias("h"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), "\n")
    return parts.agg(F.sha2(whole.cast("binary"), 256).alias("sha256"))


def keyset_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """SHA-256 of the ids, ordered by number, each with a line feed after it: for manifests that are
    compared with others' digests.  Such a digest goes through all ids one after the other, in one task;
    large sets are told apart by ``keyset_digest``."""

    def run(batches):
        digest = hashlib.sha256()
        for batch in batches:
            digest.update("".join(f"{i}\n" for i in batch.column(0).to_pylist()).encode())
        yield pa.RecordBatch.from_pydict({"sha256": [digest.hexdigest()]})

    return df.select(F.col(key).alias("k")).orderBy("k").coalesce(1).mapInArrow(run, "sha256 string")


def override(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Full outer join by key; the override's values come first."""
    names = [c for c in base.columns if c != key]
    o = over.select(key, *[F.col(c).alias(f"_o_{c}") for c in names if c in over.columns])
    out = base.join(o, key, "full")
    return out.select(key, *[F.coalesce(f"_o_{c}", c).alias(c) if c in over.columns else F.col(c) for c in names])


def in_all(parts: list[DataFrame], key: str) -> DataFrame:
    """Keys that every part has."""
    out = parts[0].select(key).distinct()
    for p in parts[1:]:
        out = out.join(p.select(key), key, "left_semi")
    return out


def later_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union by key in which a later part's row replaces an earlier one's."""
    x = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        x = x.unionByName(p.withColumn("_part", F.lit(i)))
    return x.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_part")))).where("_k = 1").drop("_k", "_part")


def exact_cover(parts: list[DataFrame], whole: DataFrame, key: str) -> bool:
    """The parts are disjoint and make up the whole."""
    x = parts[0].select(key)
    for p in parts[1:]:
        x = x.unionByName(p.select(key))
    return x.groupBy(key).count().where("count > 1").isEmpty() and x.exceptAll(whole.select(key)).isEmpty() and whole.select(key).exceptAll(x).isEmpty()


def source_bucket(key: Column) -> Column:
    """A stable bucket of an example's id, by the prefixes and patterns of its sources."""
    part = F.regexp_replace(F.regexp_replace(F.substr(key, F.lit(15)), r"_[0-9]+$", ""), r"_[a-z0-9]{16,}$", "")
    out = F.when(F.startswith(key, F.lit("ai2-adapt-dev/")), F.concat(F.lit("ai2/"), part))
    for prefix in ("personas_math_easy_", "personahub_", "oasst1_", "hard_coded_"):
        out = out.when(F.startswith(key, F.lit(prefix)), F.lit(prefix.rstrip("_")))
    first = F.nullif(F.regexp_extract(key, r"^([^_./]*)", 1), F.lit(""))
    return out.when(
        F.startswith(key, F.lit("science.")), F.regexp_replace(key, r"\.[^.]*$", "")
    ).when(key.rlike("^[a-z0-9]{5,12}$"), F.lit("opaque_short_id")).otherwise(F.coalesce(first, F.lit("unknown")))


def over_runs(columns: list[str]) -> Column:
    """struct(n, mean, std) of the values that are there; std with n - 1, null for fewer than two."""
    a = F.array_compact(F.array(*[F.when(~F.isnan(c), F.col(c)) for c in columns]))
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    std = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (n - 1))
    return F.struct(n.cast("long").alias("n"), F.when(n > 0, mean).alias("mean"), F.when(n > 1, std).alias("std"))


#: Defects in the order in which they count (fixed values).
DEFECTS = ("short_y0", "short_y1", "suspect_loop_y1", "loop_y0", "duplicate", "cot_marker")


def defect_class(available: Column, flags: dict[str, Column]) -> Column:
    """The first defect that a row has; ``no_anchor`` without any run, ``clean`` without a defect."""
    out = F.when(available == 0, "no_anchor")
    for name in DEFECTS:
        if name in flags:
            out = out.when(F.coalesce(flags[name], F.lit(False)), name)
    return out.otherwise("clean")


def satisfied_bucket(satisfied: Column, available: Column) -> Column:
    return F.when(available == 0, "no_anchor").when(satisfied == 0, "none").when(satisfied == available, "all").otherwise("some")


def observed_cost(counts: list[tuple[str, str]], default: int = 65536) -> Column:
    """struct(cost, assumed): the largest sum of both counts over the runs, or the whole budget."""
    costs = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a) + F.col(b)) for a, b in counts]
    most = F.array_max(F.array(*costs))
    return F.struct(F.coalesce(most, F.lit(default)).cast("long").alias("cost"), most.isNull().alias("assumed"))


def audit(df: DataFrame, wanted: DataFrame, key: str, ready: Column, complete: Column, y0: Column, y1: Column) -> DataFrame:
    """(issue, n) of a generated run against its manifest: keys that are missing or too many, and
    why rows are not ready."""
    x = df.withColumn("_ready", ready)
    bad = F.array_compact(
        F.array(
            F.when(F.size(y0) <= 0, "missing_y0"), F.when(F.size(y1) <= 0, "missing_y1"),
            F.when(~complete, "incomplete_score").otherwise("malformed_count_ppl_or_length")
        )
    )
    issues = x.where("NOT _ready").select(F.explode(bad).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    counted = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
    missing, extra = wanted.join(df, key, "left_anti"), df.join(wanted, key, "left_anti")
    return issues.union(counted(missing, "missing key")).union(counted(extra, "extra key")).union(counted(x.where("_ready"), "ready"))


def digests(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, sha256) of the columns' text, to hold two copies of a table against each other."""
    return df.select(key, F.sha2(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).cast("binary"), 256).alias("sha256"))


def differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose digest is not the same, or not there, in both."""
    x = a.join(b.withColumnRenamed("sha256", "_b"), key, "full")
    return x.where(~F.col("sha256").eqNullSafe(F.col("_b"))).select(key)


def aligned(tokens: Column, probs: Column, offsets: tuple[int, ...] = (0, 1, -1)) -> Column:
    """The slice of log probabilities that has one for each token, at the first offset that does."""
    n = F.size(tokens)
    tries = [
        F.when(
            F.size(probs) >= n + o, F.slice(probs, 1 + o if o > 0 else 1, n)
        ) if o >= 0 else F.concat(F.array(F.lit(None).cast("double")), F.slice(probs, 1, n - 1)) for o in offsets
    ]
    whole = [F.when((F.size(t) == n) & ~F.exists(F.slice(t, 2, n), lambda x: x.isNull()), t) for t in tries]
    return F.coalesce(*whole)
