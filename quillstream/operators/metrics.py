"""Metric roll-ups: data metrics, validation metrics, bootstraps, percentiles, stepwise rules."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.functions import masked as M


def reduce_by_name(df: DataFrame) -> DataFrame:
    """(name, value): a name with ``max`` takes the maximum, else with ``min`` the minimum, else the mean."""
    return df.groupBy("name").agg(
        F.when(
            F.contains(F.col("name"), F.lit("max")), F.max("value")
        ).when(F.contains(F.col("name"), F.lit("min")), F.min("value")).otherwise(F.avg("value")).alias("value")
    )


def reduce_tagged(df: DataFrame) -> DataFrame:
    """METRIC_LONG: sums and means are averaged over ranks at each position and then reduced;
    minima and maxima are over all."""
    by_pos = df.groupBy("name", "aggregation", "pos").agg(F.avg("value").alias("v"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    a = F.col("aggregation")
    return by_pos.groupBy("name", "aggregation").agg(
        F.when(a == "sum", F.sum("v")).when(a == "mean", F.avg("v")).when(a == "min", F.min("lo")).otherwise(F.max("hi")).alias("value")
    )


def step_rule(name: Column) -> Column:
    """The roll-up rule of a metric over steps, by the first part of its name that matches."""
    has = lambda x: F.contains(name, F.lit(x))
    return F.when(has("timing_s"), "sum").when(has("mean") | has("avg"), "avg").when(has("max"), "max").when(has("min"), "min").when(has("sum") | has("total"), "sum").otherwise("avg")


def roll_up_steps(df: DataFrame, last: tuple[str, ...] = ()) -> DataFrame:
    """(name, step, value) to (name, rule, value); names in ``last`` keep their last value."""
    rule = F.when(F.col("name").isin(*last), "last").otherwise(step_rule(F.col("name"))) if last else step_rule(F.col("name"))
    d = df.withColumn("rule", rule)
    value = F.when(F.col("rule") == "sum", F.sum("value")).when(F.col("rule") == "max", F.max("value")).when(F.col("rule") == "min", F.min("value")).when(
        F.col("rule") == "last", F.max_by("value", "step")
    ).otherwise(F.avg("value"))
    return d.groupBy("name", "rule").agg(value.alias("value"))


def data_metrics(df: DataFrame, max_response: int) -> DataFrame:
    """One row of scalars over rows with arrays token_level_scores, token_level_rewards,
    advantages, returns, values and response_mask.  Rows without a response count in lengths, not
    in scores and rewards.  Variances are of tokens, by the built-in aggregate, whose partial
    results merge without a difference of large sums."""
    n = M.mask_count("response_mask")
    whole = df.select(M.array_sum("token_level_scores").alias("score"), M.array_sum("token_level_rewards").alias("reward"), n.alias("n"))
    some, out = F.col("n") > 0, []
    for c in ("score", "reward"):
        out += [f(F.when(some, F.col(c))).alias(f"{c}_{k}") for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    out += [
        F.avg("n").alias("length_mean"), F.max("n").alias("length_max"), F.min("n").alias("length_min"),
        F.avg((F.col("n") == max_response).cast("double")).alias("clip_ratio"), F.avg((F.col("n") == 0).cast("double")).alias("aborted_ratio")
    ]
    out += [F.avg(F.when(some, F.col("n"))).alias("present_length_mean")]
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in ("advantages", "returns", "values")], F.col("response_mask").alias("m"))
    t = df.select(F.explode(zipped).alias("x")).where("x.m = 1").select("x.*")
    tokens = [f(c).alias(f"{c}_{k}") for c in ("advantages", "returns", "values") for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    tokens += [(1 - F.var_samp(F.col("returns") - F.col("values")) / (F.var_samp("returns") + 1e-5)).alias("explained_variance")]
    return whole.agg(*out).join(F.broadcast(t.agg(*tokens)))  # one row each


def _valid(c: str) -> Column:
    return F.transform(F.filter(F.arrays_zip(F.col(c).alias("v"), F.col("response_mask").alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])


def to_long(df: DataFrame) -> DataFrame:
    """One row of metrics as (name, value) rows."""
    return df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("x")
    ).select("x.name", "x.value")


def timing_metrics(df: DataFrame) -> DataFrame:
    """(section, seconds, prompt_tokens, response_tokens): seconds, and milliseconds a token; the
    section ``gen`` counts response tokens only."""
    tokens = F.when(F.col("section") == "gen", F.sum("response_tokens")).otherwise(F.sum("prompt_tokens") + F.sum("response_tokens"))
    return df.groupBy("section").agg(F.sum("seconds").alias("seconds"), (F.sum("seconds") * 1000 / tokens).alias("ms_per_token"))


def variance_proxy(df: DataFrame) -> DataFrame:
    """E[A^2 W], E[W] and the noise of the gradient from rows with advantages, sum_pi_squared and
    old_log_probs arrays: W is the row's sum of 1 - 2p + sum of squares."""
    w = M.masked_sum(F.zip_with("old_log_probs", "sum_pi_squared", lambda l, q: 1 - 2 * F.exp(l) + q), "response_mask")
    a = M.masked_sum("advantages", "response_mask") / F.greatest(M.mask_count("response_mask"), F.lit(1))
    rows = df.select(w.alias("w"), a.alias("a"))
    power, signal = F.avg(F.col("a") * F.col("a") * F.col("w")), F.pow(F.avg(F.col("a") * F.sqrt("w")), F.lit(2))
    return rows.agg(
        power.alias("power"), F.avg("w").alias("mean_w"),
        F.greatest(F.lit(0.0), (power - signal) / F.greatest(F.count("*") - 1, F.lit(1))).alias("noise")
    )


def majority(df: DataFrame, by: list[str], vote: str = "pred", value: str = "value", pos: str = "pos") -> DataFrame:
    """The most frequent vote of each group, the earliest seen of equals, with its first value."""
    votes = df.groupBy(*by, vote).agg(F.count("*").alias("n"), F.min(pos).alias("first"), F.min_by(value, pos).alias("v"))
    best = F.max_by(F.struct(F.col(vote).alias("vote"), F.col("v").alias("value"), F.col("n").alias("n")), F.struct(F.col("n"), -F.col("first")))
    return votes.groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.vote").alias("vote"), F.col("b.n").alias("votes"), F.col("b.value").alias("value")
    )


def md5_draw(*parts: Column) -> Column:
    """A number of 32 bits from the md5 of parts: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def bootstrap(
    df: DataFrame, by: list[str], size: int, resamples: int = 1000, seed: int = 42, reducer="max", value: str = "value", pos: str = "pos"
) -> DataFrame:
    """Mean and population deviation, over resamples, of a reducer of ``size`` values drawn with
    replacement from each group; ``pos`` numbers a group's values from 0.  A reducer is a name, or
    a function of an array column.

    A group is gathered once as an array, resamples are rows, and draws are array lookups, so
    nothing is joined and a group's values are held once."""
    groups = df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias("_v"))
    rows = groups.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    n = F.size("_v")
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in by])
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda k: F.element_at("_v", (md5_draw(F.lit(str(seed)), key, F.col("b").cast("string"), k.cast("string")) % n + 1).cast("int"))
    )
    known = {"max": F.array_max, "min": F.array_min, "mean": lambda a: M.array_sum(a) / size}
    reduced = (reducer if callable(reducer) else known[reducer])(draws)
    return rows.select(*by, reduced.alias("r")).groupBy(*by).agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"))


def sizes_ladder(n: Column) -> Column:
    """2, 4, 8, ... below n, and n."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.pow(F.lit(2.0), i).cast("long")), lambda p: p < n)
    return F.array_distinct(F.concat(powers, F.array(n.cast("long"))))


#: Draws that a task holds at once, about; one resample of a group at least.
DRAWS = 1_000_000


def ladder_draws(values: np.ndarray, known: np.ndarray, codes: np.ndarray, start: str, blocks: range) -> Iterator[tuple]:
    """(size, best, worst, maj, and whether each is there) for the sizes of a group's ladder, an item for each resample of
    ``blocks``.  A draw's number doesn't know the size, so a smaller size has the first draws of a larger one: each is made once."""
    n, m, kinds = len(values), len(blocks), int(codes.max()) + 1
    ends = [f":{k}".encode() for k in range(n)]
    drawn = b"".join([md5(at + k).digest()[:4] for at in (f"{start}:{b}".encode() for b in blocks) for k in ends])
    drawn = (np.frombuffer(drawn, ">u4").astype(np.int64) % n).reshape(m, n)
    v, ok, row = values[drawn], known[drawn], np.arange(m)
    vote = codes[drawn] + row[:, None] * kinds
    votes, first = np.zeros(m * kinds, np.int64), np.full(m * kinds, n, np.int64)
    best, worst, there, at = np.full(m, -np.inf), np.full(m, np.nan), np.zeros(m, bool), 0
    for size in [*(2**i for i in range(1, 31) if 2**i < n), n]:
        part, good = v[:, at:size], ok[:, at:size]
        best = np.maximum(best, np.where(good, part, -np.inf).max(1))  # NaN is the largest
        worst, there = np.fmin(worst, np.fmin.reduce(np.where(good, part, np.nan), 1)), there | good.any(1)
        cast, place = vote[:, at:size].ravel(), np.tile(np.arange(at, size), m)
        votes += np.bincount(cast, minlength=m * kinds)
        seen = np.full(m * kinds, n, np.int64)
        seen[cast[::-1]] = place[::-1]  # the last one written stays: the earliest
        first, at = np.minimum(first, seen), size
        top = np.where(votes > 0, votes * (n + 1) - first, -1).reshape(m, kinds).argmax(1)
        place = first.reshape(m, kinds)[row, top]  # the one drawn first of equals
        yield size, best, worst, v[row, place], there, ok[row, place]


def resampled(groups: DataFrame, by: list[str], resamples: int, seed: int) -> DataFrame:
    """(by, size, best, worst, maj) of each resample of groups, whose values and votes stand in order in ``_v``."""
    step = F.greatest(F.lit(1), F.floor(F.lit(DRAWS) / F.size("_v"))).cast("int")
    take = lambda name: F.transform("_v", lambda x: x[name])
    rows = groups.select(*by, F.concat_ws(":", *by).alias("_key"), take("value").cast("array<double>").alias("_values"), take("pred").alias("_votes"), step.alias("_step"))
    # a small table makes many draws: its groups are dealt out to all cores
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism).withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), "_step")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(c) for c in by]
            for i, (key, step, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_key", "_step", "_from")))):
                values, votes = batch.column("_values")[i].values, batch.column("_votes")[i].values
                known = np.asarray(values.is_valid())
                codes = votes.dictionary_encode().indices
                codes = np.asarray(codes.fill_null(votes.null_count and len(votes))).astype(np.int64)
                codes = np.unique(codes, return_inverse=True)[1]
                x = np.asarray(values.fill_null(0.0), np.float64)
                blocks = range(start, min(start + step, resamples))
                for size, *found, there, chosen in ladder_draws(x, known, codes, f"{seed}:{key}", blocks):
                    columns = [pa.array(c, mask=~good) for c, good in zip(found, (there, there, chosen))]
                    same = [pa.repeat(c[i], len(blocks)) for c in names]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(blocks), size, np.int64)), *columns], names=[*by, "size", "best", "worst", "maj"])

    kinds = dict(groups.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "size long, best double, worst double, maj double"]))


def validation_metrics(df: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(data_source, var_name, metric, value): mean@N and std@N of each prompt, and for sizes of the
    ladder best, worst and majority by bootstrap; then the mean over prompts."""
    by = ["data_source", "uid", "var_name"]
    groups = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "value", "pred"))).alias("_v"))
    n = F.size("_v")
    values = F.transform("_v", lambda x: x["value"])
    base = groups.withColumns({"mean": M.array_sum(values) / n})
    base = base.withColumn("std", F.sqrt(M.array_sum(F.transform("_v", lambda x: (x["value"] - F.col("mean")) ** 2)) / n))
    plain = base.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("mean@"), n.cast("string")).alias("m"), F.col("mean").alias("v")),
                F.struct(F.concat(F.lit("std@"), n.cast("string")).alias("m"), F.col("std").alias("v"))
            )
        ).alias("x")
    ).select(*by, "x.m", "x.v")
    made = resampled(groups.where(n > 1), by, resamples, seed).groupBy(*by, "size").agg(
        *[f(c).alias(f"{c}_{k}") for c in ("best", "worst", "maj") for k, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )
    boot = made.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.concat(F.lit(f"{c}@"), F.col("size").cast("string"), F.lit(f"/{k}")).alias("m"), F.col(f"{c}_{k}").alias("v")
                    ) for c in ("best", "worst", "maj") for k in ("mean", "std")
                ]
            )
        ).alias("x")
    ).select(*by, "x.m", "x.v")
    return plain.union(boot).groupBy("data_source", "var_name", F.col("m").alias("metric")).agg(F.avg("v").alias("value"))


def metric_section(df: DataFrame, core: str = "acc") -> DataFrame:
    """val-core for the core variable (reward without it) at the largest n and mean@, best@, maj@; else val-aux."""
    w = W.partitionBy("data_source")
    core_var = F.when(F.max(F.col("var_name") == core).over(w), core).otherwise("reward")
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    is_core = (F.col("var_name") == core_var) & F.col("metric").rlike("^(mean|best|maj)@") & ~F.contains(F.col("metric"), F.lit("std")) & (
        n == F.max(n).over(W.partitionBy("data_source", "var_name"))
    )
    return df.withColumn("name", F.concat_ws("/", F.when(is_core, "val-core").otherwise("val-aux"), "data_source", "var_name", "metric"))


def offline_eval(df: DataFrame, score: Column) -> DataFrame:
    """Mean score of a row's responses, then the mean over rows of a source."""
    rows = df.select(
        "row_id", "data_source", F.explode("responses").alias("response"), "ground_truth"
    ).groupBy("row_id", "data_source").agg(F.avg(score).alias("s"))
    return rows.groupBy("data_source").agg(F.avg("s").alias("score"))


def summary(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Count, mean, interpolated p50 and p95, and maximum; zeros for nothing."""
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count(column).alias("n"), z(F.avg(column)).alias("mean"), z(F.percentile(column, 0.5)).alias("p50"),
        z(F.percentile(column, 0.95)).alias("p95"), z(F.max(column)).alias("max")
    )


def shape_check(df: DataFrame) -> DataFrame:
    """Rows for each count of rows by uid."""
    return df.groupBy("uid").agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("prompts"))


def debug_probabilities(df: DataFrame) -> DataFrame:
    """Gap between two policies' probabilities over masked tokens: max, mean, deviation, correlation."""
    t = df.select(
        F.explode(F.arrays_zip("old_log_probs", "rollout_log_probs", "response_mask")).alias("x")
    ).where("x.response_mask = 1").select(F.exp("x.old_log_probs").alias("a"), F.exp("x.rollout_log_probs").alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return t.agg(F.max(d).alias("max"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.corr("a", "b").alias("pearson"))


def kl_coefficient(beta: float, kl: float, target: float, steps: int, horizon: int) -> float:
    """The adaptive controller's next coefficient."""
    return beta * (1 + max(-0.2, min(0.2, kl / target - 1)) * steps / horizon)


def kl_controller(kind: str, coefficient: float, target: float = 6.0, horizon: int = 10_000):
    """The coefficient at each step, as a function of a table of steps (``step``, ``kl``, ``n_steps``): it adds
    ``coefficient``, as it is after the step.  A fixed one stays; an adaptive one grows by what the KL is
    above its target, a fifth at most.  Steps run up in ranges, so a long history is no single task."""
    if kind == "fixed":
        return lambda df: df.withColumn("coefficient", F.lit(float(coefficient)))
    if kind != "adaptive":
        raise ValueError(f"unknown controller {kind!r}")
    if horizon <= 0:
        raise ValueError("the horizon must be above 0")

    def run(df: DataFrame) -> DataFrame:
        from quillstream.operators.frame import running_sum

        error = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("kl") / target - 1))
        x = running_sum(df.withColumn("_log", F.log(1 + error * F.col("n_steps") / horizon)), "_log", "step", "_sum")
        return x.withColumn("coefficient", coefficient * F.exp("_sum")).drop("_log", "_sum")

    return run


def staleness_stats(df: DataFrame, version: int) -> DataFrame:
    """Of produced rows (param_version, seconds): how many are stale, span of versions, percentiles."""
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.lit(version) - F.col("param_version") >= 1).alias("stale"),
        (F.max("param_version") - F.min("param_version")).alias("span"), F.count_distinct("param_version").alias("versions"),
        *[F.percentile("seconds", p).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)]
    )


def token_differences(a: Column, b: Column, mask: Column) -> Column:
    """How many masked places differ."""
    return F.size(F.filter(M.zip3(a, b, mask, lambda x, y, m: (x != y) & (m == 1)), lambda d: d)).cast("long")


def pearson(df: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """Correlation of two token arrays over the mask, and the largest gap of their probabilities."""
    t = df.select(F.explode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"), F.col(mask).alias("m"))).alias("x")).where("x.m = 1")
    return t.agg(F.corr("x.a", "x.b").alias("pearson"), F.max(F.abs(F.exp("x.a") - F.exp("x.b"))).alias("most"))


def throughput(df: DataFrame, tokens: str, seconds: float, devices: int) -> DataFrame:
    n = F.sum(tokens)
    return df.agg(n.alias("total_num_tokens"), F.lit(seconds).alias("time_per_step"), (n / (seconds * devices)).alias("throughput"))


def assembly_stats(df: DataFrame, seconds: str, first: str, last: str, by: list[str] = ()) -> DataFrame:
    """Of the samples of a batch: times and their percentiles, how many span versions, and how many
    versions there are."""
    span = F.abs(F.col(last) - F.col(first))
    partial = F.count_if(span > 0)
    times = [
        F.avg(seconds).alias("avg"), F.max(seconds).alias("max"), F.min(seconds).alias("min"),
        *[F.percentile(seconds, p / 100).alias(f"tp{p}") for p in (50, 95, 99)]
    ]
    return df.groupBy(*by).agg(
        *times, partial.alias("partial"), (partial / F.count("*")).alias("partial_ratio"), F.max(span).alias("max_span"),
        F.count_distinct(last).alias("versions")
    )


def row_issues(df: DataFrame, key: str, required: list[str], group: str, size: int) -> DataFrame:
    """(issue, n): repeated keys, missing fields, and groups that have not ``size`` rows."""
    repeated = df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated").alias("issue"), "n")
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    missing = missing.select(
        F.explode(F.array(*[F.struct(F.lit(f"missing {c}").alias("issue"), F.col(c).alias("n")) for c in required])).alias("x")
    ).select("x.*")
    uneven = df.groupBy(group).count().where(F.col("count") != size).agg(F.count("*").alias("n")).select(F.lit("group size").alias("issue"), "n")
    return repeated.union(missing).union(uneven)


def group_numbers(df: DataFrame, key: str, out: str = "group") -> DataFrame:
    """Number groups: integers, near-integers and digit strings by their value if all labels are
    such, else labels by their place in order.  Distinct labels are counted in ranges of a hash of
    them only where they are not numbers; there is one row for each label."""
    number = F.col(key).try_cast("double")
    whole = number.isNotNull() & (F.abs(number - F.round(number)) <= 1e-6)
    if df.agg(F.bool_and(F.coalesce(whole, F.lit(False)))).first()[0]:
        return df.withColumn(out, F.round(number).cast("long"))
    labels = df.select(F.col(key).alias("_label")).distinct()
    labels = labels.withColumn(out, (F.row_number().over(W.orderBy("_label")) - 1).cast("long"))
    return df.join(labels, F.col(key).eqNullSafe(F.col("_label"))).drop("_label")


def gathered(df: DataFrame, by: str, name: str, value: str, order: str) -> DataFrame:
    """(by, name, values): what was appended to each metric, in order."""
    return df.groupBy(by, name).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def without_padding(df: DataFrame, flag: str = "is_padding") -> DataFrame:
    """Step metrics are taken over rows that are no padding."""
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))
