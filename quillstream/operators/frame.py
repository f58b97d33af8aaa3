"""Batch-table verbs.  A table carries its order in ``row_id``; positions come from it.

Positions and running sums over a whole table are made in two steps (within ranges of row_id, then
over the totals of earlier ranges), so no single task orders the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.operators.metrics import md5_draw

#: Rows of a range, about; ranges at most.
RANGE_ROWS, RANGES = 1 << 16, 100_000


def with_range(df: DataFrame, order: str) -> DataFrame:
    """Add ``_range``: numbers for spans of the key, equally wide, as many as the rows ask for.
    How wide they are follows from the least and largest key, so that sparse keys share ranges."""
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    ranges = min(RANGES, 1 + n // RANGE_ROWS)
    if low is None or low == high:
        return df.withColumn("_range", F.lit(0).cast("long"))
    step = (float(high) - float(low)) / ranges
    return df.withColumn(
        "_range", F.coalesce(F.least(F.floor((F.col(order).cast("double") - float(low)) / step), F.lit(ranges - 1)), F.lit(-1)).cast("long")
    )


def _ahead(df: DataFrame, total: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, _range, _before): the total over earlier ranges; there is one row for each range."""
    sums = df.groupBy(*by, "_range").agg(total.alias("_t"))
    return sums.select(*by, "_range", (F.sum("_t").over(W.partitionBy(*by).orderBy("_range")) - F.col("_t")).alias("_before"))


def with_position(df: DataFrame, order: str = "row_id", out: str = "rn", ties: Sequence[str] = ()) -> DataFrame:
    """Add ``out``, the 0-based position by a numeric ``order`` and, of equals, by ``ties``."""
    x = with_range(df, order)
    x = x.withColumn("_in", F.row_number().over(W.partitionBy("_range").orderBy(order, *ties)) - 1)
    return x.join(_ahead(x, F.count("*")), "_range").withColumn(out, (F.col("_in") + F.col("_before")).cast("long")).drop("_range", "_in", "_before")


def running_sum(df: DataFrame, value: str, order: str = "row_id", out: str = "running") -> DataFrame:
    """Add ``out``, the sum of ``value`` over all rows up to and with this one."""
    x = with_range(df, order)
    x = x.withColumn("_in", F.sum(value).over(W.partitionBy("_range").orderBy(order)))
    return x.join(_ahead(x, F.sum(value)), "_range").withColumn(out, F.col("_in") + F.col("_before")).drop("_range", "_in", "_before")


def shuffled(df: DataFrame, draw: Column, ties: Sequence[str], by: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """Add ``out``, the 0-based position by a uniform 32-bit draw, within ``by``: ranges of the draw
    are equally full."""
    ranges = min(RANGES, 1 + df.count() // RANGE_ROWS)
    x = df.withColumn("_draw", draw).withColumn("_range", F.floor(F.col("_draw") * ranges / float(1 << 32)))
    x = x.withColumn("_in", F.row_number().over(W.partitionBy(*by, "_range").orderBy("_draw", *ties)) - 1)
    return x.join(_ahead(x, F.count("*"), by), [*by, "_range"]).withColumn(
        out, (F.col("_in") + F.col("_before")).cast("long")
    ).drop("_draw", "_range", "_in", "_before")


def pop(df: DataFrame, names: Sequence[str], key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(the rest, the popped columns with the key); a missing column is an error."""
    if missing := set(names) - set(df.columns):
        raise KeyError(f"no such columns: {sorted(missing)}")
    return df.drop(*names), df.select(key, *names)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def slice_rows(df: DataFrame, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    rn = F.col("rn")
    keep = (rn >= start) & ((rn - start) % step == 0)
    if end is not None:
        keep = keep & (rn < end)
    return with_position(df).where(keep).drop("rn")


def take(df: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows by ``positions`` (pos, rn): may repeat and reorder; ``pos`` is the new order."""
    return with_position(df).join(positions, "rn").drop("rn")


def repeat(df: DataFrame, n: int, interleave: bool = True) -> DataFrame:
    """Each row ``n`` times, with ``k`` and the new order ``pos``: aabb, or abab."""
    out = with_position(df).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return out.withColumn("pos", F.col("rn") * n + F.col("k")).drop("rn")
    total = df.count()
    return out.withColumn("pos", F.col("k") * total + F.col("rn")).drop("rn")


def repeat_each(df: DataFrame, times: str) -> DataFrame:
    return df.withColumn(
        "k", F.explode(F.when(F.col(times) > 0, F.sequence(F.lit(0), (F.col(times) - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    )


def unfold(df: DataFrame, column: str, n: int) -> DataFrame:
    """A column of width W becomes n rows of width W / n; the others repeat."""
    w = (F.size(column) / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(F.col(column), i * w + 1, w))
    names = [c for c in df.columns if c != column]
    return df.select(*names, F.posexplode(parts).alias("k", column))


def fold(df: DataFrame, k: int, columns: Sequence[str]) -> DataFrame:
    """k consecutive rows become one, their values arrays."""
    at = with_position(df).withColumn("batch", F.floor(F.col("rn") / k))
    rows = F.sort_array(F.collect_list(F.struct("rn", *columns)))
    return at.groupBy("batch").agg(rows.alias("_r")).select("batch", *[F.transform("_r", lambda x: x[c]).alias(c) for c in columns])


def chunk(df: DataFrame, k: int) -> DataFrame:
    """Add ``chunk``: k parts of ceil(N / k) rows, the last ones shorter."""
    n = df.count()
    return with_position(df).withColumn("chunk", F.floor(F.col("rn") / max(1, -(-n // k))).cast("long")).drop("rn")


def split(df: DataFrame, size: int) -> DataFrame:
    return with_position(df).withColumn("part", F.floor(F.col("rn") / size).cast("long")).drop("rn")


def split_equal(df: DataFrame, k: int) -> DataFrame:
    """k equal parts; what is left over at the end goes."""
    size = df.count() // k
    return with_position(df).where(F.col("rn") < size * k).withColumn("part", F.floor(F.col("rn") / max(1, size)).cast("long")).drop("rn")


def pad_to_divisor(df: DataFrame, k: int) -> DataFrame:
    """Leading rows again, in a cycle, until k divides the count; with ``rn`` and ``is_padding``."""
    at = with_position(df)
    n = df.count()
    pad = -n % k
    at = at.withColumn("is_padding", F.lit(False))
    if not pad:
        return at
    cycles = F.filter(F.transform(F.sequence(F.lit(0), F.lit((pad - 1) // n)), lambda c: c * n + F.col("rn")), lambda p: p < pad)
    extra = at.where(F.col("rn") < pad).withColumn("_p", F.explode(cycles)).withColumn("rn", F.col("_p") + n).drop("_p").withColumn("is_padding", F.lit(True))
    return at.unionByName(extra)


def pad_with(df: DataFrame, n: int, last: bool = False) -> DataFrame:
    """The first, or last, row ``n`` more times; with ``rn`` and ``is_padding``."""
    at = with_position(df).withColumn("is_padding", F.lit(False))
    total = df.count()
    one = at.where(F.col("rn") == (total - 1 if last else 0))
    extra = one.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n else one.limit(0).withColumn("_k", F.lit(0))
    return at.unionByName(extra.withColumn("rn", F.col("_k") + total - 1).withColumn("is_padding", F.lit(True)).drop("_k"))


def pad_minimal(df: DataFrame, k: int, minimal: dict[str, Column], uid: str = "uid") -> DataFrame:
    """Rows that do nothing, until k divides the count: columns as in ``minimal``, others null, each
    with a uid of its own, and ``is_padding``."""
    n = -df.count() % k
    extra = df.sparkSession.range(n).withColumn("_u", F.concat(F.lit("padding-"), F.col("id").cast("string")))
    kinds = dict(df.dtypes)
    values = {uid: F.col("_u"), **minimal}
    row = [values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in df.columns]
    return df.withColumn("is_padding", F.lit(False)).unionByName(extra.select(*row).withColumn("is_padding", F.lit(True)))


def block_sums(df: DataFrame, value: str, k: int) -> DataFrame:
    """(block, total): sums of k consecutive rows."""
    return with_position(df).groupBy(F.floor(F.col("rn") / k).alias("block")).agg(F.sum(value).alias("total"))


def restored(df: DataFrame, place: str, columns: Sequence[str]) -> DataFrame:
    """Rows that were put in another order, with ``original``, where each stood: the inverse of
    ``place`` by a join, not by a global sort."""
    return df.select(F.col("row_id"), F.col(place).alias("original"), *columns)


def merged_maps(a: Column, b: Column) -> Column:
    """Both maps' entries; a shared key must have one value, else the query fails."""
    clash = F.exists(F.map_keys(a), lambda k: F.array_contains(F.map_keys(b), k) & ~a[k].eqNullSafe(b[k]))
    own = F.map_filter(b, lambda k, v: ~F.array_contains(F.map_keys(a), k))
    return F.when(clash, F.raise_error(F.lit("values of a shared key differ")).cast("map<string,long>")).otherwise(F.map_concat(a, own))


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_padding"))


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int = 0) -> DataFrame:
    """(epoch, batch, slot): a seeded order for each epoch, deterministic by (seed, epoch, row_id)."""
    x = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    draw = md5_draw(F.lit(str(seed)), F.col("epoch").cast("string"), F.col("row_id").cast("string"))
    x = shuffled(x, draw, ["row_id"], ["epoch"])
    return x.withColumn("batch", F.floor(F.col("rn") / size)).withColumn("slot", F.col("rn") % size).drop("rn")


def loader(df: DataFrame, size: int, drop_last: bool = True, seed: int | None = None) -> DataFrame:
    """Add ``batch``, by seeded or given order; a short last one goes if ``drop_last``."""
    x = with_position(df) if seed is None else shuffled(df, md5_draw(F.lit(str(seed)), F.col("row_id").cast("string")), ["row_id"])
    x = x.withColumn("batch", F.floor(F.col("rn") / size))
    full = df.count() // size
    return (x.where(F.col("batch") < full) if drop_last else x).drop("rn")


def feed(df: DataFrame, size: int, steps: int, seed: int = 0) -> DataFrame:
    """(step, epoch, batch, slot, row_id) of ``steps`` batches in a row: epochs follow each other,
    each in an order of its own, whole batches only."""
    each = max(1, df.count() // size)
    x = mini_batches(df, size, -(-steps // each), seed).where(F.col("batch") < each)
    x = x.withColumn("step", F.col("epoch") * each + F.col("batch"))
    return x.where(F.col("step") < steps)


def traced(df: DataFrame, key: str, k: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Add ``traced``: the row's sample is one of the k seeded ones (of each ``by``)."""
    ids = df.select(*by, key).distinct().withColumn("_h", md5_draw(F.lit(str(seed)), F.col(key).cast("string")))
    if by:
        chosen = ids.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_h", key))).where(F.col("_r") <= k)
    else:
        chosen = ids.orderBy("_h", key).limit(k)
    chosen = chosen.select(*by, key, F.lit(True).alias("traced"))
    return df.join(chosen, [*by, key], "left").withColumn("traced", F.coalesce("traced", F.lit(False)))


def sample_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """The first n rows, or n seeded ones without replacement."""
    return df.orderBy("row_id").limit(n) if seed is None else df.orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id").limit(n)


def weighted_resample(df: DataFrame, weight: str, n: int, seed: int = 0, method: str = "pow", power: float = 1.0) -> DataFrame:
    """n draws with replacement by weight (floor 1e-8): prefix sums and seeded uniform draws; draws
    meet rows by buckets of the cumulative weight."""
    w = F.col(weight)
    if method == "pow":
        w = F.pow(F.abs(w), F.lit(power))
    elif method == "max_min":
        low, high = df.agg(F.min(weight), F.max(weight)).first()
        w = F.when(w == high, 1.0).when(w == low, 1.0).otherwise(0.0)
    elif method == "max_random":
        high = df.agg(F.max(weight)).first()[0]
        w = F.when(w == high, 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method!r}")
    p = running_sum(df.withColumn("_w", F.greatest(w, F.lit(1e-8))), "_w", out="_to").withColumn("_from", F.col("_to") - F.col("_w"))
    total = p.agg(F.max("_to")).first()[0] or 0.0
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), (md5_draw(F.lit(str(seed)), F.col("id").cast("string")) / float(1 << 32) * total).alias("_u")
    )
    step = total / max(1, n)
    draws = draws.withColumn("_b", F.floor(F.col("_u") / step))
    p = p.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor(F.col("_to") / step))))
    return p.join(draws, "_b").where("_u >= _from AND _u < _to").drop("_w", "_to", "_from", "_b", "_u")


def round_robin(df: DataFrame, shards: int) -> DataFrame:
    return with_position(df).withColumn("shard", F.col("rn") % shards).drop("rn")


def concat(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; the same columns are required."""
    out = parts[0]
    for p in parts[1:]:
        if set(p.columns) != set(out.columns):
            raise ValueError("the parts differ in columns")
        out = out.unionByName(p)
    return out


def union_columns(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Columns of both by key; a shared column must be equal on both sides, else the query fails."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    out = a.join(b.withColumnsRenamed({c: f"_b_{c}" for c in shared}), key)
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        out = out.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs between the batches"))))
    return out.drop(*[f"_b_{c}" for c in shared])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return set(a.columns) == set(b.columns) and a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def _new_runs(df: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``_range`` and ``_new``, 1 where a run begins: a range's first row looks at the last one of the
    range before, of which there is one row each."""
    x = with_range(df, order)
    w = W.partitionBy("_range").orderBy(order)
    ends = x.groupBy("_range").agg(F.max_by(F.struct(F.col(key).alias("k")), order).alias("_end"))
    before = ends.select("_range", F.lag("_end").over(W.orderBy("_range")).alias("_before"))
    x = x.withColumns({"_at": F.row_number().over(w), "_lag": F.lag(key).over(w)}).join(before, "_range")
    same = F.when(F.col("_at") > 1, F.col("_lag").eqNullSafe(F.col(key))).otherwise(F.col("_before").isNotNull() & F.col("_before.k").eqNullSafe(F.col(key)))
    return x.withColumn("_new", F.when(same, 0).otherwise(1)).drop("_at", "_lag", "_before")


def consecutive_runs(df: DataFrame, key: str, by: Sequence[str] = (), order: str = "row_id") -> DataFrame:
    """Add ``run``: a number for each run of consecutive equal keys, within ``by``.  Without ``by`` the
    table is cut into ranges of its order, so that no task orders all of it."""
    if not by:
        x = _new_runs(df, key, order)
        inner = F.sum("_new").over(W.partitionBy("_range").orderBy(order))
        x = x.withColumn("_in", inner).join(_ahead(x, F.sum("_new")), "_range")
        return x.withColumn("run", (F.col("_in") + F.col("_before")).cast("long")).drop("_range", "_new", "_in", "_before")
    w = W.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def trajectory_index(df: DataFrame, key: str, by: Sequence[str] = (), order: str = "row_id") -> DataFrame:
    """Add ``trajectory``: the 0-based place within its run of consecutive equal keys.  Without ``by`` it is
    the way from where the run began, in this range or an earlier one, so that a run may be long."""
    if not by:
        x = with_position(_new_runs(df, key, order).drop("_range"), order, "_rn")
        x = with_range(x.withColumn("_start", F.when(F.col("_new") == 1, F.col("_rn"))), order)
        last = x.groupBy("_range").agg(F.max("_start").alias("_s"))
        before = last.select("_range", F.max("_s").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
        own = F.max("_start").over(W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
        x = x.withColumn("_own", own).join(before, "_range")
        return x.withColumn("trajectory", F.col("_rn") - F.coalesce("_own", "_before")).drop("_range", "_new", "_rn", "_start", "_own", "_before")
    runs = consecutive_runs(df, key, by, order)
    return runs.withColumn("trajectory", F.row_number().over(W.partitionBy(*by, "run").orderBy(order)) - 1).drop("run")
