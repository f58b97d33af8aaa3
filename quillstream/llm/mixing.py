"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

A source's words are cut into equal blocks.  The mix's words go to sources, a source's blocks to
groups of its shards, and a group's blocks to its shards, by highest quotients weight / (2k + 1);
as a source of n shards has about sqrt(n) groups, no task ranks all shards of a large source.  Shards and the length of a block follow
the source's own words, so that blocks that are not full weigh little.  Within a shard a seeded permutation of its
blocks says which are taken once more than the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.core import WORD_RE, hot_join, staged, table, unused, with_before

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2.0, 17
SHARD_WORDS, MAX_BLOCK, MIN_BLOCKS = 100_000, 32, 512
#: Sources told to all tasks, and dealt out by one, at most.
TOLD_SOURCES = 50_000
#: A prime above any block count of a shard: a multiple of it, modulo n, visits all n blocks.
STEP = 2_654_435_761


def sainte_lague(df: DataFrame, group: list[str], key: str, weight: str, seats: str, out: str) -> DataFrame:
    """Add ``out``: the seats of each ``key``, ``seats`` a group being dealt out by ``weight``.

    A key's seats differ from its quota q by at most 1/2 + q * keys / (2 * seats), so quotients
    are listed only in that range: some three rows a key, whatever the seats are.  Of equal
    quotients the smaller key comes first.  Weights of 0 get none.
    """
    g = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    q = F.col(weight) * F.col(seats) / F.col("_sum")
    slack = q * F.col("_keys") / (2 * F.greatest(F.col(seats), F.lit(1))) + 0.5
    df = df.withColumns({"_sum": F.sum(weight).over(g), "_keys": F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(g)})
    df = df.withColumn("_ok", (F.col(weight) > 0) & (F.col(seats) > 0))
    df = df.withColumn("_low", F.when(F.col("_ok"), F.greatest(F.lit(0), F.floor(q - slack))).otherwise(0).cast("long"))
    df = df.withColumn("_high", F.when(F.col("_ok"), F.ceil(q + slack)).otherwise(0).cast("long"))
    df = df.withColumn("_rest", F.col(seats) - F.sum("_low").over(g))
    ks = F.when(F.col("_ok"), F.sequence(F.col("_low"), F.col("_high"))).otherwise(F.array())
    quotients = df.where("_ok").select(*group, key, "_rest", F.explode(ks).alias("_k"), weight)
    order = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    quotients = quotients.withColumn("_rank", F.row_number().over(order.orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), F.col(key).asc_nulls_last(), "_k")))
    won = quotients.where("_rank <= _rest").groupBy(*group, key).agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(c).alias(f"_{c}") for c in [*group, key]], "_won")
    same = F.lit(True)
    for c in [*group, key]:
        same = same & df[c].eqNullSafe(won[f"_{c}"])
    names = [c for c in df.columns if c not in ("_sum", "_keys", "_ok", "_low", "_high", "_rest")]
    return df.join(won, same, "left").select(*names, (F.col("_low") + F.coalesce(F.col("_won"), F.lit(0))).alias(out))


def source_targets(sizes: DataFrame, n: int | None = None) -> DataFrame:
    """source, source_size, target, from one row for each source and its size.

    Sources by code point, null last, weigh 3, 1, 2, and so on; the mix has 150 % of all words;
    a target stops at twice its source's size and what is above is shared again by weight.
    Sources may be as many as they like: their ranks and running sums come by ranges.
    """
    n = sizes.count() if n is None else n
    by_name = F.col("source").asc_nulls_last()
    s = with_before(sizes.withColumn("_one", F.lit(1)), [by_name], n, _rank="_one").drop("_one")
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", w.cast("double")).withColumn("_cap", CAP * F.col("source_size")).drop("_rank")
    words, weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    s = with_before(s, [F.col("_cap") / F.col("weight"), by_name], n, _caps="_cap", _weights="weight")
    # the level if this and all later sources stay below their caps; it falls after the first for
    # which that holds, so the highest such level is the one
    level = (F.lit(SHARE * words) - F.col("_caps")) / (F.lit(weights) - F.col("_weights"))
    share = s.agg(F.max(F.when(F.col("_cap") / F.col("weight") > level, level))).first()[0]
    share = F.lit(float("inf") if share is None else share)
    target = F.when(F.col("_cap") <= share * F.col("weight"), F.col("_cap")).otherwise(share * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def source_seats(targets: DataFrame, n: int) -> DataFrame:
    """Add ``seats``: the mix's words dealt out to groups of sources, and a group's to its sources."""
    all_seats = targets.agg(F.round(F.coalesce(F.sum("target"), F.lit(0.0))).cast("long")).first()[0]
    targets = staged(targets.withColumn("_in", F.pmod(F.xxhash64(F.lit(SEED), "source"), F.lit(1 + n // TOLD_SOURCES))), "targets")
    groups = targets.groupBy("_in").agg(F.sum("target").alias("_of_group")).withColumn("_seats", F.lit(all_seats))
    groups = sainte_lague(groups, [], "_in", "_of_group", "_seats", "_mine").select(F.col("_in").alias("_g"), "_mine")
    targets = targets.join(F.broadcast(groups), F.col("_in") == F.col("_g")).drop("_g")
    return sainte_lague(targets, ["_in"], "source", "target", "_mine", "seats").drop("_in", "_mine")


def told(rows: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """``rows`` with the facts of their source, one row for each of ``n`` sources.  Up to
    TOLD_SOURCES of them are told to all tasks, more meet by a shuffle."""
    facts = facts.withColumnRenamed("source", "_s")
    facts = F.broadcast(facts) if n <= TOLD_SOURCES else facts
    return rows.join(facts, rows["source"].eqNullSafe(facts["_s"])).drop("_s")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row.

    ``taken`` is how many words the mix takes of the row, repeats counted; of a source it sums
    to its target but for a block in each shard at most, and of a row it is at most 2 * size.
    Null and empty texts have size 0 and give nothing; null is a source of its own, the last;
    repeated rows are dealt with one by one; an empty table stays empty.  Rows of one id lie in
    shards by their texts, so that one id may have many rows.
    """
    size = F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(F.col(text), F.lit(WORD_RE)))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.cast("long").alias("size"), F.xxhash64(text).alias("_h"))
    rows = staged(rows, "sizes")
    sources = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), "sources")
    n, n_rows = sources.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    shards = F.floor(F.col("source_size") / SHARD_WORDS) + 1
    block = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(F.least("source_size", "target") / MIN_BLOCKS))).cast("long")
    targets = source_seats(source_targets(sources.drop("_rows"), n), n).withColumn("_block", block)
    t = staged(targets.withColumn("blocks", F.round(F.col("seats") / F.col("_block")).cast("long")).drop("seats"), "seats")
    cuts = t.join(sources.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "_rows", shards.alias("_shards"), "_block")
    if n <= TOLD_SOURCES:
        rows = told(rows, cuts.drop("_rows"), n)
    else:  # a source with very many rows is told, the others meet by a shuffle
        name = lambda x: x.withColumn("_name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        rows = hot_join(name(rows), name(cuts).drop("source"), "_name", "_rows", n_rows).drop("_name", "_rows")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_h"), F.col("_shards")))
    group = F.pmod("shard", F.ceil(F.sqrt(F.first("_shards")))).alias("grp")
    parts = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("_block").alias("_block"), group)
    rows = rows.drop("_shards")
    groups = told(parts.groupBy("source", "grp").agg(F.sum("words").alias("words")), t.select("source", "blocks"), n)
    groups = sainte_lague(groups, ["source"], "grp", "words", "blocks", "blocks_of")
    g = groups.select(F.col("source").alias("_s"), F.col("grp").alias("_g"), "blocks_of")
    parts = parts.join(g, parts["source"].eqNullSafe(g["_s"]) & (parts["grp"] == g["_g"])).drop("_s", "_g")
    parts = sainte_lague(parts, ["source", "grp"], "shard", "words", "blocks_of", "quota")
    parts = told(parts, t.drop("blocks", "_block"), n)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / F.col("_block"))).cast("long")
    parts = parts.withColumn("_n", blocks).withColumn("quota", F.least(F.col("quota"), (CAP * F.col("_n")).cast("long")))
    p = parts.select(F.col("source").alias("_s"), F.col("shard").alias("_p"), "source_size", "target", "_n", "quota")
    stream = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "_h"), "doc_id", "_h", "size")
    rows = rows.withColumn("_end", F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.join(p, rows["source"].eqNullSafe(p["_s"]) & (rows["shard"] == p["_p"]))
    start = F.col("_end") - F.col("size")
    offset = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("_n"))
    block = F.col("_block")
    first, last = F.floor(start / block).cast("long"), F.floor((F.col("_end") - 1) / block).cast("long")

    def of_block(i):
        place = F.pmod(i * F.pmod(F.lit(STEP), F.col("_n")) + offset, F.col("_n"))
        times = F.floor(F.col("quota") / F.col("_n")).cast("long") + F.when(place < F.col("quota") % F.col("_n"), F.lit(1)).otherwise(0)
        return times * (F.least(F.col("_end"), (i + 1) * block) - F.greatest(start, i * block))

    taken = F.when(F.col("size") > 0, F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda a, i: a + of_block(i))).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op3_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source")


def stage_mixing(spark, docs, sf_dir):
    """Pipeline stage: each row as often as the mix takes it whole; of what is left over, a
    seeded draw with that chance takes the row once more, so a source's words keep near its
    target.  Rows without words, of which a mix has nothing to take, stay once.

    A row counts by its id and text, so rows without an id, or that share one, are told apart;
    rows that repeat both come equally often, each by its part; an empty table stays empty; other
    columns, whatever their names, are kept.
    """
    names = docs.columns
    key, size, part, times = unused(docs, "key", "size", "part", "times")
    x = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    taken = mix(x, key=key).groupBy("doc_id").agg(F.max("size").alias(size), (F.sum("taken") / F.count("*")).alias(part)).withColumnRenamed("doc_id", f"{key}_of")
    draw = F.pmod(F.xxhash64(F.lit(SEED + 3), key), F.lit(1_000_000)) / 1e6
    n = F.when(F.col(size) == 0, 1).otherwise(F.floor(F.col(part) / F.col(size) + draw)).cast("int")
    out = x.join(taken, x[key] == taken[f"{key}_of"]).withColumn(times, n)
    return out.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)
