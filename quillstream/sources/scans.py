"""Scans of datasets, caches and manifests into typed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream import schemas
from quillstream.operators.metrics import md5_draw


def scan(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, JSON or JSONL files as one table; other suffixes are an error, missing columns null."""
    if not paths:
        raise ValueError("no paths")
    parts = []
    for path in paths:
        plain = path.rstrip("/").removesuffix("/*")
        reader = spark.read.schema(schema) if schema else spark.read
        if plain.endswith(".parquet"):
            parts.append(reader.parquet(path))
        elif plain.endswith((".json", ".jsonl")):
            parts.append(reader.option("mode", "FAILFAST").json(path))
        else:
            raise ValueError(f"unknown kind of file: {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def require(df: DataFrame, *names: str) -> DataFrame:
    if missing := set(names) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df


def scan_preferences(spark: SparkSession, *paths: str) -> DataFrame:
    return require(scan(spark, *paths), "prompt", "chosen", "rejected").select("prompt", "chosen", "rejected")


def scan_sft(spark: SparkSession, *paths: str) -> DataFrame:
    """messages, tools, enable_thinking; the last two are null where a file has none."""
    df = require(scan(spark, *paths), "messages")
    for name, kind in (("tools", "array<string>"), ("enable_thinking", "boolean")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.select("messages", "tools", "enable_thinking")


def train_val_split(df: DataFrame, key: str, val_size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, val): a seeded order by key decides; the first ``val_size`` rows are val."""
    h = md5_draw(F.lit(str(seed)), F.col(key).cast("string"))
    edge = df.select(h.alias("h"), key).orderBy("h", key).limit(val_size).agg(F.max(F.struct("h", key)).alias("e")).first()["e"] if val_size else None
    if edge is None:
        return df, df.limit(0)
    inside = (h < edge["h"]) | ((h == edge["h"]) & (F.col(key) <= edge[key]))
    return df.where(~inside), df.where(inside)


def scan_anchor_cache(spark: SparkSession, path: str) -> DataFrame:
    """ANCHOR_ITEM rows of a JSON document {"metadata": ..., "items": {index: item}}."""
    item = T.StructType([f for f in schemas.ANCHOR_ITEM.fields if f.name != "index"])
    kind = T.StructType(
        [T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("items", T.MapType(T.StringType(), item))]
    )
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", kind, {"allowNonNumericNumbers": "true"}).alias("d"))
    return doc.select(F.explode("d.items").alias("k", "x")).select(F.col("k").cast("long").alias("index"), "x.*")


def cache_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "metadata map<string,string>").alias("d")).first()
    return (doc["d"]["metadata"] if doc and doc["d"] else None) or {}


def check_metadata(found: dict[str, str], wanted: dict[str, str]) -> None:
    if bad := {k: (found.get(k), v) for k, v in wanted.items() if found.get(k) != str(v)}:
        raise ValueError(f"metadata differs: {bad}")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Indices of {"indices": [...]} or a bare list; none at all is an error."""
    text = spark.read.text(path, wholetext=True)
    ids = F.coalesce(F.from_json("value", "array<long>"), F.from_json("value", "indices array<long>")["indices"])
    out = text.select(F.explode(ids).alias("index"))
    if out.isEmpty():
        raise ValueError(f"no indices in {path}")
    return out


def drop_overlong(df: DataFrame, length: Column, limit: int) -> DataFrame:
    """Rows within the limit; a length that can't be had counts as too long."""
    return df.where(F.coalesce(length, F.lit(limit + 1)) <= limit)


def numbered(df: DataFrame, by: str, order: str, out: str = "nth") -> DataFrame:
    """0-based count of a row among those of its key."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(by).orderBy(order)) - 1)


def find_credentials(spark: SparkSession, path: str) -> DataFrame:
    """Text files with token-like strings: (path)."""
    pattern = r"(?:hf_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), "value"
    ).where(F.col("value").rlike(pattern)).select("path")
