"""Sinks: rollouts by step, canonical JSON lines, metrics, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.frame import with_range


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with its fields in the order of names; NaN is null."""
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in sorted(df.dtypes)]
    return F.to_json(F.struct(*clean), {"ignoreNullFields": "false"})


def write_canonical(df: DataFrame, path: str, order: str) -> str:
    """JSON lines in order, and a digest of the digests of ranges of rows, in order: each range is
    hashed where it lies, so the file is never gathered in one task."""
    lines = df.select(F.col(order).alias("_o"), canonical_json(df).alias("value"))
    lines.orderBy("_o").select("value").write.mode("overwrite").text(path)
    parts = with_range(lines, "_o").withColumnRenamed("_range", "_r").groupBy("_r").agg(
        F.sha2(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "value"))), lambda x: x["value"]), "\n").cast("binary"), 256
        ).alias("h")
    )
    return parts.agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "h"))), lambda x: x["h"]), "").cast("binary"), 256)
    ).first()[0]


def dump_rollouts(df: DataFrame, path: str, step: int) -> None:
    """Append a step's rows (input, output, gts, score and more) under step=N."""
    df.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").json(path)


def dump_or_replay(spark: SparkSession, path: str, step: int, make) -> DataFrame:
    """A recorded step if there is one, else ``make()``, recorded."""
    at = f"{path}/step={step}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def gather_responses(df: DataFrame, key: str = "row_id") -> DataFrame:
    """responses: array<string> of each prompt, by sample."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "response"))), lambda x: x["response"]).alias("responses"))


def console_line(metrics: Column, step: Column) -> Column:
    """``step:N - name:value - ...`` of a map of metrics."""
    pairs = F.transform(F.sort_array(F.map_entries(metrics)), lambda e: F.concat_ws(":", e["key"], F.round(e["value"], 3).cast("string")))
    return F.concat_ws(" - ", F.concat(F.lit("step:"), step.cast("string")), F.array_join(pairs, " - "))


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def flatten_params(params: dict, prefix: str = "") -> dict[str, object]:
    """Nested settings as a/b/c keys."""
    out: dict[str, object] = {}
    for k, v in params.items():
        name = f"{prefix}/{k}" if prefix else str(k)
        out |= flatten_params(v, name) if isinstance(v, dict) else {
            name: v if isinstance(v, (int, float, str, bool)) or v is None else json.dumps(v, default=str)
        }
    return out


SINKS = {"console": lambda df, _: df.show(truncate=False), "file": append_metrics}


def log_batch(backends: list[str], path: str):
    """A foreachBatch function that writes to each named backend."""
    chosen = [SINKS[b] for b in backends]

    def run(df: DataFrame, epoch: int) -> None:
        for sink in chosen:
            sink(df.withColumn("epoch", F.lit(epoch)), path)

    return run


def makespan(df: DataFrame, by: str = "endpoint") -> DataFrame:
    """Last end less first start of each endpoint, and its requests."""
    return df.groupBy(by).agg((F.max("end") - F.min("start")).alias("seconds"), F.count("*").alias("requests"))


def write_report(spark: SparkSession, paths: list[str], columns: list[str], out: str) -> str:
    """Several metrics files (one JSON object each) as JSON and CSV tables, and as markdown text,
    which is returned: a row for each run, in the order of the first column.  Runs are few."""
    rows = spark.read.option("multiLine", "true").json(paths)
    table = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).orderBy(columns[0])
    table.coalesce(1).write.mode("overwrite").json(f"{out}/json")
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{out}/csv")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in table.collect()]
    return "\n".join(lines) + "\n"
