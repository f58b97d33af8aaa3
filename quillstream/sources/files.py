"""Files beside tables: fingerprints, publication lists, steps on disk, growing sample tables."""

from __future__ import annotations

import hashlib
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names that never leave (fixed values).
SENSITIVE = r"(?i)(^|/)(\.env|\.netrc|\.git-credentials|id_rsa|id_ed25519|credentials|token)(\.[^/]*)?$|\.(pem|key)$"


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file; a file is hashed where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def same_tree(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two folders hold the same files, by name, size and content."""
    left, right = (fingerprints(spark, p).select(F.regexp_replace("path", r"^.*/", "").alias("name"), "length", "sha256") for p in (a, b))
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def publication(entries: list[tuple[str, str]], there: set[str]) -> list[tuple[str, str]]:
    """The allowed (local, remote) list: every local file is there and no remote name comes twice."""
    if missing := sorted({a for a, _ in entries} - there):
        raise FileNotFoundError(f"missing: {missing}")
    names = [posixpath.normpath(b) for _, b in entries]
    if repeated := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"published twice: {repeated}")
    return entries


def in_scope(path: Column, prefix: str) -> Column:
    """Below the prefix, without a way out of it, and not sensitive by its name."""
    return F.startswith(path, F.lit(prefix.rstrip("/") + "/")) & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.rlike(SENSITIVE)


def scope_report(files: DataFrame, path: str, category: str, prefix: str, expected: dict[str, int]) -> DataFrame:
    """(category, files, rejected, complete): a category is complete with exactly as many files as
    expected, none of them out of scope."""
    ok = in_scope(F.col(path), prefix)
    wanted = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))])
    found = files.groupBy(category).agg(F.count("*").alias("files"), F.count_if(~ok).alias("rejected"))
    return found.withColumn("complete", F.coalesce((wanted[F.col(category)] == F.col("files")) & (F.col("rejected") == 0), F.lit(False)))


def cached_name(path: str) -> str:
    """A local name for a remote path: its digest and its last part."""
    return f"{hashlib.md5(path.encode()).hexdigest()}/{posixpath.basename(path.rstrip('/'))}"


def _listed(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def last_step(spark: SparkSession, path: str, most: int | None = None) -> int | None:
    """The highest step=N below a path (up to ``most``): where a run goes on."""
    steps = [int(m[1]) for n in _listed(spark, path) if (m := re.fullmatch(r"(?:step=|global_step_)(\d+)", n))]
    return max((s for s in steps if most is None or s <= most), default=None)


def append_samples(df: DataFrame, path: str, step: int, n: int, seed: int = 0) -> None:
    """Add ``n`` seeded rows of a validation, with their step, to a table that grows."""
    from quillstream.operators.frame import sample_rows

    sample_rows(df, n, seed).withColumn("step", F.lit(step)).write.mode("append").parquet(path)


def append_line(df: DataFrame, path: str, step: int) -> None:
    """{"step": N, "data": {...}} of a row of metrics, appended as JSON."""
    df.select(F.lit(step).alias("step"), F.struct(*df.columns).alias("data")).write.mode("append").json(path)


def write_whole(df: DataFrame, path: str) -> None:
    """JSON that is there as a whole or not at all: the committer renames when all tasks are done."""
    df.write.mode("overwrite").json(path)
