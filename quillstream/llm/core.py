"""Shared pieces: table scans, staged tables, blocks of texts, and vectorised hashes."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.shipping import ship

#: A word, by the contracts: a run of anything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  A local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return base.rstrip("/")


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a
    lost executor costs a re-read, not a re-computation.  Removed when Python ends."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear_staged() -> None:
    """Remove every staged table of this process (also called at exit)."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch space
            return


#: Bytes of texts that an executor and its Python worker hand over at once in the pipeline, about: for each task
#: both hold a batch, and the executor twice the room for it while it grows.
BATCH_BYTES = 6_000_000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, for what a stage returns is run by its caller.  A smaller bound that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with so many underscores before them that no column begins like them."""
    start = "_"
    while any(c.startswith(start) for c in df.columns):
        start += "_"
    return [start + n for n in names]


def drop_staged_since(n: int, keep: DataFrame) -> None:
    """Remove the tables staged after the first ``n`` of this process, but for what ``keep`` reads."""
    files = keep.inputFiles()
    for at in [x for x in _written[n:] if not any(x[1].split(":", 1)[-1] in f for f in files)]:
        where = at[0].sparkContext._jvm.org.apache.hadoop.fs.Path(at[1])
        where.getFileSystem(at[0].sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(at)


def staged_so_far() -> int:
    return len(_written)


def drop_staged(df: DataFrame) -> None:
    """Remove the staged tables that ``df`` reads, before Python ends."""
    files = df.inputFiles()
    for at in [x for x in _written if any(x[1].split(":", 1)[-1] in f for f in files)]:
        jvm = at[0].sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(at[1])
        where.getFileSystem(at[0].sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(at)


#: A key with more than this part of all rows, and so many at least, is hot: there are fewer hot
#: keys than HOT_PART.
HOT_PART, HOT_ROWS = 2_000, 5_000


def hot_join(rows: DataFrame, answers: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``answers``, which has one row for each ``key`` and, in ``size``, about
    how many rows have it.  Hot keys are told to all tasks, so that none has to take all rows of
    one; the others meet by a shuffle."""
    hot_size = max(HOT_ROWS, total // HOT_PART)
    hot = answers.where(F.col(size) > hot_size)
    if total <= hot_size or hot.isEmpty():
        return rows.join(answers, key, how)
    names = [c for c in answers.columns if c != key]
    hot = F.broadcast(hot.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_hot_{c}") for c in names]))
    told = rows.join(hot, F.col(key) == F.col("_key"), "left")
    met = told.where("_key IS NULL").select(*rows.columns).join(answers.where(F.col(size) <= hot_size), key, how)
    return met.unionByName(told.where("_key IS NOT NULL").select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in names]))


#: Rows put in order by one task, about, and tasks at most.
ORDER_ROWS, ORDER_TASKS = 50_000, 20_000


def with_before(df: DataFrame, order: list, n: int, **values) -> DataFrame:
    """``df`` with, for each name of ``values``, the sum of that column over all rows before in
    ``order``, which must tell all rows apart.  ``n``: about how many rows there are.

    Rows are dealt out by ranges of the order; sums within a range and over earlier ranges make
    the whole, so that no task orders all rows.
    """
    tasks = min(ORDER_TASKS, 1 + n // ORDER_ROWS)
    task, at, before = unused(df, "task", "at", "before")
    x = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    x = staged(x.withColumn(task, F.shiftright(at, 33)), "ordered")  # a row's number holds its task's, and its place there
    ahead = x.groupBy(task).agg(*(F.sum(v).alias(k) for k, v in values.items()))  # at most ORDER_TASKS rows
    earlier = W.orderBy(task).rowsBetween(W.unboundedPreceding, -1)
    ahead = ahead.select(F.col(task).alias(before), *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{before}_{k}") for k in values))
    inner = W.partitionBy(task).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    x = x.join(F.broadcast(ahead), F.col(task) == F.col(before))
    return x.withColumns({k: F.coalesce(F.sum(v).over(inner), F.lit(0)) + F.col(f"{before}_{k}") for k, v in values.items()}).select(*df.columns, *values)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect what it no longer refers to, so that Spark removes the shuffle
    files of queries that have ended."""
    spark.sparkContext._jvm.System.gc()


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Interner(dict):
    """word -> dense id, in order of first sight; ``self.words`` is the inverse."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection, so it adds no collisions."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, end to end."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and two or more
    share an executor with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        return


def blocks(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of text each (one row at least), so
    that memory does not depend on Arrow's batch size.  Rows are neither cut nor reordered."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0))
        at = 0
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def arrays(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
