"""Rollout dumps by step as a data source: ``spark.read.format("rollout_dump")``.

A dump is a folder with one folder for each step; a step's files count once its ``_done.json`` lists
them, which the driver writes last, in one piece, so that a step is there whole or not at all.
A reader lists steps, then gives each file to a task; a filter on the step is taken before anything
in other steps' folders is listed.  As a stream, each micro-batch has the steps that were done since.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT, DONE = "rollout_dump", "_done.json"
#: The rows of a dump; a writer may have others.
ROWS = "input string, output string, gts string, score double, step long"


class Folder:
    """A dump's folder in any store that pyarrow reaches."""

    def __init__(self, path: str):
        uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.fs, self.at = pa.fs.FileSystem.from_uri(uri)
        self.at = self.at.rstrip("/")

    def steps(self) -> list[int]:
        """The steps that have a folder, done or not."""
        found = self.fs.get_file_info(pa.fs.FileSelector(self.at, allow_not_found=True))
        return sorted(int(n) for f in found if f.type == pa.fs.FileType.Directory and (n := f.base_name.removeprefix("step=")).isdigit() and n != f.base_name)

    def done(self, step: int) -> list[str] | None:
        """The files of a step, None if it is not done."""
        at = f"{self.at}/step={step}/{DONE}"
        if self.fs.get_file_info(at).type == pa.fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(at) as f:
            return [f"step={step}/{name}" for name in json.loads(f.read())]

    def finish(self, step: int, names: list[str]) -> None:
        """Put the list beside the files, whole at once."""
        at = f"{self.at}/step={step}"
        part = f"{at}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(sorted(names)).encode())
        self.fs.move(part, f"{at}/{DONE}")

    def read(self, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_file(f"{self.at}/{name}") as f:
            file = pq.ParquetFile(f)
            here = [n for n in schema.names if n in file.schema_arrow.names]
            for batch in file.iter_batches(columns=here):
                columns = [batch.column(n).cast(schema.field(n).type) if n in here else pa.nulls(batch.num_rows, schema.field(n).type) for n in schema.names]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class Part(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]  # (step, name)


def arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class _Reads:
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        yield from Folder(self.path).read(part.name, arrow_schema(self.schema))


class DumpReader(_Reads, DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        super().__init__(path, schema)
        self.wanted: list = []  # tests of a step

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        tests = {EqualTo: lambda s, v: s == v, GreaterThan: lambda s, v: s > v, GreaterThanOrEqual: lambda s, v: s >= v, LessThan: lambda s, v: s < v, LessThanOrEqual: lambda s, v: s <= v, In: lambda s, v: s in v}
        for f in filters:
            if type(f) in tests and f.attribute == ("step",):
                self.wanted.append((tests[type(f)], f.value))
            else:
                yield f  # for Spark to apply

    def partitions(self) -> list[Part]:
        folder = Folder(self.path)
        steps = [s for s in folder.steps() if all(test(s, v) for test, v in self.wanted)]
        return [Part(name) for s in steps for name in folder.done(s) or []] or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.name else iter(())


class DumpStream(_Reads, DataSourceStreamReader):
    """Offsets are steps: a step that is done before a smaller one holds that one's place."""

    def initialOffset(self) -> dict:
        return {"step": -1}

    def latestOffset(self) -> dict:
        folder, last = Folder(self.path), -1
        for s in folder.steps():
            if folder.done(s) is None:
                break
            last = s
        return {"step": last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        folder = Folder(self.path)
        return [Part(name) for s in folder.steps() if start["step"] < s <= end["step"] for name in folder.done(s) or []]


class DumpWriter(DataSourceArrowWriter):
    """Tasks write files that nobody lists; the commit lists them.  A step that is done is not
    written again unless ``overwrite`` is asked for."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        if "step" not in schema.names:
            raise ValueError("a dump needs a column step")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        folder, writers = Folder(self.path), {}
        for batch in batches:
            if batch.column("step").null_count:
                raise ValueError("a row without a step")
            table = pa.Table.from_batches([batch])
            for step in table.column("step").unique().to_pylist():
                if step not in writers:
                    name = f"{uuid.uuid4().hex}.parquet"
                    folder.fs.create_dir(f"{folder.at}/step={step}", recursive=True)
                    writers[step] = (name, pq.ParquetWriter(folder.fs.open_output_stream(f"{folder.at}/step={step}/{name}"), table.schema))
                writers[step][1].write_table(table.filter(pa.compute.equal(table.column("step"), step)))
        for _, writer in writers.values():
            writer.close()
        return Written([(int(step), name) for step, (name, _) in writers.items()])

    def commit(self, messages: list[Written | None]) -> None:
        folder, files = Folder(self.path), {}
        for message in messages:
            for step, name in message.files if message else ():
                files.setdefault(step, []).append(name)
        if not self.overwrite and (there := [s for s in files if folder.done(s) is not None]):
            self.abort(messages)
            raise ValueError(f"steps are dumped already: {sorted(there)}")
        for step, names in sorted(files.items()):
            old = folder.done(step) or []
            folder.finish(step, names)
            for name in old:
                folder.fs.delete_file(f"{folder.at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        for message in messages:
            for step, name in message.files if message else ():
                folder.fs.delete_file(f"{folder.at}/step={step}/{name}")


class DumpSource(DataSource):
    """Options: ``path``.  Without a schema the rows of a dump are ``ROWS``; columns that files don't have are null."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DumpReader:
        return DumpReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DumpStream:
        return DumpStream(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DumpWriter:
        return DumpWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, whose filters then reach Python data sources."""
    from quillstream.shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DumpSource)


def write_dump(df: DataFrame, path: str, overwrite: bool = False) -> None:
    register(df.sparkSession)
    df.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def read_dump(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format(FORMAT)
    return (reader.schema(schema) if schema else reader).load(path)


def stream_dump(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    register(spark)
    reader = spark.readStream.format(FORMAT)
    return (reader.schema(schema) if schema else reader).load(path)


def scratch(spark: SparkSession) -> str:
    """A new folder in what all executors share; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/dump-{uuid.uuid4().hex}"


def recorded(spark: SparkSession, path: str, step: int, make) -> DataFrame:
    """A step's rows from the dump, or ``make()``, dumped first."""
    if Folder(path).done(step) is None:
        from pyspark.sql import functions as F

        write_dump(make().withColumn("step", F.lit(step).cast("long")), path)
    return read_dump(spark, path).where(f"step = {step}")
