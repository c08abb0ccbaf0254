"""Arrow IPC files as a Python data source: executors open files by path and yield batches.

A file of the random-access format is read in ranges of batches, so a large one
is split; a stream is read from its start by one task.  Paths in a store that
only Spark can open are read through Spark instead, one file in a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Batches of a file that one task reads.
BATCHES = 64
#: Schemes that both Spark and Arrow open.
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs")


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def _input(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://")) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(inner)


def _reader(source):
    """A reader of either format, and whether its batches can be chosen."""
    import pyarrow as pa

    try:
        return pa.ipc.open_file(source), True
    except pa.ArrowInvalid:
        source.seek(0)
        return pa.ipc.open_stream(source), False


class ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            with _input(path) as source:
                reader, chosen = _reader(source)
                n = reader.num_record_batches if chosen else 1
                out += [Range(path, k, min(n, k + BATCHES)) for k in range(0, n, BATCHES)]
        return out

    def read(self, partition: Range) -> Iterator:
        with _input(partition.path) as source:
            reader, chosen = _reader(source)
            yield from (reader.get_batch(k) for k in range(partition.begin, partition.end)) if chosen else reader


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codeloom_arrow"

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"])

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        with _input(self._paths()[0]) as source:
            return from_arrow_schema(_reader(source)[0].schema)

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self._paths())


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".arrow", ".feather")) -> list[str]:
    """The Arrow files that ``path`` names: a file, a pattern, or a folder with all below it."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(context._jsc.hadoopConfiguration())
    found = []
    for status in store.globStatus(root) or []:
        listing = store.listFiles(status.getPath(), True)
        while listing.hasNext():
            found.append(listing.next().getPath().toString())
    return sorted(f for f in found if f.endswith(suffixes))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Arrow files that ``path`` names; all have the first one's schema."""
    paths = files(spark, path)
    if not paths:
        raise FileNotFoundError(path)
    if all(p.partition(":")[0] in SCHEMES if ":" in p else True for p in paths):
        spark.dataSource.register(ArrowFiles)
        return spark.read.format("codeloom_arrow").option("paths", json.dumps(paths)).load()
    return _through_spark(spark, paths)


def _through_spark(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of up to 2 GB, each whole in one row."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    rows = spark.read.format("binaryFile").load(paths).select("content")

    def schema(batches):
        for b in batches:
            for data in b.column("content"):
                yield pa.RecordBatch.from_pydict({"s": [_reader(pa.BufferReader(data.as_buffer()))[0].schema.serialize().to_pybytes()]})

    first = rows.limit(1).mapInArrow(schema, "s binary").first()["s"]

    def run(batches):
        for b in batches:
            for data in b.column("content"):
                reader, chosen = _reader(pa.BufferReader(data.as_buffer()))
                yield from (reader.get_batch(k) for k in range(reader.num_record_batches)) if chosen else reader

    return rows.mapInArrow(run, from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(first))))
