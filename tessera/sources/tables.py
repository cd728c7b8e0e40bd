"""A Spark data source of one's own: `spark.read.format("triples")` over fixed-size binary rows (i, j, v).

A folder has files of rows of 24 bytes (two 64-bit integers and a double, little-endian) without a
header. A read is planned in partitions of byte ranges, so that one large file is many tasks; the
options from and to choose rows by i, which files are ordered by: their ranges are found by a
bisection, and nothing else is read. (Filters aren't pushed down: Spark keeps what a reader was
pushed with the relation, so two uses of it with different filters would get the rows of one.) A write has two
phases: tasks write files of their own names, and the commit makes those of the tasks that
succeeded the folder's content; tasks that were repeated leave nothing. Folders must be on storage that driver
and executors see as a path, or any that pyarrow's file systems know.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "triples"
SCHEMA = "i long, j long, v double"
ROW = np.dtype([("i", "<i8"), ("j", "<i8"), ("v", "<f8")])
#: Bytes of a partition, and rows that are read at once.
PARTITION_BYTES = 32 << 20
ROWS = 1 << 16

_SCHEMA = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64())])


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    rows: int


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class TriplesReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, low: int | None = None, high: int | None = None):
        self.path, self.partition_rows, self.low, self.high = path, max(1, partition_bytes // ROW.itemsize), low, high

    def partitions(self) -> Sequence[Range]:
        files, base = _place(self.path)
        out = []
        for info in sorted(files.get_file_info(arrow_fs.FileSelector(base)), key=lambda x: x.path):
            if info.type != arrow_fs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            if info.size % ROW.itemsize:
                raise ValueError(f"{info.path} is no whole number of rows")
            n = info.size // ROW.itemsize
            with files.open_input_file(info.path) as f:
                first = 0 if self.low is None else _bisect(f, n, self.low)
                last = n if self.high is None else _bisect(f, n, self.high + 1)
            out += [Range(info.path, k, min(self.partition_rows, last - k)) for k in range(first, last, self.partition_rows)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        files, _ = _place(self.path)
        with files.open_input_file(partition.path) as f:
            for k in range(0, partition.rows, ROWS):
                n = min(ROWS, partition.rows - k)
                rows = np.frombuffer(f.read_at(n * ROW.itemsize, (partition.first + k) * ROW.itemsize), ROW)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in ROW.names], schema=_SCHEMA)


def _bisect(f, n: int, value: int) -> int:
    """The first row of an ordered file whose i is not below value."""
    a, b = 0, n
    while a < b:
        k = (a + b) // 2
        if np.frombuffer(f.read_at(8, k * ROW.itemsize), "<i8")[0] < value:
            a = k + 1
        else:
            b = k
    return a


class TriplesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A task's rows, in the order of i, under a name that only this attempt has."""
        files, base = _place(self.path)
        table = pa.Table.from_batches(list(iterator), schema=_SCHEMA).sort_by([("i", "ascending"), ("j", "ascending")])
        if not table.num_rows:
            return Written(None, 0)
        rows = np.empty(table.num_rows, ROW)
        for c in ROW.names:
            rows[c] = table.column(c).to_numpy()
        files.create_dir(f"{base}/_{self.job}", recursive=True)
        name = uuid.uuid4().hex
        with files.open_output_stream(f"{base}/_{self.job}/{name}") as f:
            f.write(rows.tobytes())
        return Written(name, table.num_rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _place(self.path)
        files.create_dir(base, recursive=True)
        old = [x.path for x in files.get_file_info(arrow_fs.FileSelector(base)) if x.type == arrow_fs.FileType.File] if self.overwrite else []
        for k, m in enumerate(m for m in messages if m and m.name):
            files.move(f"{base}/_{self.job}/{m.name}", f"{base}/part-{k:05d}-{self.job}")
        for path in old:
            files.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, base = _place(self.path)
        if files.get_file_info(f"{base}/_{self.job}").type == arrow_fs.FileType.Directory:
            files.delete_dir(f"{base}/_{self.job}")


class Triples(DataSource):
    """Options: path; of a read also partitionBytes and the first and last i, from and to."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TriplesReader:
        bound = lambda name: int(self.options[name]) if name in self.options else None
        return TriplesReader(self.options["path"], int(self.options.get("partitionbytes", PARTITION_BYTES)), bound("from"), bound("to"))

    def writer(self, schema: StructType, overwrite: bool) -> TriplesWriter:
        if [f.name for f in schema] != ["i", "j", "v"]:
            raise ValueError(f"rows must be ({SCHEMA})")
        return TriplesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(Triples)
