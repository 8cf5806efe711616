"""Dense .npy arrays as tables, (path, row_idx, vector), and back; 16-bit floats included. Dictionaries that were saved pickled are
read by an unpickler that can make nothing but arrays, numbers, texts and containers of them.

Files are read by ranges of rows, many tasks a file, through a data source. Writing, each task puts its rows in a part of
its own; parts are joined in order by the file system, so no row comes to the driver.
"""

from __future__ import annotations

import ast
import io
import pickle
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Rows handed on at once; bytes of a file that a task reads; bytes that are copied at once.
BATCH, PARTITION_BYTES, COPY_BYTES = 1024, 64 << 20, 8 << 20

_ROWS = "path string, row_idx long, vector array<float>"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path is in, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(stream) -> tuple[np.dtype, tuple[int, ...], int, bool]:
    """Kind, shape, where the numbers begin, and whether columns come first, of a .npy file."""
    start = stream.read(8)
    if start[:6] != b"\x93NUMPY" or start[6] not in (1, 2, 3):
        raise ValueError("not a .npy file")
    size = struct.unpack("<H", stream.read(2))[0] if start[6] == 1 else struct.unpack("<I", stream.read(4))[0]
    about = ast.literal_eval(stream.read(size).decode("latin1" if start[6] < 3 else "utf8"))
    return np.dtype(about["descr"]), about["shape"], 8 + (2 if start[6] == 1 else 4) + size, about["fortran_order"]


def _files(path: str) -> list[tuple[str, str]]:
    """(name, place in its store) of a .npy file, or of those in a folder, in order."""
    store, where = _at(path)
    if store.get_file_info(where).type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(where))
        return sorted((f.path, f.path) for f in found if f.path.endswith(".npy") and f.type == fs.FileType.File)
    return [(path, where)]


@dataclass
class _Range(InputPartition):
    """Rows of a file: its name, its place, kind and width of a row, where the first one is, and which they are."""

    name: str
    where: str
    kind: str
    width: int
    begins: int
    first: int
    beyond: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[_Range]:
        store, _ = _at(self.path)
        out = []
        for name, where in _files(self.path):
            with store.open_input_file(where) as stream:
                kind, shape, begins, by_column = _header(stream)
            if kind.hasobject:
                raise ValueError(f"{name} holds Python objects")
            if not shape:
                raise ValueError(f"{name} holds one number, not rows")
            width = int(np.prod(shape[1:], dtype=np.int64))
            if by_column and len(shape) > 1 and width > 1:
                raise ValueError(f"{name} is stored column by column")
            step = max(1, self.size // max(1, width * kind.itemsize))
            out += [_Range(name, where, kind.str, width, begins, a, min(a + step, shape[0])) for a in range(0, shape[0], step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        store, _ = _at(self.path)
        kind = np.dtype(partition.kind)
        row = partition.width * kind.itemsize
        with store.open_input_file(partition.where) as stream:
            stream.seek(partition.begins + partition.first * row)
            for a in range(partition.first, partition.beyond, BATCH):
                n = min(BATCH, partition.beyond - a)
                content = stream.read(n * row)
                if len(content) < n * row:
                    raise ValueError(f"{partition.name} ends early")
                numbers = np.frombuffer(content, kind).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * partition.width, pa.int32()), pa.array(numbers))
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * n), pa.array(np.arange(a, a + n), pa.int64()), vectors], ["path", "row_idx", "vector"])


@dataclass
class _Part(WriterCommitMessage):
    """A task's part: its place among the parts, its name, rows and their width."""

    order: int
    name: str
    rows: int
    width: int


class _Writer(DataSourceArrowWriter):
    """Writes one column of arrays of one length; rows come in order, partition after partition."""

    def __init__(self, path: str, dtype: str):
        self.path, self.kind, self.run = path, dtype, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, where = _at(self.path)
        name, rows, width = f"{where}.parts-{self.run}/{task.partitionId()}-{task.taskAttemptId()}", 0, -1
        store.create_dir(f"{where}.parts-{self.run}")
        with store.open_output_stream(name) as out:
            for batch in iterator:
                vectors = batch.column(0)
                sizes = set(np.diff(np.asarray(vectors.offsets)).tolist()) if len(vectors) else set()
                flat = vectors.flatten()
                if vectors.null_count or flat.null_count or len(sizes | ({width} - {-1})) > 1:
                    raise ValueError("vectors differ in length, or are null")
                width = sizes.pop() if sizes else width
                rows += len(vectors)
                out.write(np.asarray(flat).astype(self.kind).tobytes())
        return _Part(task.partitionId(), name, rows, width)

    def commit(self, messages: list[_Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.order)
        if len({m.width for m in parts}) > 1:
            self.abort(messages)
            raise ValueError("vectors differ in length, or are null")
        store, where = _at(self.path)
        head = io.BytesIO()
        shape = sum(m.rows for m in parts), parts[0].width if parts else 0
        np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(np.dtype(self.kind)), "fortran_order": False, "shape": shape})
        unfinished = f"{where}.parts-{self.run}/whole"
        with store.open_output_stream(unfinished) as out:
            out.write(head.getvalue())
            for part in parts:
                with store.open_input_stream(part.name) as stream:
                    while block := stream.read(COPY_BYTES):
                        out.write(block)
        store.move(unfinished, where)  # a reader never sees half a file
        self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        store, where = _at(self.path)
        if store.get_file_info(f"{where}.parts-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{where}.parts-{self.run}")


class NpyDataSource(DataSource):
    """spark.read.format("npy").load(file or folder); df.write.format("npy").mode("append").save(file), with an option dtype."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return _ROWS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("dtype", "<f4"))


def read_npy(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Rows of one .npy file, or of those in a folder (then row_idx counts in each); axes beyond the first are one vector. A file is
    read by as many tasks as it has partition_bytes, its header once; files of any size, in any store that Arrow reads."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").option("partition_bytes", partition_bytes).load(path)


def write_npy(df: DataFrame, path: str, vector: str, *order: str, dtype: str = "<f4") -> None:
    """A column of arrays of one length, in a total order, as the matrix of one .npy file, in a store that all machines and Arrow
    reach. Rows are dealt by ranges of the order and written by the tasks that have them; parts are joined by blocks of COPY_BYTES,
    and the file appears whole. Null vectors and numbers are an error. An empty table gives an array of no rows."""
    df.sparkSession.dataSource.register(NpyDataSource)
    df.orderBy(*order).select(F.col(f"`{vector}`").alias("vector")).write.format("npy").option("dtype", dtype).mode("append").save(path)


class _Harmless(pickle.Unpickler):
    """An unpickler to which only the makers of arrays and numbers are known: a file can name no other function."""

    _MODULES = frozenset(("numpy", "numpy.core.multiarray", "numpy._core.multiarray"))
    _NAMES = frozenset(("ndarray", "dtype", "_reconstruct", "scalar"))

    def find_class(self, module: str, name: str):
        if module in self._MODULES and name in self._NAMES:
            return super().find_class("numpy._core.multiarray" if name in ("_reconstruct", "scalar") else "numpy", name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def read_npy_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): a dictionary from texts or numbers to numbers, saved pickled in a .npy file; one task reads it, since a pickle
    is one stream. Values that are no numbers are an error, and so is anything that would run code."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                stream = io.BytesIO(content)
                kind, shape, _, _ = _header(stream)
                if not kind.hasobject or shape != ():
                    raise ValueError("not a pickled dictionary")
                found = _Harmless(stream).load().item()
                if not isinstance(found, dict):
                    raise ValueError("not a pickled dictionary")
                keys, values = pa.array([str(k) for k in found], pa.string()), pa.array([float(v) for v in found.values()], pa.float64())
                yield pa.RecordBatch.from_arrays([keys, values], ["key", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key string, value double")
