"""Files by name: reads of wanted files and byte ranges alone, and a writer of one file a key that replaces the one before."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .wav import parse_header

#: Opens a file by its path for reading, with seek and size(); raises FileNotFoundError.
OpenFile = Callable[[str], BinaryIO]
#: Bytes at the start of a WAV file that hold its header nearly always; bytes of contents in one batch.
HEAD, BATCH_BYTES = 4096, 8 << 20


def open_path(path: str) -> BinaryIO:
    where, name = place(path)
    return where.open_input_file(name)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def below(root: str, path: str) -> str:
    """A path below the root; one that leads out of it is refused."""
    if any(part == ".." for part in path.split("/")):
        raise ValueError("a path must stay below its root")
    return f"{root.rstrip('/')}/{path.lstrip('/')}"


def _read(rows: DataFrame, root: str, path: str, result: str, each: Callable, arguments: list[str], kind: pa.DataType, open_file: OpenFile) -> DataFrame:
    """Rows with one more column that `each` reads from the row's file; null where the path is null or there is no such file.

    Rows are dealt out by path and sorted, so each file is opened in one task and once for all its rows; files that no row names are never touched.
    """
    if result in rows.columns:
        raise ValueError(f"columns already present: {result}")
    names = list(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, BinaryIO | None] | None = None
        for batch in batches:
            found, size, at = [], 0, 0
            columns = [batch.column(a).to_pylist() for a in arguments]
            for i, name in enumerate(batch.column(path).to_pylist()):
                if name is not None and (held is None or held[0] != name):
                    if held and held[1]:
                        held[1].close()
                    try:
                        held = (name, open_file(below(root, name)))
                    except FileNotFoundError:
                        held = (name, None)
                value = None if name is None or held[1] is None else each(held[1], *(c[i] for c in columns))
                found.append(value)
                size += 0 if value is None else len(value)
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(found)).columns, pa.array(found, kind)], names=[*names, result])
                    at, found, size = i + 1, [], 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    spark_kind = "binary" if kind == pa.binary() else "array<float>"
    return rows.repartition(F.col(path)).sortWithinPartitions(path, *arguments).mapInArrow(run, f"{fields}, `{result}` {spark_kind}")


def read_files(wanted: DataFrame, root: str, path: str = "audio_path", result: str = "content", open_file: OpenFile = open_path) -> DataFrame:
    """The rows of `wanted` with the bytes of their files below `root`; null when a file is missing."""

    def each(f: BinaryIO) -> bytes:
        f.seek(0)
        return f.read()

    return _read(wanted, root, path, result, each, [], pa.binary(), open_file)


def read_ranges(wanted: DataFrame, root: str, path: str = "path", start: str = "start", length: str = "length", result: str = "content", open_file: OpenFile = open_path) -> DataFrame:
    """The rows of `wanted` with the named bytes of their files, cut to what there is; other bytes are not read."""

    def each(f: BinaryIO, at: int, n: int) -> bytes:
        f.seek(min(max(0, at), f.size()))
        return f.read(max(0, n + min(0, at)))

    return _read(wanted, root, path, result, each, [start, length], pa.binary(), open_file)


def wav_place(f: BinaryIO) -> tuple[int, int, int]:
    """Rate, first byte of the samples and number of samples of an open WAV file; of its bytes only the header is read."""
    size = HEAD
    while True:
        f.seek(0)
        head = f.read(size)
        try:
            return parse_header(head, f.size())
        except ValueError:
            if len(head) >= f.size() or len(head) < size:
                raise
            size *= 16


def read_samples(wanted: DataFrame, root: str, path: str = "path", start: str = "start_sample", end: str = "end_sample", result: str = "samples", open_file: OpenFile = open_path) -> DataFrame:
    """The rows of `wanted` with the samples of a half-open range of their WAV files, cut to what there is, as floats in [-1, 1)."""

    def each(f: BinaryIO, a: int, b: int) -> np.ndarray:
        _, first, n = wav_place(f)
        a, b = (min(max(0, x), n) for x in (a, b))
        f.seek(first + 2 * a)
        return np.frombuffer(f.read(2 * max(0, b - a)), "<i2").astype(np.float32) / np.float32(32768)

    return _read(wanted, root, path, result, each, [start, end], pa.list_(pa.float32()), open_file)


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceArrowWriter):
    """Files are written beside their places and moved there at the end of a task, so each is there whole or not at all."""

    def __init__(self, root: str, absent: bool):
        self.root, self.absent, self.job = root, absent, f"_writing-{uuid.uuid4().hex}"

    def _place(self) -> tuple[fs.FileSystem, str]:
        return place(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, root = self._place()
        where.create_dir(f"{root}/{self.job}", recursive=True)
        ready: list[tuple[str, str]] = []
        for batch in iterator:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                to, part = below(root, name), f"{root}/{self.job}/{uuid.uuid4().hex}"
                if self.absent and where.get_file_info(to).type == fs.FileType.File:
                    continue
                with where.open_output_stream(part) as f:
                    f.write(content or b"")
                ready.append((part, to))
        for folder in {to.rpartition("/")[0] for _, to in ready}:
            where.create_dir(folder, recursive=True)
        for part, to in ready:
            where.move(part, to)
        return _Written(len(ready))

    def _clear(self) -> None:
        where, root = self._place()
        if where.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.job}")

    def commit(self, messages) -> None:
        self._clear()

    def abort(self, messages) -> None:
        self._clear()


class KeyedFiles(DataSource):
    """Sink of files by path: columns path (below the option `root`) and content; with `absent` files that are there stay."""

    @classmethod
    def name(cls) -> str:
        return "vellum_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["root"], self.options.get("absent", "false") == "true")


def write_files(files: DataFrame, root: str, order: str | None = None, absent: bool = False) -> None:
    """Write one file for each path (path, content) below `root`, in place of the one that was there.

    Of rows with the same path the one that is last by `order` wins (without an order any of them); with `absent` files that are there stay.  A path is
    written whole or not at all, and what a failed job or lost task left goes when the job ends.
    """
    spark = files.sparkSession
    spark.dataSource.register(KeyedFiles)
    newest = F.max_by("content", order) if order else F.max("content")
    rows = files.groupBy("path").agg(newest.alias("content")) if order or not absent else files.dropDuplicates(["path"]).select("path", "content")
    rows.write.format("vellum_files").option("root", root).option("absent", str(absent).lower()).mode("append").save()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, whole or not at all."""
    root, _, name = path.rpartition("/")
    write_files(spark.createDataFrame([(name, text.encode())], "path string, content binary"), root)
