"""Live audio as a streaming source of its own: bytes that a given callable opens, by session and byte offset.

A `Feed` says how many bytes of each session can be read so far, and opens a session at an offset.  `stream` makes it a streaming
DataFrame: an offset holds the bytes and the end of every session, a micro-batch has a partition a session, and tasks read their
range of bytes alone.  So a query that starts again goes on at its checkpoint, and a lost task reads its range once more; no
byte is lost or comes twice, and none passes the driver.

A stream that cannot be opened in the middle (a process, a connection) is first recorded: `record` runs a task a session that
lands its bytes as files, each whole or not at all, and `Recorded` is the feed of that folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a piece: a quarter of a second of 16-bit audio at 16 kHz.
PIECE_BYTES = 8000
PIECES = "session string, offset long, pcm binary, last boolean"


class Readable(Protocol):
    def read(self, size: int) -> bytes: ...


class Feed(Protocol):
    """What a live source must be able to say; it is pickled and asked in tasks."""

    def sessions(self) -> dict[str, tuple[int, bool]]:
        """Bytes that can be read so far of each session, and whether there will be no more; neither ever goes back."""

    def open(self, session: str, start: int) -> Readable:
        """The bytes of a session from `start` on."""


@dataclass
class _Range(InputPartition):
    session: str
    start: int
    end: int
    last: bool


class _Reader(DataSourceStreamReader):
    def __init__(self, feed: Feed, piece: int):
        self.feed, self.piece = feed, piece - piece % 2

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: {"bytes": n if ended else n - n % 2, "ended": ended} for s, (n, ended) in self.feed.sessions().items()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        none = {"bytes": 0, "ended": False}
        ranges = [(s, start.get(s, none), to) for s, to in sorted(end.items())]
        return [_Range(s, a["bytes"], b["bytes"], b["ended"]) for s, a, b in ranges if b["bytes"] > a["bytes"] or b["ended"] and not a["ended"]]

    def read(self, partition: _Range) -> Iterator[tuple]:
        source, at = self.feed.open(partition.session, partition.start), partition.start
        if at == partition.end:
            yield partition.session, at // 2, b"", True
        while at < partition.end:
            piece = _exactly(source, min(self.piece, partition.end - at))
            yield partition.session, at // 2, piece[: len(piece) // 2 * 2], partition.last and at + len(piece) == partition.end
            at += len(piece)


def _exactly(source: Readable, size: int) -> bytes:
    out = b""
    while len(out) < size:
        more = source.read(size - len(out))
        if not more:
            raise EOFError("a feed ended before the bytes that it had announced")
        out += more
    return out


def stream(spark: SparkSession, name: str, feed: Feed, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The feed as a streaming DataFrame of PIECES; `offset` counts samples, and `last` marks the end of a session."""

    class Pcm(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PIECES

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(feed, piece_bytes)

    spark.dataSource.register(Pcm)
    return spark.readStream.format(name).load()


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class Recorded:
    """The feed of a folder that `record` fills: `<session>/<first byte>.pcm`, and `<bytes>.end` behind the last."""

    def __init__(self, folder: str):
        self.folder = folder

    def _files(self, below: str = "") -> list[tuple[str, str, int]]:
        where, path = _place(self.folder)
        found = where.get_file_info(fs.FileSelector(f"{path}/{below}".rstrip("/"), recursive=not below, allow_not_found=True))
        names = [(f.path.rsplit("/", 2)[-2:], f.size) for f in found if f.type == fs.FileType.File]
        return sorted((session, name, size) for (session, name), size in names if name[0].isdigit())

    def sessions(self) -> dict[str, tuple[int, bool]]:
        out: dict[str, tuple[int, bool]] = {}
        for session, name, size in self._files():
            at, ended = out.get(session, (0, False))
            first, _, kind = name.partition(".")
            if kind == "end":
                ended = True
            elif int(first) == at:  # a file behind a gap waits for what is before it
                at += size
            out[session] = at, ended
        return out

    def open(self, session: str, start: int) -> Readable:
        return _Pieces(self.folder, [(int(name.partition(".")[0]), name, size) for _, name, size in self._files(session) if name.endswith(".pcm")], session, start)


class _Pieces:
    """Bytes over several files."""

    def __init__(self, folder: str, files: list[tuple[int, str, int]], session: str, at: int):
        self.where, path = _place(folder)
        self.path, self.files, self.at, self.rest = f"{path}/{session}", files, at, b""

    def read(self, size: int) -> bytes:
        while not self.rest and self.files:
            first, name, length = self.files.pop(0)
            if first + length > self.at:
                with self.where.open_input_file(f"{self.path}/{name}") as f:
                    f.seek(self.at - first)
                    self.rest = f.read()
        out, self.rest = self.rest[:size], self.rest[size:]
        self.at += len(out)
        return out


def record(sessions: DataFrame, open_stream: Callable[[str, str, int], Readable], folder: str, piece_bytes: int = PIECE_BYTES, attempts: int = 3) -> DataFrame:
    """Record the streams of `sessions` (session, source) below `folder`, a task a session; returns session, bytes and attempts.

    `open_stream` takes the source, the session and the number of the attempt, from 1.  A stream that breaks is opened again up to `attempts`
    times in all, and so is one whose task was lost; the bytes of every attempt stand behind those landed before.
    """

    def run(rows: Iterator) -> Iterator[Row]:
        for row in rows:
            where, path = _place(folder)
            own = f"{path}/{row.session}"
            where.create_dir(own, recursive=True)
            landed = Recorded(folder).sessions().get(row.session, (0, False))
            at, ended, tries = *landed, 0

            def land(name: str, data: bytes) -> None:
                part = f"{own}/_{uuid.uuid4().hex}"  # noqa: B023
                with where.open_output_stream(part) as f:  # noqa: B023
                    f.write(data)
                where.move(part, f"{own}/{name}")  # noqa: B023

            while not ended and tries < attempts:
                tries += 1
                try:
                    source = open_stream(row.source, row.session, tries)
                    while piece := source.read(piece_bytes):
                        land(f"{at:015d}.pcm", piece)
                        at += len(piece)
                except (OSError, EOFError):
                    continue
                ended = True
            land(f"{at:015d}.end", b"")
            yield Row(session=row.session, bytes=at, attempts=tries)

    spark = sessions.sparkSession
    return spark.createDataFrame(sessions.repartition("session").rdd.mapPartitions(run), "session string, bytes long, attempts int")
