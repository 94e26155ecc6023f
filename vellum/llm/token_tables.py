"""Token-ID output as sorted-string-table shards.

Documents become token ids of a public tokenizer and are written in ascending
order of identifier to binary shards that can be searched without reading them whole:

    magic                   8 bytes
    data blocks             entries in key order, about BLOCK bytes each
    block index             of each block: first key, offset, bytes, entries, ids before it in the shard
    Bloom filter            over the keys
    footer                  48 bytes: places of index and filter, counts, id width, magic

An entry is: length of the prefix shared with the previous key of the block (1
byte), length of the rest (1), the rest, number of ids (4), the ids (little
endian, 2 or 4 bytes).  A block ends with the crc32 of its entries.  Keys are 9
bytes that sort like the identifiers, null first.

Cases: null and empty texts have only the end id; null identifiers sort first;
repeated identifiers and rows stay separate entries, ordered by the text's
crc32 (rows with one identifier and one text cannot be told apart, so they stay in one shard); an empty
table gives no shards and no rows; extra columns do not
matter, since only identifier and text are read; an id that does not fit the width
raises ValueError.  A task that is run again
writes a new file, and only files named in the manifest count.
"""

from __future__ import annotations

import functools
import math
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .frames import batched, shared_folder, written
from .word_codes import WordCodes

MAGIC = b"VELLSST1"
FOOTER = struct.Struct("<QQQQQII8s")
INDEX = struct.Struct("<9sxxxxxxxQIIQ")
BLOCK = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: About how many bytes of text a shard is for.
SHARD_BYTES = 64 << 20
MANIFEST = "path string, part int, first_key binary, last_key binary, n_docs long, n_ids long"


def key_of(identifier: int | None) -> bytes:
    """Nine bytes that sort like the identifier; null comes first."""
    return bytes(9) if identifier is None else b"\x01" + struct.pack(">Q", identifier + (1 << 63))


def identifier_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _marks(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1


def _places(a: int, b: int, bits: int) -> list[int]:
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class TableWriter:
    """Writes one shard to a stream, entry by entry in key order."""

    def __init__(self, stream, width: int):
        self.out, self.width, self.at = stream, width, len(MAGIC)
        self.block, self.entries, self.previous = bytearray(), 0, b""
        self.index, self.marks, self.docs, self.ids, self.before = [], array("I"), 0, 0, 0
        stream.write(MAGIC)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {int(ids.max())} does not fit {self.width} bytes")
        if not self.entries:
            self.first, self.before, self.previous = key, self.ids, b""
        shared = 0
        while shared < len(self.previous) and self.previous[shared] == key[shared]:
            shared += 1
        self.block += bytes((shared, len(key) - shared)) + key[shared:] + struct.pack("<I", len(ids)) + ids.astype(f"<u{self.width}").tobytes()
        self.previous = key
        self.entries += 1
        self.docs += 1
        self.ids += len(ids)
        self.marks.extend(_marks(key))
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.index.append(INDEX.pack(self.first, self.at, len(self.block), self.entries, self.before))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * self.docs)
        bloom = bytearray((bits + 7) // 8)
        for k in range(0, len(self.marks), 2):
            for p in _places(self.marks[k], self.marks[k + 1], bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.out.write(index)
        self.out.write(bytes(bloom))
        self.out.write(FOOTER.pack(self.at, self.at + len(index), bits, self.docs, self.ids, self.width, len(self.index), MAGIC))


class TableReader:
    """Reads one shard: by key with a binary search over the block index, or in order."""

    def __init__(self, stream):
        self.file = stream
        size = stream.size()
        self.index_at, self.bloom_at, self.bits, self.docs, self.ids, self.width, blocks, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        raw = self._read(self.index_at, blocks * INDEX.size)
        self.index = list(INDEX.iter_unpack(raw))
        self.bloom = None

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        _, at, n, entries, before = self.index[k]
        raw = self._read(at, n)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        p, key = 0, b""
        for _ in range(entries):
            shared, rest = raw[p], raw[p + 1]
            key = key[:shared] + raw[p + 2 : p + 2 + rest]
            p += 2 + rest
            (count,) = struct.unpack_from("<I", raw, p)
            ids = np.frombuffer(raw, f"<u{self.width}", count, p + 4)
            p += 4 + count * self.width
            yield key, before, ids
            before += count

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """Key, ids before it in this shard, and ids of every entry."""
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of all entries of an identifier."""
        key = key_of(identifier)
        if self.bloom is None:
            self.bloom = self._read(self.bloom_at, (self.bits + 7) // 8)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(*_marks(key), self.bits)):
            return []
        low, high = 0, len(self.index)
        while low < high:  # the first block that begins at or after the key
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.index[middle][0] < key else (low, middle)
        found = []
        for k in range(max(0, low - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            found += [ids for entry, _, ids in self._block(k) if entry == key]
        return found


def open_table(path: str) -> TableReader:
    where, name = fs.FileSystem.from_uri(path)
    return TableReader(where.open_input_file(name))


_codes: dict[str, WordCodes] = {}


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_at_space(tokenizer) -> bool:
    """Whether the ids of texts are those of their words in order, as with tokenizers that drop white space; tried on a few texts."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    words = ["Some", "words,", "2", "of", "them", "isn't", "Ünï", "a.b", "!!"]
    return all(ids(before + space.join(words) + before) == [i for w in words for i in ids(w)] for space in (" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c") for before in ("", " "))


@functools.cache
def text_encoder(tokenizer_path: str):
    """A function from texts to their ids, one after the other, and where those of each begin.

    A tokenizer that drops white space encodes every distinct word once; another one the whole texts.
    """
    if splits_at_space(tokenizer := _tokenizer(tokenizer_path)):
        codes = word_encoder(tokenizer_path)
        return lambda t: codes(t.data, W.words(t), len(t))

    def whole(t: W.Texts) -> tuple[np.ndarray, np.ndarray]:
        raw = t.data.tobytes()
        each = [tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)]
        return np.array([i for ids in each for i in ids], np.int64), np.concatenate([[0], np.cumsum([len(ids) for ids in each])]).astype(np.int64)

    return whole


def word_encoder(tokenizer_path: str) -> WordCodes:
    """Ids of words by the tokenizers library, kept for the words seen."""
    if tokenizer_path not in _codes:
        tokenizer = _tokenizer(tokenizer_path)

        def encode(words: list[bytes]) -> list[list[int]]:
            out: list[list[int]] = []
            for at in range(0, len(words), 4096):
                out += [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words[at : at + 4096]], add_special_tokens=False)]
            return out

        _codes[tokenizer_path] = WordCodes(encode)
    return _codes[tokenizer_path]


def write_tables(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", width: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards below `path` and return the manifest, one row a shard.

    Rows are dealt out by ranges of the identifier (and the text's crc32, so that
    equal identifiers can be split), so the shards follow one another in order; their number
    follows from the bytes of all texts.  Ids take 2 or 4 bytes, as the vocabulary needs.
    """
    width = width or (2 if max(_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / shard_bytes))
    ordered = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes = text_encoder(tokenizer_path)
        where, folder = fs.FileSystem.from_uri(path)
        part = TaskContext.get().partitionId()
        name, stream, keys = f"{part:06d}-{uuid.uuid4().hex}.sst", None, (b"", b"")
        for batch in W.slices(batches, "text"):
            if stream is None:
                where.create_dir(folder, recursive=True)
                stream = where.open_output_stream(f"{folder}/{name}")
                writer = TableWriter(stream, width)
            t = W.texts_of(batch.column("text"))
            flat, at = codes(t)
            for k, identifier in enumerate(batch.column("doc_id").to_pylist()):
                last = key_of(identifier)
                keys = (keys[0] or last, last)
                writer.add(last, np.append(flat[at[k] : at[k + 1]], end_id))
        if stream is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "part": pa.array([part], pa.int32()), "first_key": [keys[0]], "last_key": [keys[1]], "n_docs": [writer.docs], "n_ids": [writer.ids]})

    return written(batched(ordered, write, MANIFEST), "token-manifest")


def read_tables(manifest: DataFrame) -> DataFrame:
    """All entries of the shards of a manifest: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit).

    `start` counts the ids of all entries before, over all shards in order; the
    running sum is over the manifest, which has a row for each shard.
    """
    before = Window.orderBy("first_key", "last_key", "part").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(1, int(manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                table, out, size = open_table(path), [], 0

                def rows(out: list) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

                for key, before, ids in table.scan():
                    out.append((identifier_of(key), start + before, len(ids), ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size > 4 << 20:
                        yield rows(out)
                        out, size = [], 0
                if out:
                    yield rows(out)

    return batched(shards.select("path", "start").repartition(n), read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, identifier: int | None) -> DataFrame:
    """The entries of one identifier: only shards whose range holds it are opened and searched."""
    key = key_of(identifier)
    shards = manifest.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).select("path")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if found := [ids.astype("<u4").tobytes() for ids in open_table(path).get(identifier)]:
                    yield pa.RecordBatch.from_arrays([pa.array([identifier] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    return batched(shards, find, "doc_id long, ids binary")


def tables_folder(docs: DataFrame) -> str:
    return shared_folder(docs.sparkSession, "token-tables")
