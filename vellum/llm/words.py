"""Vectorised access to the words of a batch of texts.

Everything here works on the UTF-8 buffers of Arrow string columns with numpy and
is used inside tasks that Spark has partitioned.  A word is a run of bytes other
than space, tab, line feed, vertical tab, form feed and carriage return, that is
``[^\\x20\\x09-\\x0D]+``.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_WINDOW = 128 << 10


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of the input."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def give_back() -> None:
    """Return freed memory to the system at the end of a task, as Spark keeps its Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Texts(NamedTuple):
    """The bytes of some texts one after the other, and where each begins and ends."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Runs(NamedTuple):
    """Runs of wanted bytes: first byte, byte after the last, number of the text, hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 2 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of about `budget` text bytes, so that a task's memory stays bounded.

    A longer text is a piece by itself.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.diff(texts_of(batch.column(batch.schema.get_field_index(column))).offsets)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = int(np.searchsorted(total, before + budget, side="right"))
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def runs(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray, fold: bool = False) -> Runs:
    """Runs of bytes that `stop` (a table of 256) does not mark, within each text.

    With `fold`, A-Z hash as a-z.  Works through the buffer in windows of a few
    megabytes cut at run ends, so that temporary arrays stay small.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Runs(z, z, z, np.zeros(0, np.uint64))
    inside = ~stop[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    head = inside.copy()
    head[1:] &= ~inside[:-1] | first[1:n]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return hashed(data, start, end, doc, fold, inside)


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, fold: bool = False, inside: np.ndarray | None = None) -> Runs:
    """The hashes of given runs, which are in order and do not overlap; bytes between them must not be marked `inside`."""
    if not len(start):
        return Runs(start, end, doc, np.zeros(0, np.uint64))
    out = np.empty(len(start), np.uint64)
    longest = int((end - start).max(initial=0))
    power = np.empty(longest + 1, np.uint64)
    power[0] = 1
    power[1:] = _P
    power = np.cumprod(power, dtype=np.uint64)
    table = _BYTE[LOWER] if fold else _BYTE
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _WINDOW, side="right")))
        a, b = start[at], end[to - 1]
        value = table[data[a:b]]
        if inside is not None:
            value[~inside[a:b]] = 0
        begin = start[at:to] - a
        place = np.arange(b - a, dtype=np.int32)
        place -= np.repeat(begin.astype(np.int32), np.diff(np.append(begin, b - a)))
        np.minimum(place, longest, out=place)
        value *= power[place]
        out[at:to] = np.add.reduceat(value, begin)
        at = to
    return Runs(start, end, doc, mix(out ^ (end - start).astype(np.uint64)))


def words(texts: Texts, fold: bool = False) -> Runs:
    return runs(texts.data, texts.offsets, SPACE, fold)


def counted(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each n words in a row of one text, and the number of the first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h += hashes[k : k + m] * _GRAM[k]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(h[at]), at


def distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct hash of each of n texts, in order of the texts: the text, and how often it has the hash.

    A text's number and the upper bits of a hash are one number, so that plain numbers are sorted.
    """
    bits = np.uint64(max(1, (n - 1).bit_length()))
    own = np.uint64(64) - bits
    key = np.sort(doc.astype(np.uint64) << own | hashes >> bits)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return (key[first] >> own).astype(np.int64), np.diff(np.append(first, len(key)))


def salted(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    return mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))
