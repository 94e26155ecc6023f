"""Removal of passages that occur more than once, found by difference-cover anchors.

A window is a number of consecutive words of one text (35 by default).  Every word goes that lies in a
window whose words also begin anywhere else, in the same text or another; windows are
judged on the input.  Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

1. Anchors: positions whose remainder modulo a period P is in a difference cover of P.  Any
   two positions i and j have some d < P for which i + d and j + d are both in the cover, so two equal windows
   share an anchor at the same place in both, of the window's length less P - 1 words.
   Only 4 of 13 positions are hashed.
2. Anchors whose words occur again, anywhere, are found by their hash, and each extends to the starts of
   the windows around it, at most P.
3. The windows at these starts alone are hashed over all their words, and those that
   occur again are the repeated windows; the words that they cover are the spans to remove.

Steps 2 and 3 are the same job (`repeats`): tasks hash the positions of some texts, keep those that the texts of the task
repeat among themselves, and send each hash at most twice, packed by buckets of hashes.  So a passage
that a third of all texts share is a few rows a task.  Nothing is paired, and a bucket has a bounded number of
hashes: about `BUCKET_ITEMS`, and two for each slice of the texts (some 20 MB) of any one hash.

Window hashes have 64 bits and agree in their bucket, which another hash gives; anchors only propose.

Cases: null and empty texts have no words (null stays null); texts shorter than a window keep all words; rows of one
text are copies, so all their windows occur elsewhere; identifiers are not looked at and may be null or repeated; an
empty table gives no rows; other columns are handed on, and those named like a result raise ValueError.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import words as W
from .frames import batched, written

WINDOW = 35
#: Perfect difference sets; each remainder of the period is the difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Items of a slice and, on average, of a bucket; bytes of spans that are broadcast (more are shuffled).
SLICE_ITEMS, BUCKET_ITEMS, MOST_BROADCAST = 1 << 20, 1 << 19, 64 << 20
LEAST_BUCKETS = 64
#: Bytes of a text whose words are cut out at once.
CHUNK = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIXERS = np.random.default_rng(7_110_035).integers(1, 2**63, (2, 4096), dtype=np.uint64) | np.uint64(1)

#: First words of the items, their length in words, and in each text the place that no range goes beyond.
Items = Callable[[W.Runs, np.ndarray, pa.RecordBatch], tuple[np.ndarray, int, np.ndarray]]


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The period and cover for windows of this length: the longest period that leaves anchors of six tenths of a window."""
    period = max(p for p in COVERS if p == 1 or 10 * (window - p + 1) >= 6 * window)
    return period, COVERS[period]


def hashed(hashes: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the `length` words from each position."""
    out = np.zeros((2, len(at)), np.uint64)
    mixers = _MIXERS if length <= _MIXERS.shape[1] else np.random.default_rng(length).integers(1, 2**63, (2, length), dtype=np.uint64) | np.uint64(1)
    for a in range(0, len(at), 1 << 16):
        part = at[a : a + (1 << 16)]
        for k in range(length):
            x = hashes[part + k]
            out[0, a : a + len(part)] += x * mixers[0, k]
            out[1, a : a + len(part)] += x * mixers[1, k]
    return W.mix(out[0]), W.mix(out[1])


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as disjoint ones, in order; ranges that only touch stay apart, as they may be of two texts."""
    wanted = high > low
    order = np.argsort(low[wanted], kind="stable")
    low, high = low[wanted][order], np.maximum.accumulate(high[wanted][order]) if wanted.any() else high[wanted]
    if not len(low):
        return low, high
    new = np.concatenate([[True], low[1:] >= high[:-1]])
    return low[new], high[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(low) - 1]])]


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary rows of an array cut at the offsets."""
    size = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


_ASKED = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("hashes", pa.binary()), ("items", pa.binary()), ("records", pa.binary()), ("checks", pa.binary()), ("offsets", pa.binary()), ("limits", pa.binary()), ("known", pa.binary())])
_ASKED_DDL = "bucket long, slice long, hashes binary, items binary, records binary, checks binary, offsets binary, limits binary, known binary"
_TOLD = ["slice", "items", "records", "checks", "offsets", "limits", "known"]
_TOLD_DDL = "slice long, items binary, records binary, checks binary, offsets binary, limits binary, known binary"
SPANS = "record long, check long, spans binary, n long"


class _Slice:
    """Items of some texts, numbered by their first word among all words of the slice."""

    def __init__(self, number: int, buckets: int, reach: tuple[int, int]):
        self.number, self.buckets, self.reach = number, buckets, reach
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.records, self.checks, self.counts, self.limits = [], [], [], []
        self.n_items = self.n_words = 0

    def add(self, batch: pa.RecordBatch, r: W.Runs, counts: np.ndarray, at: np.ndarray, length: int, limits: np.ndarray) -> None:
        h, other = hashed(r.hash, at, length)
        self.parts.append((h, other, at + self.n_words))
        self.records.append(batch.column("record").to_numpy())
        self.checks.append(batch.column("check").to_numpy())
        self.counts.append(counts)
        self.limits.append(limits)
        self.n_items += len(at)
        self.n_words += len(r.hash)

    def rows(self) -> Iterator[pa.RecordBatch]:
        h, other, item = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, other, item = h[order], other[order], item[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(h)))[group] > 1 if len(h) else np.zeros(0, bool)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.counts))]).astype(np.int64)
        limits = offsets[:-1] + np.concatenate(self.limits)
        low, high = merged(*_around(item[many], offsets, limits, self.reach))
        known = np.stack([low, high], axis=1).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1 - self.number]), pa.array([self.number]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *(pa.array([np.ascontiguousarray(x).astype(np.int64).tobytes()], pa.binary()) for x in (np.concatenate(self.records), np.concatenate(self.checks), offsets, limits, known))], schema=_ASKED
        )
        asked = np.flatnonzero(np.arange(len(h)) - first[group] < 2) if len(h) else first
        bucket = ((other[asked] >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        order = np.argsort(bucket.astype(np.uint16 if self.buckets <= 1 << 16 else np.int64), kind="stable")
        asked, bucket = asked[order], bucket[order].astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
        ends = np.append(cuts, len(bucket)).astype(np.int64)
        if len(cuts):
            empty = pa.nulls(len(cuts), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(np.full(len(cuts), self.number)), _packed(h[asked], ends), _packed(item[asked].astype(np.int32), ends), empty, empty, empty, empty, empty], schema=_ASKED)


def _around(item: np.ndarray, offsets: np.ndarray, limits: np.ndarray, reach: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The range that each item stands for, within its text."""
    doc = np.searchsorted(offsets, item, side="right") - 1
    return np.maximum(item - reach[0], offsets[doc]), np.minimum(item + reach[1], limits[doc])


def _again(key: tuple, rows: pa.Table) -> pa.Table:
    """For each slice of a bucket the items whose hash is there twice."""
    rows = rows.combine_chunks()
    if key[0].as_py() < 0:
        return rows.select(_TOLD)
    hashes, items = rows.column("hashes").to_pylist(), rows.column("items").to_pylist()
    h = np.frombuffer(b"".join(hashes), np.uint64)
    item = np.frombuffer(b"".join(items), np.int32)
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    ends = np.cumsum([0] + [len(x) // 8 for x in hashes])
    left = np.concatenate([[0], np.cumsum(again)])[ends].astype(np.int64)
    some = np.flatnonzero(np.diff(left))
    found = _packed(item[again], left).take(pa.array(some))
    slices = rows.column("slice").take(pa.array(some))
    return pa.table([slices, found, *[pa.nulls(len(some), pa.binary())] * 5], names=_TOLD)


def repeats(rows: DataFrame, items: Items, buckets: int, reach: tuple[int, int]) -> DataFrame:
    """SPANS of the texts with items that occur again: the ranges from `reach[0]` words before to `reach[1]` after the items.

    `rows` has record, check and text; `items` gives the items of a batch.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        held = None
        for batch in W.slices(batches, "text"):
            t = W.texts_of(batch.column("text"))
            r = W.words(t)
            counts = W.counted(r.doc, len(t))
            at, length, limits = items(r, counts, batch)
            held = held or _Slice(next(number), buckets, reach)
            held.add(batch, r, counts, at, length, limits)
            if held.n_items >= SLICE_ITEMS or held.n_words >= 16 * SLICE_ITEMS:
                yield from held.rows()
                held = None
        if held:
            yield from held.rows()

    def gather(key: tuple, parts: pa.Table) -> pa.Table:
        parts = parts.combine_chunks()
        docs = parts.filter(parts.column("records").is_valid())
        records, checks, offsets, limits, known = (np.frombuffer(docs.column(c)[0].as_py(), np.int64) for c in ("records", "checks", "offsets", "limits", "known"))
        told = np.frombuffer(b"".join(x for x in parts.column("items").to_pylist() if x), np.int32).astype(np.int64)
        low, high = _around(told, offsets, limits, reach)
        known = known.reshape(-1, 2)
        low, high = merged(np.concatenate([known[:, 0], low]), np.concatenate([known[:, 1], high]))
        doc = np.searchsorted(offsets, low, side="right") - 1
        ends = np.searchsorted(doc, np.arange(len(records) + 1))
        spans = np.stack([low - offsets[doc], high - offsets[doc]], axis=1).astype(np.int32)
        some = np.flatnonzero(np.diff(ends))
        total = np.concatenate([[0], np.cumsum(high - low)])[ends]
        return pa.table([pa.array(records[some]), pa.array(checks[some]), _packed(spans.reshape(-1), 2 * ends).take(pa.array(some)), pa.array(np.diff(total)[some])], names=["record", "check", "spans", "n"])

    asked = batched(rows, ask, _ASKED_DDL)
    told = asked.groupBy("bucket").applyInArrow(_again, _TOLD_DDL)
    found = told.groupBy("slice").applyInArrow(gather, SPANS)
    return found.groupBy("record", "check").agg(F.first("spans").alias("spans"), F.first("n").alias("n"))  # rows of one text have the same spans


def _anchor_items(window: int) -> Items:
    period, cover = cover_of(window)
    length, inside = window - period + 1, np.isin(np.arange(period), cover)

    def items(r: W.Runs, counts: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, int, np.ndarray]:
        first = np.cumsum(counts) - counts
        place = np.arange(len(r.doc)) - first[r.doc]
        n = counts[r.doc]
        return np.flatnonzero(inside[place % period] & (place + length <= n) & (n >= window)), length, np.maximum(0, counts - window + 1)

    return items


def _window_items(window: int) -> Items:
    def items(r: W.Runs, counts: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, int, np.ndarray]:
        first = np.cumsum(counts) - counts
        starts = [np.zeros(0, np.int64)]
        for f, raw in zip(first, batch.column("spans").to_pylist(), strict=True):
            starts += [f + np.arange(a, b) for a, b in np.frombuffer(raw, np.int32).reshape(-1, 2).tolist()]
        return np.concatenate(starts), window, counts

    return items


def _near(spans: DataFrame) -> DataFrame:
    """With a broadcast hint if all spans take few enough bytes."""
    size = spans.agg(F.sum(F.octet_length("spans") + 64)).first()[0] or 0
    return F.broadcast(spans) if size <= MOST_BROADCAST else spans


def _keyed(docs: DataFrame, text: str) -> list:
    return [F.xxhash64(F.col(text)).alias("record"), F.crc32(F.col(text).cast("binary")).alias("check")]


def _buckets(n: int) -> int:
    return max(LEAST_BUCKETS, -(-n // BUCKET_ITEMS))


def spans(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """SPANS: for each text (by two hashes) with repeated windows the ranges of words that these cover, and how many words they are."""
    rows = docs.where(F.col(text).isNotNull()).select(*_keyed(docs, text), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    period, cover = cover_of(window)
    near = written(repeats(rows, _anchor_items(window), _buckets(size * len(cover) // (6 * period)), (period - 1, 1)), "anchors")
    n = near.agg(F.sum("n")).first()[0] or 0
    proposed = rows.join(_near(near.select("record", "check", "spans")), ["record", "check"])
    return written(repeats(proposed, _window_items(window), _buckets(n), (0, window)), "spans")


def cut(raw: bytes, spans: np.ndarray) -> tuple[int, int, bytes]:
    """Words of a text, words in the spans, and the other words joined by one space; a piece of the text at a time."""
    out, n, removed, at = [], 0, 0, 0
    low, high = spans[:, 0], spans[:, 1]
    while at < len(raw):
        end = _SPACE.search(raw, at + CHUNK)
        to = end.start() if end else len(raw)
        found = raw[at:to].split()
        a, b = np.searchsorted(high, n, side="right"), np.searchsorted(low, n + len(found))
        if a < b:
            stays = np.ones(len(found), bool)
            for x, y in zip(low[a:b] - n, high[a:b] - n, strict=True):
                stays[max(0, x) : y] = False
            left = list(itertools.compress(found, stays))
        else:
            left = found
        n, removed, at = n + len(found), removed + len(found) - len(left), to
        if left:
            out.append(b" ".join(left))
    return n, removed, b" ".join(out)


def keep_once(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents without the words of repeated windows: `text` is what is left, its words joined by one space; n_words and n_removed are new."""
    clash = {c.lower() for c in docs.columns} & {"n_words", "n_removed"}
    if clash:
        raise ValueError(f"columns already present: {', '.join(sorted(clash))}")
    found = spans(docs, window, text)
    record, check, held = ("_vellum_record", "_vellum_check", "_vellum_spans")
    marked = docs.select("*", *(c.alias(n) for c, n in zip(_keyed(docs, text), (record, check), strict=True)))
    small = _near(found).select(F.col("record").alias(record), F.col("check").alias(check), F.col("spans").alias(held))
    rows = marked.join(small, [record, check], "left").drop(record, check)
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, text):
            t = W.texts_of(batch.column(text))
            none = np.zeros((0, 2), np.int32)
            done = [cut(t.data[a:b].tobytes(), none if raw is None else np.frombuffer(raw, np.int32).reshape(-1, 2)) for a, b, raw in zip(t.offsets[:-1], t.offsets[1:], batch.column(held).to_pylist(), strict=True)]
            valid = batch.column(text).is_valid().to_pylist()
            left = pa.array([x[2].decode() if ok else None for x, ok in zip(done, valid, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(left if n == text else batch.column(n) for n in names), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64())], names=[*names, "n_words", "n_removed"])

    return batched(rows, run, StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())]))
