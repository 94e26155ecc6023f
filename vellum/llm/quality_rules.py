"""Quality rules: compression bands over whole documents and fixed chunks.

A text that zstandard shrinks far more than prose repeats itself; one that it
hardly shrinks is noise, such as encoded binary data.  Each length class has its
own band of allowed ratios (bytes / compressed bytes), since short texts
compress less.  `learn` takes the bands from texts that the caller trusts: every trusted text counts, as one
of a bounded number of (length class, ratio) cells, so no sample is drawn and no text is shuffled.  Trusted
texts should hold every script and kind of text that is to stay, as an alphabet of two or more bytes a letter
compresses more.  Where there are none, the bands of one kind of prose stand in (`BANDS`).  A text of `CHUNK` bytes or more is also cut into chunks of that size, of which the last ends with the text (so it may overlap the one
before), and it is rejected when more than `CHUNK_SHARE` of its chunks lie outside the chunk band.  A shorter
text is a single chunk: its own band judges it.

Two base rules come first: under 50 words, or over half of the words inside
three-word windows that occur twice or more.

Cases: null and empty texts have no words, so they fail the base rules.  Trusted texts that fail the base
rules teach nothing; trusted identifiers that are null, repeated or of no document change nothing.  Rows
are scored one by one, so repeated rows and repeated ids get one result each.
Extra columns are kept by `score`; a clash with a result column raises
ValueError.  Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words as W
from .frames import append_columns, batched

#: A text of this many bytes or more is cut into chunks; more than this share of bad ones rejects it.
CHUNK, CHUNK_SHARE = 4096, 0.3
#: Length classes are half octaves of UTF-8 bytes, from 2 ** 6.5 to 2 ** 20; shorter and longer texts join the outermost.
CLASSES = range(13, 41)
#: Ratios are counted in steps of 1 / STEPS of their natural logarithm.
STEPS = 256
#: A class with fewer trusted texts takes its limits from its neighbours, so much wider for each class between.
LEAST, RISE = 40, 1.06
#: Trusted keys up to this many are broadcast (about 64 bytes each there).
MOST_TRUSTED = 1 << 20


class Bands(NamedTuple):
    """Lowest and highest ratio by length (each below its limit in bytes), and those of a chunk."""

    whole: tuple[tuple[float, float, float], ...]
    chunk: tuple[float, float]


#: What `learn` finds on the 3,243 texts labelled good of sf0.1, a synthetic prose; classes of 11,585 bytes and more, which
#: have too few, by its own rule; the high limits 10 % wider.  Real prose spreads wider: give trusted texts.
BANDS = (
    (362, 1.21, 1.95), (512, 1.26, 2.24), (724, 1.26, 2.23), (1024, 1.41, 2.27), (1448, 1.63, 2.34), (2048, 1.78, 2.41), (2896, 1.84, 2.43), (4096, 1.96, 2.52),
    (5793, 2.07, 2.60), (8192, 2.06, 2.66), (11585, 2.17, 2.71), (16384, 2.17, 2.87), (32768, 2.17, 3.22), (65536, 2.17, 3.62), (131072, 2.17, 4.07), (math.inf, 2.17, 4.95),
)
CHUNK_LOW, CHUNK_HIGH = 2.03, 2.53
DEFAULT = Bands(BANDS, (CHUNK_LOW, CHUNK_HIGH))
LEVEL = 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True

RESULT = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("ratio", pa.float64()), ("bad_chunk_share", pa.float64()), ("kept", pa.bool_()),
]


def repeated_words(r: W.Runs, n_texts: int, n: int = 3) -> np.ndarray:
    """For each text, its words that lie in a window of n words found twice or more in it."""
    h, at = W.grams(r.hash, r.doc, n)
    covered = np.zeros(len(r.hash), bool)
    if len(h):
        order = np.argsort(W.salted(h, r.doc[at]))
        key = W.salted(h, r.doc[at])[order]
        same = key[1:] == key[:-1]
        again = np.zeros(len(h), bool)
        again[1:] |= same
        again[:-1] |= same
        hits = at[order[again]]
        for k in range(n):
            covered[hits + k] = True
    return W.counted(r.doc[covered], n_texts)


def duplicate_lines(t: W.Texts) -> np.ndarray:
    """For each text, its lines that hold a word and equal an earlier line."""
    r = W.runs(t.data, t.offsets, _NEWLINE)
    if not len(r.start):
        return np.zeros(len(t), np.int64)
    solid = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(~W.SPACE[t.data], out=solid[1:])
    full = solid[r.end] > solid[r.start]
    key, doc = W.salted(r.hash, r.doc)[full], r.doc[full]
    _, first = np.unique(key, return_index=True)
    return W.counted(doc, len(t)) - W.counted(doc[first], len(t))


def chunk_ratios(data: bytes, squeeze: zstandard.ZstdCompressor) -> Iterator[float]:
    """The ratio of each chunk of a text; a text shorter than one has none."""
    n, view = len(data), memoryview(data)
    if n >= CHUNK:
        for at in [*range(0, n - CHUNK, CHUNK), n - CHUNK]:
            yield CHUNK / len(squeeze.compress(view[at : at + CHUNK]))


def compression(data: bytes, squeeze: zstandard.ZstdCompressor, bands: Bands = DEFAULT) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its chunks outside the chunk band, and whether it passes."""
    n = len(data)
    if not n:
        return 0.0, 0.0, False
    ratio = n / len(squeeze.compress(data))
    low, high = next((a, b) for limit, a, b in bands.whole if n < limit)
    least, most = bands.chunk
    bad = chunks = 0
    for x in chunk_ratios(data, squeeze):
        chunks += 1
        bad += not least <= x <= most
    share = bad / chunks if chunks else 0.0
    return ratio, share, low <= ratio <= high and share <= CHUNK_SHARE


def cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """For each text that passes the base rules its key with cells kind (length class, or 0 for a chunk), step (of the ratio) and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in W.slices(batches, "_text", 2 << 20):
            t = W.texts_of(batch.column("_text"))
            counts, raw = base_counts(t), t.data.tobytes()
            at, kind, ratio = [], [], []
            for k in np.flatnonzero(~counts[-1]):
                data = raw[t.offsets[k] : t.offsets[k + 1]]
                found = [len(data) / len(squeeze.compress(data)), *chunk_ratios(data, squeeze)]
                at += [k] * len(found)
                kind += [length_class(len(data))] + [0] * (len(found) - 1)
                ratio += found
            step = np.rint(np.log(np.array(ratio, float)) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(at, pa.int64())), pa.array(kind, pa.int32()), pa.array(step)], names=["_key", "kind", "step"])

    rows = docs.select(docs[f"`{key}`"].alias("_key"), docs[f"`{text}`"].alias("_text")).where("_key is not null")
    found = batched(rows, run, StructType([rows.schema["_key"], *StructType.fromDDL("kind int, step int").fields]))
    return found.groupBy("_key", "kind", "step").agg(F.count(F.lit(1)).alias("n"))


def length_class(n: int) -> int:
    return int(min(max(math.floor(2 * math.log2(n)), CLASSES[0]), CLASSES[-1]))


def limits(step: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Lowest and highest ratio allowed after those seen: twice as far from the median as all but 1 % lie, and past all but 1 in 2,000 by 2 %."""
    order = np.argsort(step)
    ratio, upto = np.exp(step[order] / STEPS), np.cumsum(n[order])
    q = lambda p: float(ratio[np.searchsorted(upto, p * upto[-1])])
    return min(2 * q(0.01) - q(0.5), 0.98 * q(0.0005)), max(2 * q(0.99) - q(0.5), 1.02 * q(0.9995))


def bands_of(seen: dict[int, tuple[np.ndarray, np.ndarray]], least: int = LEAST) -> Bands:
    """Bands from the steps and counts of each kind.

    Ratios of prose grow with its length.  A class with too few texts therefore takes its low limit from the
    next shorter class that has enough and its high limit from the next longer one; where there is none on
    that side, it takes the limit of the nearest class on the other, RISE times wider for each class between.
    """
    own = {kind: limits(*x) for kind, x in seen.items() if x[1].sum() >= least}
    known = sorted(k for k in own if k)
    if not known:
        return DEFAULT
    whole = []
    for c in CLASSES:
        below, above = [k for k in known if k <= c], [k for k in known if k >= c]
        low = own[below[-1]][0] if below else own[above[0]][0] / RISE ** (above[0] - c)
        high = own[above[0]][1] if above else own[below[-1]][1] * RISE ** (c - below[-1])
        whole.append((2 ** ((c + 1) / 2) if c < CLASSES[-1] else math.inf, low, high))
    as_texts = next((low, high) for limit, low, high in whole if limit > CHUNK)
    return Bands(tuple(whole), own.get(0, as_texts))


def learn(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> Bands:
    """Bands from all documents whose key is in `trusted` (a table with that column), under which nearly all of them pass.

    Up to MOST_TRUSTED keys are broadcast, and only trusted texts are compressed; beyond, all texts are, and the
    cells are joined by key.  What reaches the driver is a count for each kind and step, a few thousand rows
    whatever the input.
    """
    ids = trusted.select(trusted[f"`{key}`"].alias("_key")).distinct()
    if ids.limit(MOST_TRUSTED + 1).count() <= MOST_TRUSTED:
        found = cells(docs.join(F.broadcast(ids), docs[f"`{key}`"] == ids["_key"], "left_semi"), key, text)
    else:
        found = cells(docs, key, text).join(ids, "_key", "left_semi")
    total = found.groupBy("kind", "step").agg(F.sum("n").alias("n")).toPandas()
    return bands_of({int(kind): (x["step"].to_numpy(), x["n"].to_numpy()) for kind, x in total.groupby("kind")}, least)


def base_counts(t: W.Texts) -> list[np.ndarray]:
    """Words, their code points, symbols, repeated words, and whether the base rules fail, for some texts."""
    r, n = W.words(t), len(t)
    n_words = W.counted(r.doc, n)
    chars = W.per_text(~W.SPACE[t.data] & ((t.data & 0xC0) != 0x80), t.offsets)
    symbols = W.per_text(_SYMBOL[t.data], t.offsets)
    repeats = repeated_words(r, n)
    return [n_words, chars, symbols, repeats, (n_words < 50) | (100 * repeats > 50 * n_words)]


def rules(t: W.Texts, squeeze: zstandard.ZstdCompressor, bands: Bands = DEFAULT) -> list[np.ndarray]:
    """The result columns for some texts."""
    n_words, chars, symbols, repeats, failed = base_counts(t)
    raw = t.data.tobytes()
    squeezed = [compression(raw[a:b], squeeze, bands) for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)]
    ratio, share, passed = (np.array(x) for x in zip(*squeezed, strict=True))
    return [n_words, chars, symbols, duplicate_lines(t), repeats, failed, ratio, share, ~failed & passed.astype(bool)]


def score(docs: DataFrame, text: str = "text", bands: Bands = DEFAULT) -> DataFrame:
    """All columns of `docs` and those of RESULT."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in W.slices(batches, text, 2 << 20):
            yield batch, rules(W.texts_of(batch.column(text)), squeeze, bands)

    return append_columns(docs, RESULT, part)


def keep(docs: DataFrame, text: str = "text", bands: Bands = DEFAULT) -> DataFrame:
    """The rows that pass, with the columns of `docs`."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(text).alias("_text"))
    return score(rows, "_text", bands).where(F.col("kept")).select("row.*")
