"""PCM16 mono WAV bytes: header, sample ranges and writing, as Arrow functions over binary columns."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = "rate int, offset long, num_samples long"


def parse_header(data: bytes, total: int | None = None) -> tuple[int, int, int]:
    """Sample rate, place of the first sample, number of samples; ValueError when not PCM16 mono.

    A data size of zero, all ones or beyond the end means up to the end of the file, which has `total` bytes if `data` is only its beginning.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        at += 8
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
            if kind not in (1, 0xFFFE) or channels != 1 or bits != 16:
                raise ValueError("only mono PCM16 can be read")
        elif name == b"data":
            if rate is None:
                raise ValueError("data before format")
            left = (len(data) if total is None else total) - at
            size = left if size in (0, 0xFFFFFFFF) or size > left else size
            return rate, at, size // 2
        at += size + size % 2
    raise ValueError("no data in the WAV file")


def header(content: Column) -> Column:
    """Struct of rate, offset and num_samples; null fields for what is not PCM16 mono."""

    @F.pandas_udf(HEADER)
    def read(s: pd.Series) -> pd.DataFrame:
        out = []
        for data in s:
            try:
                out.append(parse_header(data) if data is not None else (None, None, None))
            except ValueError:
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["rate", "offset", "num_samples"]).astype({"rate": "Int32", "offset": "Int64", "num_samples": "Int64"})

    return read(content)


def duration(parsed: Column) -> Column:
    return F.try_divide(parsed["num_samples"], parsed["rate"])


def samples(content: Column, parsed: Column, start: Column, end: Column) -> Column:
    """Samples of the half-open range, cut to what there is, as floats in [-1, 1)."""

    @F.pandas_udf("array<float>")
    def read(data: pd.Series, offset: pd.Series, total: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for raw, o, n, lo, hi in zip(data, offset, total, a, b, strict=True):
            if raw is None or pd.isna(o):
                out.append(None)
                continue
            lo, hi = (int(min(max(0, x), n)) for x in (lo, hi))
            out.append(np.frombuffer(raw, "<i2", max(0, hi - lo), int(o) + 2 * lo).astype(np.float32) / np.float32(32768))
        return pd.Series(out)

    return read(content, parsed["offset"], parsed["num_samples"], start, end)


def encoded(values: Column, rate: int) -> Column:
    """WAV bytes of float samples, rounded and clipped to 16 bits."""

    @F.pandas_udf("binary")
    def write(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            body = b"" if x is None else np.clip(np.rint(np.asarray(x, np.float64) * 32768), -32768, 32767).astype("<i2").tobytes()
            out.append(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body)
        return pd.Series(out)

    return write(values)


def frame_levels(values: Column, frame: int) -> Column:
    """Root mean square of each whole frame."""

    @F.pandas_udf("array<double>")
    def levels(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            v = np.zeros(0) if x is None else np.asarray(x, np.float64)
            k = len(v) // frame
            out.append(np.sqrt(np.mean(v[: k * frame].reshape(k, frame) ** 2, axis=1)) if k else np.zeros(0))
        return pd.Series(out)

    return levels(values)
