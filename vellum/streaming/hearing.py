"""Speech in live audio: incremental loudness, segments that end in pauses, and sessions whose pieces arrive in any order."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Takes samples and their rate, returns ranges of speech (first sample, sample after the last).
Detector = Callable[[np.ndarray, int], list[tuple[int, int]]]

# Seconds of a frame, dips in frames that do not end speech, seconds of the shortest speech, and what counts as loud.
FRAME, DIP, SHORTEST = 0.03, 5, 0.1
LEAST_LEVEL, OVER_BACKGROUND, MOST_BACKGROUND, BACKGROUND_SHARE = 0.008, 3, 0.01, 0.1

#: Pieces of a session that may wait for one before them.
MOST_WAITING = 128


@dataclass(frozen=True)
class SegmentRules:
    """When a segment of speech ends, in seconds; the buffer is looked at every `check` seconds of audio, or when it is full."""

    sample_rate: int = 16_000
    shortest: float = 1.0
    longest: float = 10.0
    pause: float = 0.6
    long_pause: float = 2.0
    pad: float = 0.15
    check: float = 0.4

    def samples(self, seconds: float) -> int:
        return int(seconds * self.sample_rate)


class Loudness:
    """Levels of the whole frames of a buffer that grows at its end; each frame is measured once, and the levels are kept in order as well."""

    def __init__(self, rate: int, levels: Iterable[float] = ()):
        self.size = int(FRAME * rate)
        self.levels = list(levels)
        self.ranked = sorted(self.levels)

    def grow(self, samples: np.ndarray) -> None:
        """Measure the frames of the buffer that are complete now."""
        done, whole = len(self.levels), len(samples) // self.size
        if whole > done:
            fresh = samples[done * self.size : whole * self.size].astype(np.float64)
            new = np.sqrt(np.einsum("ij,ij->i", fresh.reshape(-1, self.size), fresh.reshape(-1, self.size)) / self.size)
            for level in new.tolist():
                self.levels.append(level)
                bisect.insort(self.ranked, level)

    def shift(self, dropped: int) -> None:
        """Forget the frames of dropped samples; if frames do not begin where they did, all."""
        kept = self.levels[dropped // self.size :] if dropped % self.size == 0 else []
        if len(kept) < len(self.levels):
            self.levels, self.ranked = kept, sorted(kept)

    def ranges(self, rate: int) -> list[tuple[int, int]]:
        """Where the buffer is louder than its background, the level that a tenth of the frames stay below."""
        if not self.levels:
            return []
        place = BACKGROUND_SHARE * (len(self.ranked) - 1)
        below = int(place)
        above = min(below + 1, len(self.ranked) - 1)
        background = self.ranked[below] + (self.ranked[above] - self.ranked[below]) * (place - below)
        bar = max(LEAST_LEVEL, OVER_BACKGROUND * min(background, MOST_BACKGROUND))
        loud = np.flatnonzero(np.asarray(self.levels) > bar)
        runs = np.split(loud, np.flatnonzero(np.diff(loud) > DIP + 1) + 1) if len(loud) else []
        spans = [(int(r[0]) * self.size, int(r[-1] + 1) * self.size) for r in runs]
        return [(a, b) for a, b in spans if b - a >= SHORTEST * rate]


def loud_ranges(samples: np.ndarray, rate: int) -> list[tuple[int, int]]:
    """The loud ranges of a whole buffer."""
    held = Loudness(rate)
    held.grow(samples)
    return held.ranges(rate)


def segment_end(length: int, speech: np.ndarray, rules: SegmentRules) -> int | None:
    """Where the segment of a buffer that begins with speech ends (rows of first and last sample), null while it goes on.

    Speech that fits into a segment ends it after a pause, and if it is short after a long one.  A buffer that is full ends in the middle of its widest
    gap, the first of equals, if that leaves half a second; else where it is full.
    """
    most, pad = rules.samples(rules.longest), rules.samples(rules.pad)
    end = min(length, int(speech[-1, 1]) + pad)
    silence = length - int(speech[-1, 1])
    needed = rules.samples(rules.pause if end >= rules.samples(rules.shortest) else rules.long_pause)
    if end <= most and silence >= min(needed, rules.samples(rules.long_pause)):
        return end
    if length < most:
        return None
    opens, closes = speech[:-1, 1], speech[1:, 0]
    early = opens < most
    width = (closes - opens)[early]
    if not len(width) or width.max() <= 0:
        return most
    widest = int(np.argmax(width))
    middle = min((int(opens[early][widest]) + int(closes[early][widest])) // 2, most)
    return middle if middle >= rules.sample_rate // 2 else most


class Ear:
    """The speech of one stream: what was heard and is not in a segment yet, and where that begins."""

    def __init__(self, rules: SegmentRules, find: Detector | None = None, samples: bytes = b"", start: int = 0, unseen: int = 0, levels: bytes = b""):
        self.rules, self.find, self.start, self.unseen = rules, find, start, unseen
        self.parts = [np.frombuffer(samples, np.float32)]
        self.length = len(self.parts[0])
        self.loudness = Loudness(rules.sample_rate, np.frombuffer(levels, np.float64).tolist())

    def saved(self) -> tuple[bytes, int, int, bytes]:
        return self._buffer().tobytes(), int(self.start), int(self.unseen), np.asarray(self.loudness.levels, np.float64).tobytes()

    def _buffer(self) -> np.ndarray:
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0]

    def _drop(self, count: int) -> None:
        self.parts = [self._buffer()[count:]]
        self.length, self.start = self.length - count, self.start + count
        self.loudness.shift(count)

    def _speech(self) -> list[tuple[int, int]]:
        """By the detector; by loudness where there is none or it fails."""
        buffer = self._buffer()
        if self.find:
            try:
                return list(self.find(buffer, self.rules.sample_rate))
            except Exception:  # a broken detector must not end a session
                pass
        self.loudness.grow(buffer)
        return self.loudness.ranges(self.rules.sample_rate)

    def hear(self, samples: np.ndarray) -> list[tuple[int, int]]:
        """Segments (absolute first sample, sample after the last) that end with this piece."""
        self.parts.append(np.asarray(samples, np.float32))
        self.length, self.unseen = self.length + len(samples), self.unseen + len(samples)
        if self.unseen < self.rules.samples(self.rules.check) and self.length < self.rules.samples(self.rules.longest):
            return []
        self.unseen, out = 0, []
        while self.length:
            speech, pad = self._speech(), self.rules.samples(self.rules.pad)
            if not speech:
                self._drop(max(0, self.length - 2 * pad))
                break
            lead = max(0, speech[0][0] - pad)
            self._drop(lead)
            end = segment_end(self.length, np.asarray(speech, np.int64) - lead, self.rules)
            if end is None:
                break
            out.append((self.start, self.start + end))
            self._drop(end)
        return out

    def finish(self) -> list[tuple[int, int]]:
        """The segment of the speech that is left at the end of the stream."""
        speech, pad = self._speech() if self.length else [], self.rules.samples(self.rules.pad)
        out = [(self.start + max(0, speech[0][0] - pad), self.start + min(self.length, speech[-1][1] + pad))] if speech else []
        self._drop(self.length)
        return out


class Line:
    """Pieces of a stream put in order by their offsets; those behind a gap wait, and pieces that were there before do not count."""

    def __init__(self, at: int = 0, waiting: Iterable[tuple[int, bytes]] = (), end: int | None = None):
        self.at, self.waiting, self.end = at, dict(waiting), end

    def put(self, offset: int, samples: np.ndarray, last: bool) -> list[np.ndarray]:
        """The pieces that are next now."""
        if last:
            self.end = offset + len(samples)
        if offset + len(samples) > self.at:
            self.waiting[offset] = max(self.waiting.get(offset, b""), samples.astype(np.float32).tobytes(), key=len)
        out = []
        while self.waiting and (first := min(self.waiting)) <= self.at:
            piece = np.frombuffer(self.waiting.pop(first), np.float32)[self.at - first :]
            out.append(piece)
            self.at += len(piece)
        return out

    @property
    def complete(self) -> bool:
        return self.end is not None and self.at >= self.end


SEGMENTS = "session string, start_sample long, end_sample long"
HEARD = "session string, kind string, start_sample long, end_sample long, reason string"
_EAR = "samples binary, start long, unseen long, levels binary"


def segments(frames: DataFrame, rules: SegmentRules | None = None, find: Detector | None = None) -> DataFrame:
    """Speech segments of streamed PCM frames (session, seq, samples array<float>, last boolean), which come in order.

    The state of a session is its buffer (bounded by the longest segment and one look), the levels of its frames, and where it
    begins; a frame marked last flushes it.
    """
    rules = rules or SegmentRules()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ear, out, last = Ear(rules, find, *(state.get if state.exists else ())), [], False
        for frame in pd.concat(list(batches)).sort_values("seq").itertuples():
            out += ear.hear(np.asarray(frame.samples, np.float32))
            last = last or bool(frame.last)
        if last:
            out += ear.finish()
        state.update(ear.saved())
        yield pd.DataFrame({"session": [key[0]] * len(out), "start_sample": [a for a, _ in out], "end_sample": [b for _, b in out]})

    return frames.groupBy("session").applyInPandasWithState(step, SEGMENTS, _EAR, "append", GroupStateTimeout.NoTimeout)


def listen(pieces: DataFrame, rules: SegmentRules | None = None, find: Detector | None = None, most_waiting: int = MOST_WAITING) -> DataFrame:
    """HEARD events of streamed pieces (session, offset, samples array<float>, last boolean) that arrive in any order.

    What was recorded before the session (the pre-roll) and what is live are pieces of one line of samples: the live ones begin
    where the pre-roll ends, and wait for it.  Each event is a `segment`, or a `status` with a reason: `ended`
    behind the last piece; `live_buffer_overflow` when more than `most_waiting` pieces wait for one before them.  That ends the session too,
    with the segment of what was heard, and later pieces do not count.  Pieces that come again do not count either.
    Pieces of one micro-batch are taken by offset.
    """
    rules = rules or SegmentRules()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (b"", 0, 0, b"", 0, [], None, False)
        ear, line, closed = Ear(rules, find, *held[:4]), Line(held[4], [tuple(x) for x in held[5]], held[6]), held[7]
        out: list[tuple] = []
        for piece in pd.concat(list(batches)).sort_values("offset", kind="stable").itertuples():
            if closed:
                break
            for samples in line.put(int(piece.offset), np.asarray(piece.samples, np.float32), bool(piece.last)):
                out += [("segment", a, b, None) for a, b in ear.hear(samples)]
            closed = line.complete or len(line.waiting) > most_waiting
            if closed:
                out += [("segment", a, b, None) for a, b in ear.finish()]
                out.append(("status", None, None, "ended" if line.complete else "live_buffer_overflow"))
                line.waiting = {}
        state.update((*ear.saved(), line.at, sorted(line.waiting.items()), line.end, closed))
        found = pd.DataFrame([(key[0], *x) for x in out], columns=[x.split()[0] for x in HEARD.split(", ")])
        yield found.astype({"start_sample": "Int64", "end_sample": "Int64"})

    return pieces.groupBy("session").applyInPandasWithState(step, HEARD, f"{_EAR}, at long, waiting array<struct<offset:bigint,samples:binary>>, end long, closed boolean", "append", GroupStateTimeout.NoTimeout)
