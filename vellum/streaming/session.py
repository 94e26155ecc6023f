"""Live sources of pushed audio, and the stateful chain from segments to numbered transcripts and events."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.operators.evaluation import Opener
from vellum.operators.files import carried

from .live import MAX_LAG

#: Pieces that one trigger takes, and characters of the text so far that a session keeps.
MOST_PIECES, KEPT_CHARS = 512, 1000
_RAW = "path string, modificationTime timestamp, length long, content binary"


def put_audio(spark: SparkSession, folder: str, session: str, seq: int, pcm: bytes, last: bool = False) -> None:
    """Land one piece of pushed 16-bit audio; a reader sees it whole or not at all.  An empty one is a byte, as readers pass over empty files.

    OSError for a piece that is there already, and for one behind the piece that ended the session.
    """
    jvm = spark.sparkContext._jvm
    end = "-end" if last else ""
    path, part = jvm.org.apache.hadoop.fs.Path(f"{folder}/{session}/{seq:012d}{end}.pcm"), jvm.org.apache.hadoop.fs.Path(f"{folder}/{session}/_{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for there in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{session}/{{{seq:012d},*-end}}*.pcm")) or ():
        number, _, ended = there.getPath().getName().removesuffix(".pcm").partition("-")
        if int(number) == seq:
            raise OSError(f"piece {seq} of session {session} is there already")
        if ended and seq > int(number):
            raise OSError(f"session {session} ended with piece {int(number)}")
    out = fs.create(part)
    out.write(bytearray(pcm or b"\0"))
    out.close()
    if fs.exists(path) or not fs.rename(part, path):
        fs.delete(part, False)
        raise OSError(f"piece {seq} of session {session} is there already")


def _floats(content: Column) -> Column:
    """Samples of 16-bit audio as floats in [-1, 1)."""

    @F.pandas_udf("array<float>")
    def read(s: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<i2", len(x) // 2).astype(np.float32) / np.float32(32768) for x in s])

    return read(content)


def pushed_frames(spark: SparkSession, folder: str, most_pieces: int = MOST_PIECES) -> DataFrame:
    """Landed pieces as a stream of frames (session, seq, samples, last); pieces wait as files, so none is lost when readers lag."""
    raw = spark.readStream.format("binaryFile").schema(_RAW).option("pathGlobFilter", "*.pcm").option("maxFilesPerTrigger", most_pieces).load(f"{folder}/*")
    name = "/([^/]+)/(\\d+)(-end)?\\.pcm$"
    return raw.select(
        F.regexp_extract("path", name, 1).alias("session"), F.regexp_extract("path", name, 2).cast("long").alias("seq"), _floats(F.col("content")).alias("samples"), (F.regexp_extract("path", name, 3) != "").alias("last"),
    )


EVENTS = "session string, id long, kind string, sequence long, wall_start double, wall_end double, text string"


def transcripts(segments: DataFrame, open_model: Opener, prompt: str | None = None, carry: int = 200, most_lag: float = MAX_LAG, clock: Callable[[], float] = time.time) -> DataFrame:
    """Events of streamed segments (session, seq, queued, wall_start, wall_end, samples), in order of seq.

    Kinds: `transcript` with the next sequence number; `dropped` for a segment that waited too long; `error`, with
    the kind of failure as text, for one that the model failed on.  Segments without text give no event.
    Every event has the session's next id, so readers resume behind the last one they saw.  The
    state of a session is these two numbers and the end of the text so far, which the model gets with the prompt.
    """
    held: list = []

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, last_id, so_far = state.get if state.exists else (0, 0, "")
        out: list[tuple] = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            kind, sequence, text = "dropped", None, None
            if clock() - r.queued <= most_lag:
                if not held:
                    held.append(open_model())
                try:
                    text = (held[0](np.asarray(r.samples, np.float32), carried(prompt, so_far, carry)) or "").strip()
                except Exception as e:  # one bad segment must not end the session
                    kind, text = "error", type(e).__name__
                else:
                    if not text:
                        continue
                    number += 1
                    kind, sequence, so_far = "transcript", number, f"{so_far} {text}"[-KEPT_CHARS:]
            last_id += 1
            out.append((key[0], last_id, kind, sequence, r.wall_start, r.wall_end, text))
        state.update((number, last_id, so_far))
        found = pd.DataFrame(out, columns=[x.split()[0] for x in EVENTS.split(", ")])
        yield found.astype({"sequence": "Int64"})

    return segments.groupBy("session").applyInPandasWithState(step, EVENTS, "number long, last_id long, so_far string", "append", GroupStateTimeout.NoTimeout)
