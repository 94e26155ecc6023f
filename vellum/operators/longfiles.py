"""Audio files of any length by name: headers, pauses and chunks are read by byte range, so no file is ever one row.

A file's chunks follow one another in one task, as a chunk's prompt is the text of the one before; the task holds the
samples of one chunk and the text so far that the prompt needs.  Several models can run over one pass of the samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.sources import byname

from . import jobs, metrics
from .files import Speech, carried, pause

#: Opens a model in a task; it takes samples and a prompt and returns a text, or a text and its segments (first second, last second, text) within the chunk.
LongOpener = Callable[[], Callable[[np.ndarray, str | None], Any]]
RESULTS = "job {id}, model string, index int, start double, end double, text string, language string, segments array<struct<start:double,end:double,text:string>>"


def media(files: DataFrame, root: str, open_file: byname.OpenFile = byname.open_path) -> DataFrame:
    """Files (id, path) with rate and num_samples from their headers; both null where there is no file or it is not 16-bit mono WAV."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                try:
                    f = open_file(byname.below(root, path))
                    rate, _, n = byname.wav_place(f)
                    f.close()
                    found.append((rate, n))
                except (FileNotFoundError, ValueError):
                    found.append((None, None))
            yield batch.assign(rate=pd.array([r for r, _ in found], "Int32"), num_samples=pd.array([n for _, n in found], "Int64"))

    return files.select("id", "path").mapInPandas(run, f"id {dict(files.dtypes)['id']}, path string, rate int, num_samples long")


def pauses(found: DataFrame, root: str, chunk_seconds: float, rate: int, speech: Speech | None = None, window: float | None = None, open_file: byname.OpenFile = byname.open_path) -> DataFrame:
    """Where a pause lies in the window around each boundary (id, boundary, offset) of `media`; only the windows are read, each a row of its own."""
    window = jobs.snap_window(chunk_seconds) if window is None else window
    half = min(round(window * rate), (round(chunk_seconds * rate) - 1) // 2)
    cuts = jobs.boundaries(found.select("id", "path", "num_samples"), chunk_seconds, rate)
    rows = cuts.select("id", "path", "boundary", F.greatest(F.lit(0), F.col("boundary") - half).alias("a"), F.least(F.col("num_samples"), F.col("boundary") + half).alias("b"))
    if not half:
        return rows.select("id", "boundary", F.lit(None).cast("long").alias("offset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = [None if x is None else pause(np.asarray(x, np.float32), rate, speech) for x in batch["samples"]]
            yield pd.DataFrame({"id": batch["id"], "boundary": batch["boundary"], "offset": pd.array(at, "Int64")})

    read = byname.read_samples(rows, root, "path", "a", "b", open_file=open_file)
    return read.mapInPandas(run, f"id {dict(found.dtypes)['id']}, boundary long, offset long")


def transcribed(
    files: DataFrame, root: str, models: dict[str, LongOpener], chunk_seconds: float = 60.0, rate: int = 16_000, prompt: str | None = None, carry: int = 200,
    speech: Speech | None = None, language: str | None = None, window: float | None = None, open_file: byname.OpenFile = byname.open_path,
) -> tuple[DataFrame, DataFrame]:
    """Results of every model for every chunk of files (id, path), and each model's text of each file (job, model and the columns of `jobs.assemble`).

    Files with another rate than `rate`, or that cannot be read, have no chunks.
    """
    sized = media(files, root, open_file).where(F.col("rate") == rate)
    plan = jobs.plan_chunks(sized.select("id", "num_samples"), chunk_seconds, rate, pauses(sized, root, chunk_seconds, rate, speech, window, open_file), window)
    rows = plan.join(sized.select("id", "path"), "id").repartition("id").sortWithinPartitions("id", "index")
    names = sorted(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, now, f, first, before = None, object(), None, 0, {}
        for batch in batches:
            opened = opened or {name: models[name]() for name in names}
            for c in batch.itertuples():
                if c.id != now:
                    now, f, before = c.id, open_file(byname.below(root, c.path)), dict.fromkeys(names)
                    first = byname.wav_place(f)[1]
                f.seek(first + 2 * c.start_sample)
                samples = np.frombuffer(f.read(2 * (c.end_sample - c.start_sample)), "<i2").astype(np.float32) / np.float32(32768)
                out = []
                for name in names:
                    said = opened[name](samples, carried(prompt, before[name], carry))
                    text, segments = said if isinstance(said, tuple) else (said, [])
                    before[name] = text or ""
                    shifted = [{"start": c.start + a, "end": c.start + b, "text": t} for a, b, t in segments]
                    out.append((c.id, name, c.index, c.start, c.end, before[name], language, shifted))
                yield pd.DataFrame(out, columns=["job", "model", "index", "start", "end", "text", "language", "segments"])

    results = rows.mapInPandas(run, RESULTS.format(id=dict(files.dtypes)["id"]))
    each = F.explode(F.array(*(F.lit(n) for n in names)))
    return results, texts(plan.select(F.col("id").alias("job"), each.alias("model"), "index"), results)


def texts(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Each model's text of each file (job, model and the columns of `jobs.assemble`) from the chunks that there should be (job, model, index)."""
    key = F.struct("job", "model").alias("job")
    whole = jobs.assemble(wanted.select(key, "index"), results.select(key, "index", "text", "language", "model"))
    return whole.select("job.job", "job.model", *(c for c in whole.columns if c != "job"))


def longform(
    files: DataFrame, root: str, references: DataFrame, open_candidate: LongOpener, open_baseline: LongOpener, folder: str, tolerance: float = 0.02, rate: int = 16_000, **options
) -> DataFrame:
    """Two models over one pass of each file (id, path), against a reference text (id, reference): a row a file.

    The chunks' results are written to `folder` first, so the models run once.  Columns id, candidate and baseline (structs of wer, words and the sanity of timestamps) and reasons (array, empty if the
    candidate is no worse, null if the baseline found no speech, so that there is nothing to compare with).
    """
    found, _ = transcribed(files, root, {"candidate": open_candidate, "baseline": open_baseline}, rate=rate, **options)
    found.write.parquet(folder)
    results = files.sparkSession.read.schema(found.schema).parquet(folder)
    whole = texts(results.select("job", "model", "index"), results)
    pairs = whole.select(F.col("job").alias("id"), "model", F.col("text").alias("hypothesis")).join(references.select("id", "reference"), "id")
    rates = metrics.metrics(pairs, ["id", "model"]).select("id", "model", "wer")
    words = pairs.select("id", "model", F.size(F.filter(F.split("hypothesis", "\\s+"), lambda w: w != "")).alias("words"))
    said = results.select(F.col("job").alias("id"), "model", "index", F.col("end").alias("_until"), F.posexplode_outer("segments").alias("k", "s"))
    ends = results.groupBy(F.col("job").alias("id")).agg(F.max("end").alias("seconds"))
    segments = said.where("s is not null").select("id", "model", "index", "k", "s.start", "s.end").join(ends, "id")
    sanity = metrics.timestamp_sanity(segments, ["id", "model"], ["index", "k"], F.max("seconds"))
    each = rates.join(words, ["id", "model"]).join(sanity, ["id", "model"], "left").na.fill(0, ["n_segments", "order_violations"]).na.fill(0.0, ["long_segment_fraction", "coverage", "segments_per_minute"])
    pack = F.struct("wer", "words", "n_segments", "order_violations", "long_segment_fraction", "coverage", "segments_per_minute")
    both = each.groupBy("id").agg(*(F.max(F.when(F.col("model") == m, pack)).alias(m) for m in ("candidate", "baseline")))
    return both.withColumn("reasons", F.when(F.col("baseline.n_segments") > 0, metrics.regressions("candidate", "baseline", tolerance)))
