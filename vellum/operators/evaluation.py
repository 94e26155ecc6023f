"""The seam to a model: transcripts of audio rows or chunks by a function that each task opens once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import carry_prompt

from . import metrics

#: Opens a model in a task and returns what transcribes float samples (and a prompt) to text.
Opener = Callable[[], Callable[[np.ndarray, str | None], str]]


def with_hypotheses(rows: DataFrame, open_model: Opener, samples: str = "samples", prompt: str | None = None) -> DataFrame:
    """Rows with a column hypothesis; the samples are dropped after use, so they do not travel on."""
    kept = [f for f in rows.schema.fields if f.name != samples]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "hypothesis string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transcribe = None
        for batch in batches:
            transcribe = transcribe or open_model()
            prompts = batch[prompt] if prompt else [None] * len(batch)
            texts = [None if x is None else transcribe(np.asarray(x, np.float32), p) or "" for x, p in zip(batch[samples], prompts, strict=True)]
            yield batch.drop(columns=[samples]).assign(hypothesis=texts)

    return rows.mapInPandas(run, schema)


def chunk_prompts(chunks: DataFrame, prompt: Column, most: int) -> DataFrame:
    """Chunks (job, index, text) with the prompt that the model would get: the user's and the end of the text before."""
    from .jobs import previous_texts

    return previous_texts(chunks).withColumn("prompt", carry_prompt(prompt, F.col("previous_text"), most))


def evaluated(rows: DataFrame, open_model: Opener, rate: int = 16_000) -> tuple[DataFrame, DataFrame]:
    """Metrics of the rows (samples, reference, speaker_id), and their table by speaker."""
    records = with_hypotheses(rows.withColumn("audio_seconds", F.size("samples") / rate), open_model)
    return metrics.metrics(records), metrics.per_speaker(records)


def tagged(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows of two models on the same split, one after the other."""
    return candidate.withColumn("model", F.lit("candidate")).unionByName(baseline.withColumn("model", F.lit("baseline")))


def gate(scores: DataFrame, least: float, longform: DataFrame | None = None, require_longform: bool = False) -> DataFrame:
    """One row from metrics by model (candidate, baseline): rates, improvement, checks and verdict.

    `longform` has one row with an array of reasons (`regressions`), empty when nothing got worse.
    """
    pivot = scores.groupBy().pivot("model", ["candidate", "baseline"]).agg(F.first("wer"))
    row = pivot.join(longform.select(F.size("regressions").alias("_n")), F.lit(True), "left") if longform is not None else pivot.withColumn("_n", F.lit(None).cast("int"))
    beats = metrics.beats_baseline(F.col("candidate"), F.col("baseline"), F.lit(least))
    long = metrics.longform_check(F.coalesce(F.col("_n") > 0, F.lit(False)), F.col("_n").isNotNull(), F.lit(require_longform))
    from vellum.functions.text import relative_improvement

    return row.select(
        "candidate", "baseline", relative_improvement(F.col("candidate"), F.col("baseline")).alias("relative_wer_improvement"),
        F.array(F.struct(F.lit("beats_baseline").alias("name"), beats.alias("passed")), F.struct(F.lit("longform").alias("name"), long.alias("passed"))).alias("checks"), metrics.verdict(beats, long).alias("passed"),
    )


def rendered(gates: DataFrame) -> DataFrame:
    """The gate rows with printable text: a mark for each check and the verdict."""
    mark = lambda p: F.when(p.isNull(), "SKIP").when(p, "PASS").otherwise("FAIL")
    number = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("n/a"))
    checks = F.array_join(F.transform("checks", lambda c: F.concat(F.lit("["), mark(c["passed"]), F.lit("] "), c["name"])), "\n")
    return gates.withColumn("text", F.concat(F.lit("WER "), number("candidate"), F.lit(" against "), number("baseline"), F.lit("\n"), checks, F.lit("\nGate: "), F.when(F.col("passed"), "PASSED").otherwise("FAILED")))
