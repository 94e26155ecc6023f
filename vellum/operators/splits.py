"""Versioned dataset builds: split by speaker, transcript-leakage guard, figures and version."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.speakers import SPLITS, speaker_split, split_salt


def with_split(rows: DataFrame, ratios: dict[str, float], seed: int = 42, speaker: str = "speaker_id") -> DataFrame:
    return rows.withColumn("split", speaker_split(F.col(speaker), ratios, seed))


def guarded(rows: DataFrame) -> DataFrame:
    """Rows of a split table without the training rows whose text_hash a dev or test row has too (a null hash counts as equal)."""
    train, rest = rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train")
    seen = rest.select(F.col("text_hash").alias("_seen")).distinct()
    return train.join(seen, F.col("text_hash").eqNullSafe(F.col("_seen")), "left_anti").unionByName(rest)


def split_sizes(rows: DataFrame) -> DataFrame:
    """One row: rows of each split, zero where there are none."""
    return rows.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])


def speakers_per_split(rows: DataFrame) -> DataFrame:
    speaker = F.nullif(F.col("speaker_id").cast("string"), F.lit(""))
    return rows.agg(*[F.countDistinct(F.when(F.col("split") == s, speaker)).alias(f"{s}_speakers") for s in SPLITS])


def speaker_disjoint(rows: DataFrame) -> DataFrame:
    """One row: whether no speaker is in two splits; true without speakers."""
    each = rows.where(F.nullif(F.col("speaker_id").cast("string"), F.lit("")).isNotNull()).groupBy("speaker_id").agg((F.min("split") == F.max("split")).alias("one"))
    return each.agg(F.coalesce(F.every("one"), F.lit(True)).alias("speaker_disjoint"))


def leakage_stats(rows: DataFrame) -> DataFrame:
    """One row of figures on what the guard drops from a split table."""
    kept = guarded(rows).where(F.col("split") == "train")
    speaker = F.nullif(F.col("speaker_id").cast("string"), F.lit(""))
    before = rows.where(F.col("split") == "train").agg(F.count(F.lit(1)).alias("train_before"), F.countDistinct(speaker).alias("speakers_before"))
    after = kept.agg(F.count(F.lit(1)).alias("train_after"), F.countDistinct("text_hash").alias("train_distinct_transcripts"), F.countDistinct(speaker).alias("speakers_after"))
    both = before.join(after, F.lit(True))  # two single rows
    dropped = F.col("train_before") - F.col("train_after")
    return both.select(
        F.col("train_before").alias("train_rows_before"), dropped.alias("train_dropped"), F.coalesce(F.try_divide(dropped.cast("double"), F.nullif("train_before", F.lit(0))), F.lit(0.0)).alias("dropped_fraction"),
        "train_distinct_transcripts", (F.col("speakers_before") - F.col("speakers_after")).alias("train_speakers_lost"),
    )


def check_build(stats: DataFrame, sizes: DataFrame, most_dropped: float | None = None) -> None:
    """Raise ValueError when the guard drops more than allowed or a split is empty."""
    s = stats.first()
    if most_dropped is not None and s.dropped_fraction > most_dropped:
        raise ValueError(f"dropped {s.train_dropped} of {s.train_rows_before} training rows for transcript overlap")
    if empty := [name for name, n in sizes.first().asDict().items() if not n]:
        raise ValueError(f"splits without rows: {', '.join(empty)}")


def dataset_version(rows: DataFrame, ratios: dict[str, float], seed: int = 42, most: int = 20_000_000) -> str:
    """First 16 hex digits of the SHA-256 of the canonical JSON of all rows in order and the split settings.

    One digest over all bytes cannot be merged from parts, so the rows (identifiers and hashes, no
    transcripts) stream to the driver in order, a partition at a time.  It is therefore for manifests of up to
    `most` rows and raises ValueError beyond; the JSON is never built as a whole.
    """
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a version by one digest is for at most {most} rows")
    digest = hashlib.sha256(b'{"rows":[')
    ordered = rows.select("recording_id", "text_hash", "audio_sha256", "speaker_id").orderBy("recording_id")
    for k, row in enumerate(ordered.toLocalIterator()):
        digest.update((b"," if k else b"") + json.dumps(list(row), separators=(",", ":")).encode())
    tail = json.dumps({"split": {"ratios": ratios, "salt": split_salt(seed)}, "v": 1}, sort_keys=True, separators=(",", ":"))
    digest.update(b"]," + tail[1:].encode())
    return digest.hexdigest()[:16]


def manifest(rows: DataFrame) -> DataFrame:
    """What is recorded of each row of a build: no transcript."""
    return rows.select("recording_id", "speaker_id", "split", "audio_sha256", "text_hash", "duration")
