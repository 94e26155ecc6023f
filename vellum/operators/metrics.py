"""Error rates of stored transcripts, their spread over speakers, timing checks and the promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

MIN_SPEAKER_SECONDS = 30.0
LONG_SECONDS, OVERLAP_SECONDS = 25.0, 0.05
LONG_GROWTH, COVERAGE_DROP = 0.05, 0.10


def with_edits(pairs: DataFrame) -> DataFrame:
    """Edits and lengths, in words and characters, of reference and hypothesis, normalised (n_) and as they are (r_)."""
    plain = pairs.withColumns({
        "_nr": T.normalize_for_wer(F.col("reference")), "_nh": T.normalize_for_wer(F.col("hypothesis")),
        "_rr": T.collapsed(F.coalesce("reference", F.lit(""))), "_rh": T.collapsed(F.coalesce("hypothesis", F.lit(""))),
    })
    out = {}
    for k in "nr":
        a, b = F.col(f"_{k}r"), F.col(f"_{k}h")
        out |= {f"{k}_word_edits": T.word_distance(T.words_of(a), T.words_of(b)), f"{k}_words": F.size(T.words_of(a)), f"{k}_char_edits": F.levenshtein(a, b), f"{k}_chars": F.length(a)}
    return plain.withColumns(out).drop("_nr", "_nh", "_rr", "_rh")


def error_rate(edits: str, length: str) -> Column:
    """A ratio of sums, never a mean of ratios; null without reference."""
    return T.rate(F.sum(edits), F.sum(length))


def metrics(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    rows = with_edits(pairs)
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("reference_words"), error_rate("n_word_edits", "n_words").alias("wer"),
        error_rate("n_char_edits", "n_chars").alias("cer"), error_rate("r_word_edits", "r_words").alias("wer_raw"), error_rate("r_char_edits", "r_chars").alias("cer_raw"),
    )


def per_speaker(records: DataFrame, least_seconds: float = MIN_SPEAKER_SECONDS) -> DataFrame:
    """WER, utterances, words and seconds of each speaker; little audio is marked."""
    rows = with_edits(records.where(F.nullif("speaker_id", F.lit("")).isNotNull()))
    seconds = F.coalesce(F.sum("audio_seconds"), F.lit(0.0))
    return rows.groupBy("speaker_id").agg(error_rate("n_word_edits", "n_words").alias("wer"), F.count(F.lit(1)).alias("utterances"), F.sum("n_words").alias("reference_words"), T.rounded(seconds, 3).alias("audio_seconds"), (seconds < least_seconds).alias("low_audio"))


def spread(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Number, minimum, median, 90th percentile (linear) and maximum."""
    return rows.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.9).alias("p90"), F.max(value).alias("max"))


def speaker_spread(speakers: DataFrame, unattributed: int = 0) -> DataFrame:
    """One row on a per-speaker table: counts, and the spread over all and over those with enough audio."""
    reliable = F.when(~F.col("low_audio"), F.col("wer"))
    stats = lambda c, p: [F.min(c).alias(f"{p}_min"), F.percentile(c, 0.5).alias(f"{p}_median"), F.percentile(c, 0.9).alias(f"{p}_p90"), F.max(c).alias(f"{p}_max")]
    return speakers.agg(F.count(F.lit(1)).alias("n_speakers"), F.count_if("low_audio").alias("n_low_audio"), F.lit(unattributed).alias("unattributed_utterances"), *stats(F.col("wer"), "wer"), *stats(reliable, "reliable"))


def timestamp_sanity(segments: DataFrame, by: list[str], order: list[str], duration: Column, long_seconds: float = LONG_SECONDS) -> DataFrame:
    """Order violations, share of long segments, coverage of the last segment and segments a minute, for each group.

    `duration` is an aggregate expression for the seconds of the group's audio.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    last_end = F.lag("end", 1, 0.0).over(w)
    rows = segments.withColumns({"_bad": (F.col("end") < F.col("start")) | (F.col("start") < last_end - OVERLAP_SECONDS), "_at": F.struct(*order), "_long": F.col("end") - F.col("start") >= long_seconds})
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_segments"), F.count_if("_bad").alias("order_violations"), F.count_if("_long").alias("_longs"), F.max_by("end", "_at").alias("_last"), duration.alias("_seconds"))
    some = F.col("_seconds") > 0
    return g.select(
        *by, "n_segments", "order_violations", T.rounded(F.col("_longs") / F.col("n_segments"), 6).alias("long_segment_fraction"),
        F.when(some, T.rounded(F.col("_last") / F.col("_seconds"), 4)).otherwise(0.0).alias("coverage"), F.when(some, T.rounded(F.col("n_segments") / (F.col("_seconds") / 60), 3)).otherwise(0.0).alias("segments_per_minute"),
    )


def regressions(c: str = "candidate", b: str = "baseline", tolerance: float = 0.02) -> Column:
    """Reasons (array) why the candidate's structs of wer and sanity are worse than the baseline's."""
    f = lambda side, name: F.col(f"{side}.{name}")
    delta = T.rounded(f(c, "wer") - f(b, "wer"), 6)
    grown = f(c, "long_segment_fraction") - f(b, "long_segment_fraction")
    checks = F.array(
        F.when(delta > tolerance, "wer"),
        F.when(f(c, "order_violations") > f(b, "order_violations"), "order_violations"),
        F.when((f(c, "long_segment_fraction") > 2 * f(b, "long_segment_fraction")) & (grown >= LONG_GROWTH), "long_segments"),
        F.when(f(b, "coverage") - f(c, "coverage") > COVERAGE_DROP, "coverage"),
    )
    return F.filter(checks, lambda x: x.isNotNull())


def beats_baseline(candidate: Column, baseline: Column, least: Column) -> Column:
    """Strictly below the baseline less the wanted improvement; undefined rates fail."""
    return F.coalesce(candidate < T.rounded(baseline * (1 - least), 6), F.lit(False))


def longform_check(regression: Column, present: Column, required: Column) -> Column:
    """Null (skipped) when absent and not required, false when absent but required, else no regression."""
    return F.when(present, ~regression).when(required, F.lit(False))


def verdict(*checks: Column) -> Column:
    """Whether all checks that are not null hold; true without any."""
    return F.forall(F.filter(F.array(*checks), lambda x: x.isNotNull()), lambda x: x)


def check_line(name: str, passed: Column, detail: Column) -> Column:
    return F.concat_ws(" ", F.when(passed.isNull(), "SKIP").when(passed, "PASS").otherwise("FAIL"), F.lit(name), detail)
