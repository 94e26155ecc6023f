"""Times and cue text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No space before the first kind, none after the second.
CLOSING, OPENING = ".,!?;:%)]}»”", "([{«“"


def _ms(seconds: Column) -> Column:
    return F.greatest(F.lit(0), F.bround(seconds.cast("double") * 1000).cast("long"))


def format_timestamp(seconds: Column, decimal: str = ".") -> Column:
    """HH:MM:SS.mmm, hours without bound, half milliseconds to even."""
    ms = _ms(seconds)
    return F.format_string(f"%02d:%02d:%02d{decimal}%03d", F.expr("0L") + F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_ms(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_millis(F.bround(epoch_seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def wall_time(sample: Column, anchor_sample: Column, anchor_wall: Column, sample_rate: int) -> Column:
    return anchor_wall + (sample - anchor_sample) / F.lit(sample_rate)


def caption_stamp(start: Column, seconds: Column) -> Column:
    """Absolute UTC time of a cue, milliseconds cut, without offset."""
    return F.date_format(F.timestamp_micros(F.unix_micros(start) + _ms(seconds) * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def repair_offset(value: Column) -> Column:
    """A plus sign that was read as a space, before a zone offset at the end."""
    return F.regexp_replace(F.trim(value), " (\\d\\d:\\d\\d)$", "+$1")


def parse_start_time(value: Column) -> Column:
    """An ISO-8601 time; without zone it is UTC (the session's zone must be UTC); null when not a time."""
    return F.try_to_timestamp(F.trim(value))


def parse_duration(value: Column) -> Column:
    """A positive finite number of seconds, else null."""
    d = value.try_cast("double")
    return F.when((d > 0) & ~F.isnan(d) & (d < float("inf")), d)


def join_words(words: str) -> Column:
    """Tokens (an array column of strings) joined, without spaces around punctuation that takes none."""
    fold = f"""aggregate(transform({words}, x -> trim(x)), '', (t, x) ->
        CASE WHEN x is null or x = '' THEN t WHEN t = '' THEN x
             WHEN instr('{CLOSING}', left(x, 1)) > 0 OR instr('{OPENING}', right(t, 1)) > 0 THEN concat(t, x)
             ELSE concat(t, ' ', x) END)"""
    return F.expr(fold)


def split_lines(text: str, most: int) -> Column:
    """Words wrapped to at most two lines of `most` characters; what is left over stays on the second."""
    fold = f"""aggregate(filter(split(trim(regexp_replace({text}, '(?U)\\\\s+', ' ')), ' '), x -> x <> ''),
        named_struct('a', '', 'b', '', 'n', 0),
        (s, w) -> CASE
            WHEN s.n = 0 THEN named_struct('a', w, 'b', '', 'n', 1)
            WHEN s.n = 1 AND length(s.a) < {most} AND length(s.a) + 1 + length(w) <= {most} THEN named_struct('a', concat(s.a, ' ', w), 'b', '', 'n', 1)
            WHEN s.n = 1 THEN named_struct('a', s.a, 'b', w, 'n', 2)
            ELSE named_struct('a', s.a, 'b', concat(s.b, ' ', w), 'n', 2) END,
        s -> if(s.n = 2, concat(s.a, '\\n', s.b), s.a))"""
    return F.expr(fold)
