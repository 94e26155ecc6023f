"""Text normalisation, hashes and edit distances as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the four separators below it.
_SPACES = "(?U)[\\s\\x1c-\\x1f]+"


def nfc(text: Column) -> Column:
    """Canonical composition, which Spark has no function for; only texts that are not ASCII are sent to Python."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return F.coalesce(compose(F.when(F.length(text) != F.octet_length(text), text)), text)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def normalize_text(text: Column) -> Column:
    """Composed, written-out line breaks and all white space as single spaces, trimmed; null stays null."""
    return collapsed(F.replace(nfc(text), F.lit("\\n"), F.lit(" ")))


def normalize_for_wer(text: Column) -> Column:
    """For error rates: composed, lower case, punctuation and symbols as spaces; null is empty."""
    return collapsed(F.regexp_replace(F.lower(nfc(F.coalesce(text, F.lit("")))), "[\\p{P}\\p{S}]", " "))


def text_hash(text: Column, composed: bool = False) -> Column:
    """SHA-256 of the composed text; `composed` says that it is so already, as what `normalize_text` returns is."""
    return F.sha2(text if composed else nfc(text), 256)


def words_of(text: Column) -> Column:
    """Words between single spaces; none for the empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def _distance(a: list, b: list) -> int:
    """Levenshtein distance by bit vectors: a column of the table is one integer each for rises and falls."""
    if not a or not b:
        return len(a) + len(b)
    n = len(a)
    where: dict = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    rise, fall, score = full, 0, n
    for y in b:
        match = where.get(y, 0)
        diagonal = (((match & rise) + rise) ^ rise) | match | fall
        up = fall | ~(diagonal | rise) & full
        down = rise & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        rise = (down | ~(diagonal | up)) & full
        fall = up & diagonal
    return score


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance between two arrays of words."""

    @F.pandas_udf("int")
    def distances(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return distances(reference, hypothesis)


def rounded(number: Column | str, places: int) -> Column:
    """Rounded as SQL engines round doubles: the double times a power of ten, to the nearest whole number, halves away from zero.

    `F.round` takes the shortest decimal that reads back as the double, so it rounds 0.51155 up, though the double times 10,000 is below 5115.5.
    """
    x = (F.col(number) if isinstance(number, str) else number).cast("double")
    scale = float(10**places)
    near = F.round(x * scale) / scale
    return F.when(F.abs(near) < float("inf"), near).otherwise(x)


def rate(edits: Column, length: Column) -> Column:
    """Edits for each unit of the reference, to six places; null for an empty reference."""
    return rounded(F.try_divide(edits.cast("double"), F.nullif(length, F.lit(0))), 6)


def relative_improvement(candidate: Column, baseline: Column) -> Column:
    return F.when(candidate.isNotNull() & (baseline != 0), rounded((baseline - candidate) / baseline, 6))


def carry_prompt(prompt: Column, previous: Column, most: int) -> Column:
    """The user's prompt and the end of the previous text, cut at a word; null if both are empty."""
    text = F.trim(F.coalesce(previous, F.lit("")))
    tail = F.right(text, F.lit(most))
    cut_inside = (F.length(text) > most) & ~F.substring(F.right(text, F.lit(most + 1)), 1, 1).rlike("\\s")
    tail = F.trim(F.when(cut_inside, F.regexp_replace(tail, "^\\S+\\s?", "")).otherwise(tail))
    return F.nullif(F.concat_ws(" ", F.nullif(F.trim(F.coalesce(prompt, F.lit(""))), F.lit("")), F.nullif(tail, F.lit(""))), F.lit(""))


def safe_name(name: Column) -> Column:
    """A base name of plain characters, at most its last 100; names that systems reserve get a prefix."""
    base = F.regexp_extract(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "([^/]*)/*$", 1)
    plain = F.right(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", ""), F.lit(100))
    plain = F.when(plain == "", "upload").otherwise(plain)
    return F.when(plain.rlike("(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\\.|$)"), F.concat(F.lit("_"), plain)).otherwise(plain)


def scrubbed(text: Column, secrets: list[str], most: int = 300) -> Column:
    """Text without secrets, white space collapsed, cut."""
    for s in secrets:
        if s:
            text = F.replace(text, F.lit(s), F.lit("***"))
    return F.left(collapsed(text), F.lit(most))


def described(kind: Column, message: Column, most: int = 300) -> Column:
    return F.left(F.concat_ws(": ", kind, message), F.lit(most))


def base_names(text: Column) -> Column:
    """Server paths in a text as their base names."""
    return F.regexp_replace(text, "(?:/[^\\s/:]+)+/([^\\s/:]+)", "$1")


def host_allowed(url: Column, hosts: list[str], schemes: tuple[str, ...] = ("http", "https")) -> Column:
    """Whether a URL has an allowed scheme, no credentials, and a host that one of the globs matches."""
    import re

    globs = "|".join("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in h.lower()) for h in hosts)
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    good = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin(*schemes) & F.try_parse_url(url, F.lit("USERINFO")).isNull() & host.rlike(f"^(?:{globs})$" if hosts else "$^")
    return F.coalesce(good, F.lit(False))
