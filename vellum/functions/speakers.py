"""Speaker identifiers: pseudonyms, buckets and splits as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000
SPLITS = ("train", "dev", "test")


def hash_speaker(identifier: Column, salt: str) -> Column:
    """First 24 hex digits of the keyed SHA-256 (HMAC) of an identifier."""
    key = salt.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), identifier.cast("string").cast("binary")), 256))
    return F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 24)


def resolve_speaker(value: Column, salt: str | None) -> tuple[Column, Column]:
    """The stored speaker of a listed value (VARIANT), and why a value was dropped (or null).

    Integers and strings of up to 18 digits are raw account ids: a pseudonym with
    a salt, dropped without.  Strings with an @ are dropped, others kept trimmed.
    """
    kind = F.schema_of_variant(value)
    text = F.trim(F.try_variant_get(value, "$", "string"))
    number = (kind == "BIGINT") | (kind == "STRING") & text.rlike("^[0-9]{1,18}$")
    word = (kind == "STRING") & (text != "")
    address = word & text.contains("@")
    kept = F.when(number, hash_speaker(text, salt) if salt else F.lit(None).cast("string")).when(word & ~address, text)
    reason = F.when(value.isNull() | (kind == "VOID"), None).when(number, F.lit(None if salt else "raw_speaker_id_dropped")).when(address, "speaker_id_email_dropped").when(kind != "STRING", "speaker_id_invalid")
    return kept, reason


def split_salt(seed: int, prefix: str = "speaker-split-v1") -> str:
    """The text that splits depend on; give the prefix that earlier splits were made with to go on with them."""
    return f"{prefix}:{seed}"


def speaker_bucket(speaker: Column, salt: str) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), speaker.cast("string")), 256), 1, 8), 16, 10).cast("long") % BUCKETS


def validated_ratios(ratios: dict[str, float]) -> dict[str, float]:
    """Ratios of exactly the three splits, none negative; train takes what is left, so they need not add up to 1."""
    if set(ratios) != set(SPLITS):
        raise ValueError(f"split ratios need exactly {', '.join(SPLITS)}")
    if any(r < 0 for r in ratios.values()):
        raise ValueError("split ratios must not be negative")
    return ratios


def speaker_split(speaker: Column, ratios: dict[str, float], seed: int = 42, prefix: str = "speaker-split-v1") -> Column:
    """The split of a speaker's rows; rows without a speaker are for training."""
    ratios = validated_ratios(ratios)
    dev = round(ratios["dev"] * BUCKETS)
    test = dev + round(ratios["test"] * BUCKETS)
    b = speaker_bucket(speaker, split_salt(seed, prefix))
    return F.when(F.nullif(speaker.cast("string"), F.lit("")).isNull(), "train").when(b < dev, "dev").when(b < test, "test").otherwise("train")
