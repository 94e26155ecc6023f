"""The ledger of recordings: diff of a listing against it, and the new tables that follow.

Every change is a function of the old table and the delta.  On plain files the
result is written as a new version; with a transactional format the same plans are a MERGE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SECONDS, MAX_SECONDS = 0.5, 30.0
MASS_ROWS, MASS_FRACTION = 5, 0.5
LEDGER = (
    "recording_id long, corpus_id long, speaker_id string, text string, text_hash string, audio_sha256 string, audio_path string, "
    "duration double, quality_score double, validated_at string, status string, first_seen string, last_seen string, removed_at string"
)
CONTENT = ("speaker_id", "text", "text_hash", "audio_sha256", "audio_path", "duration", "quality_score", "validated_at")
REJECTED = "recording_id long, corpus_id long, reason string, audio_path string, first_seen string"


class MassRemoval(RuntimeError):
    """A listing lacks so many active rows that it is more likely broken."""


def active(ledger: DataFrame, corpus_id: int | None = None) -> DataFrame:
    rows = ledger.where(F.col("status") == "active")
    return rows if corpus_id is None else rows.where(F.col("corpus_id") == corpus_id)


def recording(ledger: DataFrame, recording_id: int) -> DataFrame:
    """The row of one recording, whatever its status; a filter that a sorted or bucketed ledger prunes by."""
    return ledger.where(F.col("recording_id") == recording_id)


def rejection(rejected: DataFrame, recording_id: int) -> DataFrame:
    return rejected.where(F.col("recording_id") == recording_id)


def rejected_ids(rejected: DataFrame, corpus_id: int) -> DataFrame:
    return rejected.where(F.col("corpus_id") == corpus_id).select("recording_id")


def rejected_count(rejected: DataFrame, corpus_id: int | None = None) -> DataFrame:
    """One row: how many rejections there are, of a corpus or of all."""
    rows = rejected if corpus_id is None else rejected.where(F.col("corpus_id") == corpus_id)
    return rows.agg(F.count(F.lit(1)).alias("rejected"))


def within_gate(duration: Column) -> Column:
    return F.coalesce(duration, F.lit(0.0)).between(MIN_SECONDS, MAX_SECONDS)


def vanished(ledger: DataFrame, listing: DataFrame, corpus_id: int | None = None) -> DataFrame:
    """Ids of active rows that the listing lacks."""
    return active(ledger, corpus_id).select("recording_id").join(listing.select("recording_id"), "recording_id", "left_anti")


def mass_removal(ledger: DataFrame, listing: DataFrame, corpus_id: int | None = None) -> DataFrame:
    """One row: active and vanished counts, and whether to refuse (more than 5 rows and more than half)."""
    have = active(ledger, corpus_id).select("recording_id")
    marked = have.join(listing.select("recording_id").distinct().withColumn("_listed", F.lit(True)), "recording_id", "left")
    counts = marked.agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("_listed").isNull()).alias("gone"))
    return counts.withColumn("refused", (F.col("gone") > MASS_ROWS) & (F.col("gone") > F.col("active") * MASS_FRACTION))


def refuse_mass_removal(ledger: DataFrame, listing: DataFrame, corpus_id: int | None = None) -> None:
    r = mass_removal(ledger, listing, corpus_id).first()
    if r.refused:
        raise MassRemoval(f"the listing lacks {r.gone} of {r.active} recordings")


def classify(ledger: DataFrame, listing: DataFrame, rejected: DataFrame, corpus_id: int) -> DataFrame:
    """One row for each id of listing or active ledger: action (added, updated, unchanged, removed, skipped) and reason.

    `listing` has recording_id, speaker_id, speaker_reason, text, text_hash,
    audio_path, quality_score, and what conversion said of the audio: audio_sha256,
    duration, failure (null when it went well).  Ids of another corpus and
    tombstones match by id too.  A full outer join, then a ladder of conditions.
    """
    return _compared(ledger, listing, rejected, corpus_id).where("action is not null").drop("_listed", "_held", "_no_text")


def _compared(ledger: DataFrame, listing: DataFrame, rejected: DataFrame, corpus_id: int) -> DataFrame:
    """As `classify`, with a null action for the other rows of the ledger; whether a row is listed (_listed) or in the ledger (_held)."""
    old = ledger.select("recording_id", F.lit(True).alias("_held"), *[F.col(c).alias(f"old_{c}") for c in ledger.columns if c != "recording_id"])
    bad = rejected.select("recording_id", F.col("audio_path").alias("rejected_path"))
    told = listing.withColumns({"_listed": F.lit(True), "_no_text": F.nullif("text", F.lit("")).isNull()})  # before the join, which then moves texts only where they are asked for
    rows = told.join(old, "recording_id", "full_outer").join(bad, "recording_id", "left")
    listed, is_active = F.coalesce(F.col("_listed"), F.lit(False)), F.coalesce(F.col("old_status") == "active", F.lit(False))
    current = is_active & F.col("old_audio_sha256").isNotNull() & F.col("old_audio_path").eqNullSafe(F.col("audio_path"))
    same = (F.col("old_corpus_id") == corpus_id) & F.col("old_text_hash").eqNullSafe(F.col("text_hash")) & F.col("old_quality_score").eqNullSafe(F.col("quality_score")) & F.col("old_speaker_id").eqNullSafe(F.col("speaker_id"))
    no_path = F.nullif("audio_path", F.lit("")).isNull()
    seen_bad = F.col("rejected_path").isNotNull() & (F.col("rejected_path") == F.col("audio_path"))
    reason = (
        F.when(~listed, None)
        .when(F.col("_no_text"), "empty_text")
        .when(current, None)
        .when(no_path, "missing_audio_path")
        .when(seen_bad, "previously_rejected")
        .when(F.col("failure").isNotNull(), F.col("failure"))
        .when(~within_gate(F.col("duration")), "duration_out_of_range")
    )
    rows = rows.withColumn("reason", reason)
    action = F.when(~listed, F.when(is_active & (F.col("old_corpus_id") == corpus_id), "removed")).when(F.col("reason").isNotNull(), "skipped").when(current & same, "unchanged").when(is_active, "updated").otherwise("added")
    return rows.withColumn("action", action)


def skip_counts(classified: DataFrame) -> DataFrame:
    """Rows for each reason; a dropped speaker id counts beside another reason of the same row."""
    reasons = F.filter(F.array("speaker_reason", "reason"), lambda r: r.isNotNull())
    return classified.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def summary(classified: DataFrame) -> DataFrame:
    names = ("added", "updated", "removed", "unchanged")
    return classified.agg(*[F.count_if(F.col("action") == a).alias(a) for a in names])


def upserted(ledger: DataFrame, delta: DataFrame, now: str) -> DataFrame:
    """Rows of `delta` (the ledger's content columns) become active; all but first_seen is replaced, tombstones revive."""
    new = delta.select("recording_id", *[F.col(c).alias(f"_{c}") for c in ("corpus_id", *CONTENT[:-1])]).withColumn("_new", F.lit(True))
    rows = ledger.join(new, "recording_id", "full_outer")
    hit = F.coalesce(F.col("_new"), F.lit(False))
    pick = lambda c, x: F.when(hit, x).otherwise(F.col(c)).alias(c)
    return rows.select(
        "recording_id", pick("corpus_id", F.col("_corpus_id")), *[pick(c, F.col(f"_{c}")) for c in CONTENT[:-1]], pick("validated_at", F.lit(None).cast("string")),
        pick("status", F.lit("active")), F.when(hit, F.coalesce("first_seen", F.lit(now))).otherwise(F.col("first_seen")).alias("first_seen"), pick("last_seen", F.lit(now)), pick("removed_at", F.lit(None).cast("string")),
    )


def seen(ledger: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """last_seen of listed active rows becomes now."""
    hit = ids.select("recording_id").distinct().withColumn("_hit", F.lit(True))
    rows = ledger.join(hit, "recording_id", "left")
    return rows.withColumn("last_seen", F.when(F.col("_hit") & (F.col("status") == "active"), F.lit(now)).otherwise(F.col("last_seen"))).select(*ledger.columns)


def removed(ledger: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Active rows of these ids become tombstones: content null, id, corpus and times kept."""
    hit = ids.select("recording_id").distinct().withColumn("_hit", F.lit(True))
    rows = ledger.join(hit, "recording_id", "left").withColumn("_hit", F.coalesce(F.col("_hit") & (F.col("status") == "active"), F.lit(False)))
    kinds = dict(ledger.dtypes)
    blank = [F.when(F.col("_hit"), F.lit(None).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in CONTENT else F.col(c) for c in ledger.columns if c not in ("status", "removed_at")]
    return rows.select(*blank, F.when(F.col("_hit"), "removed").otherwise(F.col("status")).alias("status"), F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("removed_at")).alias("removed_at")).select(*ledger.columns)


def with_rejections(rejected: DataFrame, delta: DataFrame, now: str) -> DataFrame:
    """Rejections added or replaced (recording_id, corpus_id, reason, audio_path), first_seen kept."""
    new = delta.select("recording_id", *[F.col(c).alias(f"_{c}") for c in ("corpus_id", "reason", "audio_path")]).withColumn("_new", F.lit(True))
    rows = rejected.join(new, "recording_id", "full_outer")
    return rows.select("recording_id", *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("corpus_id", "reason", "audio_path")], F.coalesce("first_seen", F.lit(now)).alias("first_seen"))


def without(rejected: DataFrame, ids: DataFrame) -> DataFrame:
    return rejected.join(ids.select("recording_id"), "recording_id", "left_anti")


def stale_rejections(rejected: DataFrame, listing: DataFrame, corpus_id: int) -> DataFrame:
    return rejected.where(F.col("corpus_id") == corpus_id).select("recording_id").join(listing.select("recording_id"), "recording_id", "left_anti")


def status_counts(ledger: DataFrame, corpus_id: int | None = None) -> DataFrame:
    rows = ledger if corpus_id is None else ledger.where(F.col("corpus_id") == corpus_id)
    return rows.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "removed").alias("removed"))


def hashes_in_use(ledger: DataFrame, hashes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Of the hashes (audio_sha256) those that an active row outside the excluded ids has."""
    others = active(ledger).join(excluded.select("recording_id"), "recording_id", "left_anti")
    return hashes.select("audio_sha256").distinct().join(others, "audio_sha256", "left_semi")


def erasable_hashes(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Audio hashes of these rows that no other active row has."""
    own = active(ledger).join(ids.select("recording_id"), "recording_id", "left_semi").where("audio_sha256 is not null").select("audio_sha256").distinct()
    return own.join(hashes_in_use(ledger, own, ids), "audio_sha256", "left_anti")


def sync(ledger: DataFrame, rejected: DataFrame, listing: DataFrame, corpus_id: int, now: str, allow_mass_removal: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new ledger, the new rejections and the classified rows of one sync; removals come first."""
    if not allow_mass_removal:
        refuse_mass_removal(ledger, listing, corpus_id)
    rows = _compared(ledger, listing, rejected, corpus_id)
    marked = rows.where("action is not null").drop("_listed", "_held", "_no_text")
    return _merged(rows, ledger, corpus_id, now), _rejections(rows, rejected, corpus_id, now), marked


def _merged(rows: DataFrame, ledger: DataFrame, corpus_id: int, now: str) -> DataFrame:
    """The new ledger from compared rows, without a further join: as `removed`, `seen` and `upserted` one after the other."""
    changed, gone = F.coalesce(F.col("action").isin("added", "updated"), F.lit(False)), F.coalesce(F.col("action") == "removed", F.lit(False))
    was_active = F.coalesce(F.col("old_status") == "active", F.lit(False))
    keep_audio = was_active & F.col("old_audio_path").eqNullSafe(F.col("audio_path")) & F.col("old_audio_sha256").isNotNull()
    fresh = {c: F.col(c) for c in CONTENT[:-1]} | {"corpus_id": F.lit(corpus_id).cast("long"), "status": F.lit("active"), "last_seen": F.lit(now), "first_seen": F.coalesce("old_first_seen", F.lit(now))}
    fresh |= {c: F.when(keep_audio, F.col(f"old_{c}")).otherwise(F.col(c)) for c in ("audio_sha256", "duration")}
    over = {"status": F.lit("removed"), "removed_at": F.lit(now)} | {c: F.lit(None) for c in CONTENT}
    listed = {"last_seen": F.when(F.col("_listed") & was_active, F.lit(now)).otherwise(F.col("old_last_seen"))}
    kinds = dict(ledger.dtypes)

    def value(c: str) -> Column:
        as_it_was = listed.get(c, F.col(f"old_{c}"))
        return F.when(changed, fresh.get(c, F.lit(None))).when(gone, over.get(c, F.col(f"old_{c}"))).otherwise(as_it_was).cast(kinds[c]).alias(c)

    return rows.where(F.col("_held") | changed).select("recording_id", *[value(c) for c in ledger.columns if c != "recording_id"])


def _rejections(rows: DataFrame, rejected: DataFrame, corpus_id: int, now: str) -> DataFrame:
    """The new rejections from compared rows by one join: stale and mended ones go, as by `stale_rejections` and `without`, new ones come, as by `with_rejections`."""
    bad = F.coalesce(F.col("reason").isin("audio_undecodable", "duration_out_of_range"), F.lit(False))
    told = rows.where("_listed").select("recording_id", F.lit(True).alias("_told"), bad.alias("_bad"), F.col("action").isin("added", "updated").alias("_mended"), F.col("reason").alias("_reason"), F.col("audio_path").alias("_path"))
    both = rejected.join(told, "recording_id", "full_outer")
    is_bad, stale = F.coalesce("_bad", F.lit(False)), F.col("_told").isNull() & (F.col("corpus_id") == corpus_id)
    stays = F.col("reason").isNotNull() & ~F.coalesce(stale, F.lit(False)) & ~F.coalesce("_mended", F.lit(False))
    put = lambda c, x: F.when(is_bad, x).otherwise(F.col(c)).alias(c)
    return both.where(is_bad | stays).select("recording_id", put("corpus_id", F.lit(corpus_id).cast("long")), put("reason", F.col("_reason")), put("audio_path", F.col("_path")), F.coalesce("first_seen", F.lit(now)).alias("first_seen"))


VERSION = 2


def migrated(ledger: DataFrame, version: int | None) -> DataFrame:
    """A ledger of an older version with the columns that were added since; newer ones are refused."""
    from pyspark.sql.types import StructType

    if version is not None and version > VERSION:
        raise ValueError(f"ledger version {version} is newer than {VERSION}")
    wanted = StructType.fromDDL(LEDGER)
    have = set(ledger.columns)
    return ledger.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])


def build_rows(ledger: DataFrame, files: DataFrame, corpus_id: int | None = None) -> DataFrame:
    """Active rows for a build, texts normalised and hashed anew; ValueError when audio files (audio_sha256) are missing."""
    from vellum.functions.text import normalize_text, text_hash

    rows = active(ledger, corpus_id)
    missing = rows.join(files.select("audio_sha256"), "audio_sha256", "left_anti")
    first = [r.recording_id for r in missing.select("recording_id").orderBy("recording_id").limit(10).collect()]
    if first:
        raise ValueError(f"{missing.count()} recordings have no audio file, such as {first}")
    text = normalize_text(F.col("text"))
    # sorted first: what lies below a sort is computed twice, once to find the ranges
    return rows.orderBy("recording_id").select("recording_id", F.nullif("speaker_id", F.lit("")).alias("speaker_id"), text.alias("text"), text_hash(text, composed=True).alias("text_hash"), "audio_sha256", "duration", "quality_score")


def with_positions(rows: DataFrame, order: str) -> DataFrame:
    """Positions 0, 1, ... in order of a column, without one task for all: ranges are sorted by themselves and counted before."""
    from pyspark.sql import Window

    ranged = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = before.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row a partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_at", inside).join(F.broadcast(first), "_part").withColumn(order, F.col("_first") + F.col("_at")).drop("_part", "_first", "_at")
