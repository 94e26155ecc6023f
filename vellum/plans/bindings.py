"""Views of the driver's tables in the shapes that the operators take."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T

RATIOS = {"train": 0.6, "dev": 0.2, "test": 0.2}
NOW = "2024-02-01T00:00:00Z"
CORPUS = 1
#: What a build takes from the ledger.
BUILD = ["recording_id", "corpus_id", "speaker_id", "text", "audio_sha256", "duration", "quality_score", "status"]


def landing(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; on a local master a temporary one will do."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        top = "file://" + tempfile.mkdtemp(prefix="vellum-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once and read back, where several branches of a plan would compute them again."""
    path = landing(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as recordings: 97 speakers, every eleventh row without one; the text's hash stands for the audio's too."""
    d = table(spark, sf_dir, "documents")
    speaker = F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("spk"), (F.col("doc_id") % 97).cast("string")))
    rows = d.select(F.col("doc_id").alias("recording_id"), speaker.alias("speaker_id"), T.normalize_text(F.col("text")).alias("text"), "source", "n_chars")
    return rows.withColumn("text_hash", T.text_hash(F.col("text"), composed=True)).withColumns({"audio_sha256": F.col("text_hash"), "duration": F.col("n_chars") / 100})


SQL_RECORDINGS = """recordings AS (
    SELECT doc_id AS recording_id, CASE WHEN doc_id % 11 <> 0 THEN 'spk' || (doc_id % 97)::VARCHAR END AS speaker_id, source, n_chars, n_chars / 100 AS duration,
           trim(regexp_replace(replace(nfc_normalize(text), '\\n', ' '), '\\s+', ' ', 'g')) AS text,
           sha256(nfc_normalize(trim(regexp_replace(replace(nfc_normalize(text), '\\n', ' '), '\\s+', ' ', 'g')))) AS text_hash
    FROM documents)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; every tenth has an id that the listing lacks, every thirteenth is a tombstone."""
    r = recordings(spark, sf_dir).withColumn("recording_id", F.when(F.col("recording_id") % 10 == 0, F.col("recording_id") + 2_000_000).otherwise(F.col("recording_id")))
    dead = F.col("recording_id") % 13 == 0
    live = lambda c: F.when(~dead, c)
    return r.select(
        "recording_id", F.lit(CORPUS).cast("long").alias("corpus_id"), live(F.col("speaker_id")).alias("speaker_id"), live(F.col("text")).alias("text"), live(F.col("text_hash")).alias("text_hash"), live(F.col("audio_sha256")).alias("audio_sha256"),
        live(F.col("source")).alias("audio_path"), live(F.least("duration", F.lit(29.0))).alias("duration"), live(F.lit(1.0)).alias("quality_score"), F.lit(None).cast("string").alias("validated_at"), F.when(dead, "removed").otherwise("active").alias("status"),
        F.lit("2024-01-01T00:00:00Z").alias("first_seen"), F.lit("2024-01-01T00:00:00Z").alias("last_seen"), F.when(dead, "2024-01-02T00:00:00Z").alias("removed_at"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; every seventh has a new id.  Another path on multiples of 5, another score on multiples of 3, no text on multiples of 29."""
    r = recordings(spark, sf_dir).withColumn("recording_id", F.when(F.col("recording_id") % 7 == 0, F.col("recording_id") + 7_000_000).otherwise(F.col("recording_id")))
    i = F.col("recording_id")
    return r.select(
        "recording_id", "speaker_id", F.when(i % 17 == 0, "speaker_id_email_dropped").alias("speaker_reason"), F.when(i % 29 == 0, "").otherwise(F.col("text")).alias("text"), "text_hash",
        F.when(i % 31 == 0, None).when(i % 5 == 0, F.concat("source", F.lit("/new"))).otherwise(F.col("source")).alias("audio_path"), F.when(i % 3 == 0, 2.0).otherwise(1.0).alias("quality_score"),
        "audio_sha256", "duration", F.when(i % 23 == 0, "audio_undecodable").alias("failure"),
    )


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listed rows were rejected before: on multiples of 20 under the path that they have now, else under an older one."""
    r = listing(spark, sf_dir)
    path = F.when(F.col("recording_id") % 20 == 0, F.col("audio_path")).otherwise(F.concat("audio_path", F.lit("/old")))
    return r.select("recording_id", F.lit(CORPUS).cast("long").alias("corpus_id"), F.lit("audio_undecodable").alias("reason"), path.alias("audio_path"), F.lit("2024-01-01T00:00:00Z").alias("first_seen"))


SQL_SYNC = (
    SQL_RECORDINGS
    + """, ledger AS (
    SELECT recording_id, 1 AS corpus_id, CASE WHEN recording_id % 13 <> 0 THEN speaker_id END AS speaker_id, CASE WHEN recording_id % 13 <> 0 THEN text END AS text, CASE WHEN recording_id % 13 <> 0 THEN text_hash END AS text_hash,
           CASE WHEN recording_id % 13 <> 0 THEN source END AS audio_path, CASE WHEN recording_id % 13 <> 0 THEN least(duration, 29.0) END AS duration, CASE WHEN recording_id % 13 <> 0 THEN 1.0 END AS quality_score,
           CASE WHEN recording_id % 13 = 0 THEN 'removed' ELSE 'active' END AS status
    FROM (SELECT * REPLACE (CASE WHEN recording_id % 10 = 0 THEN recording_id + 2000000 ELSE recording_id END AS recording_id) FROM recordings)),
listing AS (
    SELECT recording_id, speaker_id, CASE WHEN recording_id % 17 = 0 THEN 'speaker_id_email_dropped' END AS speaker_reason, CASE WHEN recording_id % 29 = 0 THEN '' ELSE text END AS text, text_hash,
           CASE WHEN recording_id % 31 = 0 THEN NULL WHEN recording_id % 5 = 0 THEN source || '/new' ELSE source END AS audio_path, CASE WHEN recording_id % 3 = 0 THEN 2.0 ELSE 1.0 END AS quality_score,
           duration, CASE WHEN recording_id % 23 = 0 THEN 'audio_undecodable' END AS failure
    FROM (SELECT * REPLACE (CASE WHEN recording_id % 7 = 0 THEN recording_id + 7000000 ELSE recording_id END AS recording_id) FROM recordings)),
rejections AS (SELECT recording_id, CASE WHEN recording_id % 20 = 0 THEN audio_path ELSE audio_path || '/old' END AS audio_path FROM listing),
diff AS (
    SELECT coalesce(n.recording_id, o.recording_id) AS recording_id, n.speaker_reason, n.recording_id IS NOT NULL AS listed, coalesce(o.status = 'active', false) AS live, o.recording_id IS NOT NULL AS known,
           coalesce(o.status = 'active' AND o.text_hash IS NOT NULL AND o.audio_path IS NOT DISTINCT FROM n.audio_path, false) AS current,
           o.text_hash IS NOT DISTINCT FROM n.text_hash AND o.quality_score IS NOT DISTINCT FROM n.quality_score AND o.speaker_id IS NOT DISTINCT FROM n.speaker_id AS same,
           n.text, n.audio_path, n.failure, n.duration, r.audio_path AS rejected_path
    FROM listing n FULL JOIN ledger o ON n.recording_id = o.recording_id LEFT JOIN rejections r ON r.recording_id = coalesce(n.recording_id, o.recording_id)),
reasons AS (
    SELECT *, CASE WHEN NOT listed THEN NULL WHEN coalesce(text, '') = '' THEN 'empty_text' WHEN current THEN NULL WHEN coalesce(audio_path, '') = '' THEN 'missing_audio_path'
        WHEN rejected_path = audio_path THEN 'previously_rejected' WHEN failure IS NOT NULL THEN failure WHEN NOT coalesce(duration, 0) BETWEEN 0.5 AND 30 THEN 'duration_out_of_range' END AS reason
    FROM diff WHERE listed OR live),
classified AS (
    SELECT *, CASE WHEN NOT listed THEN 'removed' WHEN reason IS NOT NULL THEN 'skipped' WHEN current AND same THEN 'unchanged' WHEN live THEN 'updated' ELSE 'added' END AS action FROM reasons)"""
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their time in seconds since the epoch."""
    return table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: each turn's text beside that of the next one as hypothesis."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.col("role").alias("speaker_id"), F.col("text").alias("reference"), F.lead("text").over(w).alias("hypothesis"), (F.length("text") / 10).alias("audio_seconds"))
