"""Registered queries on files and streams: the driver's tables landed as files by name, chunks, audio and live bytes, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import jobs, ledger, longfiles, splits
from vellum.sources import byname, feeds, listings, sinks, wav
from vellum.streaming import delivery

from .bindings import BUILD, CORPUS, RATIOS, landing, recordings, stored, table
from .bindings import ledger as ledger_rows
from .queries import _GUARD_SQL, SQL_SYNC, query

_COLLAPSED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


# --- files by name --------------------------------------------------------------------------


@query(f"SELECT item_id, length({_COLLAPSED}) AS n_text FROM benchmark")
def reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference texts, a file each; every third begins with a byte order mark."""
    root = landing(spark, "texts")
    mark = F.when(F.col("item_id") % 3 == 0, F.lit("﻿")).otherwise("")
    byname.write_files(table(spark, sf_dir, "benchmark").select(F.concat("item_id", F.lit(".txt")).alias("path"), F.concat(mark, "text").cast("binary").alias("content")), root)
    return listings.read_texts(spark, root).select(F.regexp_extract("path", "(\\d+)\\.txt$", 1).cast("long").alias("item_id"), F.length("text").cast("long").alias("n_text"))


@query("SELECT conv_id::VARCHAR AS job, turn::INTEGER AS index, role AS language, length(text) AS n_text FROM conversations WHERE text IS NOT NULL")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk results written twice, a file each: the newer form is what is read, once."""
    root, rows = landing(spark, "chunks"), table(spark, sf_dir, "conversations").where("text is not null")
    result = rows.select(F.col("conv_id").cast("string").alias("job"), F.col("turn").cast("int").alias("index"), "text", F.col("role").alias("language"))
    both = result.withColumns({"text": F.lit("old"), "at": F.lit(1)}).unionByName(result.withColumn("at", F.lit(2)))
    sinks.write_chunk_results(both, root, "at")
    return listings.read_chunks(spark, root).select("job", "index", "language", F.length("text").cast("long").alias("n_text"))


@query("SELECT DISTINCT sha256(text) AS sha256, length(text) AS n_text FROM benchmark WHERE text IS NOT NULL")
def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents stored by their hash, a file each and each once; a second write changes nothing."""
    root, rows = landing(spark, "store"), table(spark, sf_dir, "benchmark").where("text is not null")
    files = rows.select(F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("content"))
    sinks.store_contents(files, root)
    sinks.store_contents(files.withColumn("content", F.lit(b"other")), root)
    return sinks.stored_contents(spark, root).select("sha256", F.length(F.col("content").cast("string")).cast("long").alias("n_text"))


@query("SELECT doc_id, CASE WHEN doc_id % 1000 IN (SELECT item_id FROM benchmark WHERE text IS NOT NULL) THEN (SELECT any_value(sha256(text)) FROM benchmark WHERE item_id = doc_id % 1000) END AS audio_sha256 FROM documents")
def wanted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the files that rows name, each opened once a task; null where there is none."""
    root, rows = landing(spark, "audio"), table(spark, sf_dir, "benchmark").where("text is not null")
    byname.write_files(rows.select(F.concat(F.lit("p/"), "item_id", F.lit(".wav")).alias("path"), F.col("text").cast("binary").alias("content")), root)
    wanted = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p/"), F.col("doc_id") % 1000, F.lit(".wav")).alias("audio_path"))
    return listings.read_audio(spark, root, wanted).select("doc_id", F.sha2("content", 256).alias("audio_sha256"))


_CODES = "transform(sequence(1, length(text)), k -> cast((ascii(substr(text, k, 1)) % 256 - 128) / 128 as float))"


def _spoken(spark: SparkSession, sf_dir: str, rate: int) -> str:
    """benchmark texts as WAV files whose samples are the characters' codes."""
    root = landing(spark, "spoken")
    rows = table(spark, sf_dir, "benchmark").where("length(text) > 0")
    byname.write_files(rows.select(F.concat("item_id", F.lit(".wav")).alias("path"), wav.encoded(F.expr(_CODES), rate).alias("content")), root)
    return root


@query(
    """SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(list_sum([(ord(c) % 256 - 128) / 128 FOR c IN string_split(text[doc_id % 50 + 1 : doc_id % 50 + 20], '')]), 0) END AS total
    FROM (SELECT doc_id, b.text FROM documents d LEFT JOIN (SELECT * FROM benchmark WHERE length(text) > 0) b ON b.item_id = d.doc_id % 100)"""
)
def sample_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of twenty samples of landed WAV files; of each file only its header and these are read."""
    root = _spoken(spark, sf_dir, 100)
    wanted = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id") % 100, F.lit(".wav")).alias("path"), (F.col("doc_id") % 50).alias("start_sample"), (F.col("doc_id") % 50 + 20).alias("end_sample"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return byname.read_samples(wanted, root).select("doc_id", total.alias("total"))


@query(
    """WITH n AS (SELECT item_id, length(text) AS n FROM benchmark WHERE length(text) > 0), c AS (SELECT *, CASE WHEN n > 50 THEN greatest(0, floor((n - 12.5) / 50))::BIGINT ELSE 0 END AS cuts FROM n)
    SELECT item_id, repeat('50 ', cuts) || (n - 50 * cuts) AS text, cuts + 1 AS chunks_done, true AS complete FROM c"""
)
def long_file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files read chunk by chunk by a model that says how many samples it got; boundaries stay on their grid."""
    root = _spoken(spark, sf_dir, 10)
    files = table(spark, sf_dir, "benchmark").where("length(text) > 0").select(F.col("item_id").alias("id"), F.concat("item_id", F.lit(".wav")).alias("path"))
    _, whole = longfiles.transcribed(files, root, {"m": lambda: lambda x, prompt: str(len(x))}, 5.0, 10, window=0.0)
    return whole.select(F.col("job").alias("item_id"), "text", "chunks_done", "complete")


# --- guards -----------------------------------------------------------------------------------


def _said(spark: SparkSession, guard) -> DataFrame:
    """One row: what a guard raised, null if nothing."""
    try:
        guard()
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "error string")
    return spark.createDataFrame([(None,)], "error string")


@query(_GUARD_SQL + ", a AS (SELECT count(*) AS n FROM split WHERE split = 'train'), b AS (SELECT count(*) AS n FROM kept WHERE split = 'train') SELECT 'dropped ' || (a.n - b.n) || ' of ' || a.n || ' training rows for transcript overlap' AS error FROM a, b")
def build_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of a build that may drop no training row."""
    rows = stored(splits.with_split(recordings(spark, sf_dir), RATIOS).select("split", "speaker_id", "text_hash"), "splits")
    return _said(spark, lambda: splits.check_build(splits.leakage_stats(rows), splits.split_sizes(rows), 0.0))


@query(f"WITH {SQL_SYNC}, m AS (SELECT recording_id FROM ledger WHERE status = 'active' AND corpus_id = {CORPUS} AND recording_id % 10 = 3) SELECT (SELECT count(*) FROM m) || ' recordings have no audio file, such as [' || (SELECT string_agg(recording_id, ', ' ORDER BY recording_id) FROM (SELECT * FROM m ORDER BY 1 LIMIT 10)) || ']' AS error")
def missing_audio_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of a build whose audio lacks every tenth recording, with the first ten."""
    rows = stored(ledger_rows(spark, sf_dir).select(*BUILD), "ledger").withColumn("audio_sha256", F.concat("audio_sha256", F.lit("-"), "recording_id"))
    return _said(spark, lambda: ledger.build_rows(rows, rows.where("recording_id % 10 <> 3").select("audio_sha256"), CORPUS))


@query("SELECT CASE WHEN count(*) FILTER (turn = 1) > 0 THEN 'chunks are missing' END AS error FROM conversations")
def incomplete_result_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether jobs without their second chunk are refused."""
    plan = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").cast("int").alias("index"), F.coalesce("text", F.lit("")).alias("text"), F.lit("xx").alias("language"), F.lit("m").alias("model"))
    error = _said(spark, lambda: jobs.require_complete(jobs.assemble(plan.select("job", "index"), plan.where("index <> 1"))))
    return error.select(F.when(F.col("error").rlike("^\\d+ of \\d+ chunks of "), "chunks are missing").alias("error"))


# --- streams ----------------------------------------------------------------------------------


def _run(rows: DataFrame, folder: str) -> DataFrame:
    """A stream run once over all that is there (timers would keep it running otherwise), into files that are read back."""
    query_ = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(once=True).start()
    query_.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


@query("SELECT (conv_id % 16)::VARCHAR AS session, sum(strlen(coalesce(text, '')))::BIGINT AS samples, true AS ended FROM conversations GROUP BY ALL")
def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded live bytes of sixteen sessions as a stream of its own source: samples received, and whether the end came."""
    root = landing(spark, "feed")
    raw = F.concat(F.coalesce("text", F.lit("")), F.coalesce("text", F.lit(""))).cast("binary")
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 16).alias("session"), "conv_id", "turn", raw.alias("content")).withColumn("size", F.octet_length("content"))
    ordered = Window.partitionBy("session").orderBy("conv_id", "turn")
    placed = rows.where("size > 0").withColumn("first", F.coalesce(F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = rows.groupBy("session").agg(F.sum("size").alias("first")).select(F.format_string("%d/%015d.end", "session", "first").alias("path"), F.lit(b"").alias("content"))
    byname.write_files(placed.select(F.format_string("%d/%015d.pcm", "session", "first").alias("path"), "content").unionByName(ends), root)
    pieces = _run(feeds.stream(spark, "landed_pcm", feeds.Recorded(root)), landing(spark, "fed"))
    return pieces.groupBy("session").agg((F.sum(F.octet_length("pcm")) / 2).cast("long").alias("samples"), F.bool_or("last").alias("ended"))


@query("SELECT (user_id % 16)::VARCHAR AS session, least(count(*), 200) AS pushed, 0 AS failed, greatest(count(*) - 200, 0) AS dropped FROM events GROUP BY ALL")
def delivered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of sixteen sessions that get all their events at once: of more than two hundred the oldest are dropped."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 16).cast("string").alias("session"), F.col("event_id").cast("long").alias("id"), F.col("event_type").alias("payload"), F.lit(False).alias("last"))
    folder = landing(spark, "events")
    rows.coalesce(1).write.parquet(folder)
    live = spark.readStream.schema(rows.schema).parquet(folder)
    counts = _run(delivery.deliver(live, lambda session, batch: 200), landing(spark, "delivered"))
    return counts.groupBy("session").agg(*(F.sum(c).cast("long").alias(c) for c in ("pushed", "failed", "dropped")))
