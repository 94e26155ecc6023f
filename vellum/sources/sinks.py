"""Writing builds, snapshots and content-addressed files, and the pointers that make a version the current one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byname import write_files, write_text

MARK = "build_metadata"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def committed(spark: SparkSession, folder: str) -> bool:
    """Whether a version was written to its end: its metadata is the last thing to be written."""
    return _exists(spark, f"{folder}/{MARK}/_SUCCESS")


def clear(spark: SparkSession, folder: str) -> None:
    """Delete a folder that is one of ours; any other that exists is refused."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return
    names = {s.getPath().getName() for s in fs.listStatus(p)}
    if names and not names & {MARK, "manifest", "rows"}:
        raise ValueError(f"{folder} is not a dataset version")
    fs.delete(p, True)


def write_version(rows: DataFrame, manifest: DataFrame, metadata: dict, root: str, version: str, force: bool = False) -> bool:
    """Write rows by split, then the manifest, then the metadata; false when the version is there already."""
    spark, folder = rows.sparkSession, f"{root}/{version}"
    if committed(spark, folder) and not force:
        return False
    clear(spark, folder)
    rows.write.partitionBy("split").parquet(f"{folder}/rows")
    manifest.write.json(f"{folder}/manifest")
    spark.range(1).select(F.lit(json.dumps(metadata, sort_keys=True)).alias("value")).write.text(f"{folder}/{MARK}")
    return True


def write_table_version(table: DataFrame, root: str, version: int) -> str:
    """A new version of a table; readers take the highest committed one."""
    path = f"{root}/v{version:08d}"
    table.write.mode("errorifexists").parquet(path)
    return path


def current_version(spark: SparkSession, root: str) -> int:
    """Highest version with a success marker; 0 when there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and _exists(spark, f"{root}/{n}/_SUCCESS")), default=0)


def new_contents(files: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each content hash that is not stored yet."""
    return files.dropDuplicates(["sha256"]).join(stored.select("sha256"), "sha256", "left_anti")


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.json(path)


def checked_fields(fields: set[str], allowed: set[str]) -> None:
    if unknown := fields - allowed:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")


def store_contents(files: DataFrame, root: str) -> None:
    """Store the contents (sha256, content) that are not there yet, a file `<first two digits>/<hash>.wav` each; what is there stays as it is."""
    name = F.concat(F.left("sha256", F.lit(2)), F.lit("/"), "sha256", F.lit(".wav"))
    write_files(files.select(name.alias("path"), "content"), root, absent=True)


def stored_contents(spark: SparkSession, root: str) -> DataFrame:
    """Hashes and bytes of a store."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root)
    return raw.select(F.regexp_extract("path", "([^/]+)\\.wav$", 1).alias("sha256"), "content")


def write_chunk_results(results: DataFrame, folder: str, order: str | None = None) -> None:
    """Write results of chunks (job, index and what the model gave), a file `<job>/chunks/<index>.json` each, which `listings.read_chunks` reads.

    A chunk that is written again replaces what was there, whole or not at all; of rows of one chunk the last by `order` counts.
    """
    kept = [c for c in results.columns if c not in ("job", "index", order)]
    name = F.format_string("%s/chunks/%05d.json", "job", "index")
    rows = results.select(name.alias("path"), F.to_json(F.struct(*kept)).cast("binary").alias("content"), *([order] if order else []))
    write_files(rows, folder, order)


def append_rate(spark: SparkSession, path: str, audio_seconds: float, wall_seconds: float, keep: int = 5) -> None:
    """Add a sample of transcription speed to a small file that keeps the last few; samples without a length do not count."""
    if audio_seconds <= 0 or wall_seconds <= 0:
        return
    before = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<audio_seconds:double,wall_seconds:double>>").alias("s")).first().s if _exists(spark, path) else None
    rows = [x.asDict() for x in before or []] + [{"audio_seconds": round(audio_seconds, 3), "wall_seconds": round(wall_seconds, 3)}]
    write_text(spark, path, json.dumps(rows[-keep:]))


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """One JSON document, indented and with its keys as given; the file is there whole or as it was before."""
    write_text(spark, path, json.dumps(record, indent=2, ensure_ascii=False) + "\n")


def write_snapshot(rows: DataFrame, metadata: dict, folder: str) -> dict:
    """Write the rows within the duration gate (file, position, content and SNAPSHOT's columns), then what is said of them, which is returned.

    The content hash is the tree of `listings.ordered_hash` over the kept rows in order of `position`.
    """
    from vellum.operators.ledger import within_gate
    from vellum.operators.ledger import with_positions
    from vellum.sources.listings import ordered_hash

    if _exists(rows.sparkSession, folder):
        raise ValueError(f"{folder} is there already")
    with_positions(rows.where(within_gate(F.col("duration"))), "position").write.parquet(f"{folder}/rows")
    kept = rows.sparkSession.read.parquet(f"{folder}/rows")
    n = kept.agg(F.count(F.lit(1)).alias("recording_count"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration_seconds"), F.coalesce(F.bool_or(F.coalesce(F.length("speaker_id") > 0, F.lit(False))), F.lit(False)).alias("has_speaker_id")).first()
    digest = ordered_hash(kept, "position", "content").first()
    said = metadata | n.asDict() | {"content_hash": digest.content_hash if digest else None}
    rows.sparkSession.range(1).select(F.lit(json.dumps(said, sort_keys=True)).alias("value")).coalesce(1).write.text(f"{folder}/{MARK}")
    return said
