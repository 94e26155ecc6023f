"""Lineage from speakers over recordings and dataset versions to models; erasure and retention plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ledger as L


def speaker_datasets(manifests: DataFrame, speaker: str | None = None) -> DataFrame:
    """For each speaker (or one) and built version: recordings and sorted distinct splits."""
    rows = manifests.where(F.col("speaker_id").isNotNull()) if speaker is None else manifests.where(F.col("speaker_id") == speaker)
    return rows.groupBy("speaker_id", "dataset_version").agg(F.count(F.lit(1)).alias("recordings"), F.concat_ws(",", F.sort_array(F.collect_set("split"))).alias("splits"))


def speaker_models(manifests: DataFrame, models: DataFrame) -> DataFrame:
    """Models trained on a version that holds the speaker."""
    return speaker_datasets(manifests).select("speaker_id", "dataset_version").join(models, "dataset_version").select("speaker_id", "path", "dataset_version").distinct()


def built_states(files: DataFrame) -> DataFrame:
    """State of each version folder from its files (columns version, file): superseded, built or partial."""
    held = files.groupBy("version").agg(F.collect_set("file").alias("files"))
    has = lambda name: F.array_contains("files", name)
    return held.select("version", F.when(has("SUPERSEDED.json"), "superseded").when(has("build_metadata.json") & has("manifest.json"), "built").otherwise("partial").alias("state"))


def review_versions(manifests: DataFrame, superseded: DataFrame, speaker: str) -> DataFrame:
    """Versions whose models need a look after erasing a speaker: those that hold them and those already superseded."""
    return speaker_datasets(manifests, speaker).select("dataset_version").union(superseded.select("dataset_version")).distinct()


def purge_plan(ledger: DataFrame, manifests: DataFrame, superseded: DataFrame, models: DataFrame, speaker: str) -> DataFrame:
    """What erasing a speaker does, a row each: kind (tombstone, erase_audio, shared_audio, supersede, review_model) and target."""
    ids = L.active(ledger).where(F.col("speaker_id") == speaker).select("recording_id")
    own = L.active(ledger).where((F.col("speaker_id") == speaker) & F.col("audio_sha256").isNotNull()).select("audio_sha256").distinct()
    erase = L.erasable_hashes(ledger, ids)
    models_left = models.join(review_versions(manifests, superseded, speaker), "dataset_version", "left_semi")
    step = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("target"))
    return (
        step("tombstone", ids, "recording_id")
        .unionByName(step("erase_audio", erase, "audio_sha256"))
        .unionByName(step("shared_audio", own.join(erase, "audio_sha256", "left_anti"), "audio_sha256"))
        .unionByName(step("supersede", speaker_datasets(manifests, speaker), "dataset_version"))
        .unionByName(step("review_model", models_left, "path"))
    )


def retention(versions: DataFrame, models: DataFrame, keep: int, include_referenced: bool = False, by: list[str] | None = None) -> DataFrame:
    """Versions beyond the newest `keep` (of each group `by`), without those that a model refers to."""
    newest = Window.partitionBy(*(by or [])).orderBy(F.desc("created_at"), F.desc("version"))
    old = versions.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") > keep).drop("rank")
    return old if include_referenced else old.join(models.select(F.col("dataset_version").alias("version")), "version", "left_anti")


def old_checkpoints(paths: DataFrame, finished_runs: DataFrame) -> DataFrame:
    """Folders named checkpoint-<number> of finished runs (columns run, name)."""
    return paths.where(F.col("name").rlike("^checkpoint-[0-9]+$")).join(finished_runs.select("run"), "run", "left_semi")


def versions_named(nodes: DataFrame, column: str = "content", key: str = "dataset_version") -> DataFrame:
    """All string values of a key at any depth of a JSON column, with the file's other columns: distinct rows."""
    import json

    @F.udtf(returnType=f"{key} string")
    class Find:
        def eval(self, content: str):
            try:
                todo = [json.loads(content)] if content else []
            except ValueError:
                return
            while todo:
                node = todo.pop()
                if isinstance(node, dict):
                    if isinstance(node.get(key), str):
                        yield (node[key],)
                    todo.extend(node.values())
                elif isinstance(node, list):
                    todo.extend(node)

    others = [c for c in nodes.columns if c != column]
    return nodes.lateralJoin(Find(F.col(column).outer())).select(*others, key).distinct()
