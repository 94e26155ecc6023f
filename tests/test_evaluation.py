"""The model seam, gate, job records and ledger upkeep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import evaluation, jobs, ledger
from vellum.streaming import live


def test_transcripts_come_from_a_model_opened_in_the_task(spark):
    def opener():  # inside, so that tasks need not import this module
        return lambda samples, prompt: ("loud " if np.abs(samples).max(initial=0) > 0.5 else "quiet ") + (prompt or "")

    rows = spark.createDataFrame([(1, [0.9, 0.1], "loud", "a", "p"), (2, [0.1], "loud", "a", None), (3, None, "x", "b", None)], "recording_id int, samples array<float>, reference string, speaker_id string, prompt string")
    got = evaluation.with_hypotheses(rows, opener, prompt="prompt")
    assert {r.recording_id: r.hypothesis for r in got.collect()} == {1: "loud p", 2: "quiet ", 3: None} and "samples" not in got.columns
    pooled, speakers = evaluation.evaluated(rows.where("recording_id < 3").drop("prompt"), opener, 1)
    assert pooled.first().wer == 0.5 and {r.speaker_id: r.audio_seconds for r in speakers.collect()} == {"a": 3.0}


def test_gate_from_scores(spark):
    scores = spark.createDataFrame([("candidate", 0.1), ("baseline", 0.2)], "model string, wer double")
    row = evaluation.gate(scores, 0.1).first()
    assert row.passed and row.relative_wer_improvement == 0.5 and row.checks[1].passed is None
    worse = spark.createDataFrame([(["wer"],)], "regressions array<string>")
    assert not evaluation.gate(scores, 0.1, worse).first().passed
    assert not evaluation.gate(scores, 0.1, None, True).first().passed
    text = evaluation.rendered(evaluation.gate(scores, 0.1)).first().text
    assert text == "WER 0.1000 against 0.2000\n[PASS] beats_baseline\n[SKIP] longform\nGate: PASSED"


def test_prompts_carry_the_text_before(spark):
    chunks = spark.createDataFrame([("j", 0, "one two"), ("j", 1, "three"), ("j", 3, "five")], "job string, index int, text string")
    got = {r["index"]: r.prompt for r in evaluation.chunk_prompts(chunks, F.lit("p"), 3).collect()}
    assert got == {0: "p", 1: "p two", 3: "p"}


def test_job_records(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    requests = spark.createDataFrame([("a", {"language": "sv"}, "url", None, "u"), ("b", None, "upload", "p", None)], "id string, params map<string,string>, kind string, path string, url string")
    made = jobs.created(requests, {"language": "fi", "chunk_seconds": "60"}, now)
    assert {r.id: r.params for r in made.collect()} == {"a": {"language": "sv", "chunk_seconds": "60"}, "b": {"language": "fi", "chunk_seconds": "60"}}
    with pytest.raises(Exception):
        jobs.created(requests.withColumn("kind", F.lit("x")), {}, now).collect()
    later = jobs.updated(made, spark.createDataFrame([("a", 5.0)], "id string, current_seconds double"), F.lit("2024-02-01").cast("timestamp"))
    assert {r.id: (r.current_seconds, r.updated_at.month) for r in later.collect()} == {"a": (5.0, 2), "b": (0.0, 1)}
    with pytest.raises(ValueError):
        jobs.updated(made, spark.createDataFrame([("a", "x")], "id string, status string"), now)
    running = jobs.with_status(made, "running", now)
    assert running.where("started_at is not null and finished_at is null").count() == 2


def test_job_views(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    rows = spark.createDataFrame([("a", "running", [60.0, 120.0], 60.0, 120.0, 0), ("b", "failed", [60.0, 120.0], 60.0, 120.0, 0)], "id string, status string, ends array<double>, current double, total_seconds double, baseline int")
    got = {r.id: r for r in jobs.views(rows.withColumns({"started": at(0), "updated": at(30)}), at(35)).collect()}
    assert (got["a"].progress, got["a"].eta_seconds, got["a"].chunks_done) == (50.0, 25.0, 1) and got["b"].eta_seconds is None


def test_ledger_upkeep(spark):
    old = spark.createDataFrame([(1, 1, "t", "a1", "active")], "recording_id long, corpus_id long, text string, audio_sha256 string, status string")
    rows = ledger.migrated(old, 1)
    assert rows.columns == ledger.migrated(rows, ledger.VERSION).columns and rows.first().duration is None
    with pytest.raises(ValueError):
        ledger.migrated(old, 99)
    files = spark.createDataFrame([("a1",)], "audio_sha256 string")
    assert ledger.build_rows(rows, files).first().text_hash is not None
    with pytest.raises(ValueError):
        ledger.build_rows(rows, files.limit(0))


def test_delivery_requests(spark):
    rows = [(None, None, None), ("push", "https://h.example.com/x", "t"), ("push", "https://evil.com", None), ("sse", "u", None), ("x", None, None), ("push", None, None), ("push", "https://h.example.com", " t")]
    df = spark.createDataFrame(rows, "mode string, url string, token string")
    got = [r.e is None for r in df.select(live.delivery_error(F.col("mode"), F.col("url"), F.col("token"), ["*.example.com"]).alias("e")).collect()]
    assert got == [True, True, False, False, False, False, False]
