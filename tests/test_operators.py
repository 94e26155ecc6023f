"""Ledger, builds, metrics, jobs, captions, lineage and registry on small tables."""

import json
import hashlib

import pytest
from pyspark.sql import functions as F

from vellum.functions.speakers import split_salt
from vellum.operators import captions, jobs, ledger, lineage, metrics, registry, splits

NOW = "2024-05-01T00:00:00Z"


def ledger_of(spark, rows):
    full = [(i, 1, s, t, h, a, p, 3.0, 1.0, None, st, "old", "old", None) for i, s, t, h, a, p, st in rows]
    return spark.createDataFrame(full, ledger.LEDGER)


def listing_of(spark, rows):
    return spark.createDataFrame(rows, "recording_id long, speaker_id string, speaker_reason string, text string, text_hash string, audio_path string, quality_score double, audio_sha256 string, duration double, failure string")


def test_sync_classifies_and_changes(spark):
    old = ledger_of(spark, [(1, "s", "t1", "h1", "a1", "p1", "active"), (2, "s", "t2", "h2", "a2", "p2", "active"), (3, "s", "t3", "h3", "a3", "p3", "active"), (4, None, None, None, None, None, "removed")])
    rejected = spark.createDataFrame([(7, 1, "audio_undecodable", "p7", "old"), (9, 1, "audio_undecodable", "p9", "old")], ledger.REJECTED)
    new = listing_of(spark, [
        (1, "s", None, "t1", "h1", "p1", 1.0, "a1", 3.0, None), (2, "s2", "speaker_id_email_dropped", "t2", "h2", "p2", 1.0, "zz", 9.0, None), (4, "s", None, "t4", "h4", "p4", 1.0, "a4", 2.0, None),
        (5, "s", None, "", None, "p5", 1.0, "a5", 2.0, None), (6, "s", None, "t6", "h6", None, 1.0, "a6", 2.0, None), (7, "s", None, "t7", "h7", "p7", 1.0, "a7", 2.0, None), (8, "s", None, "t8", "h8", "p8", 1.0, "a8", 31.0, None),
    ])
    after, bad, marked = ledger.sync(old, rejected, new, 1, NOW)
    action = {r.recording_id: (r.action, r.reason) for r in marked.collect()}
    assert action == {1: ("unchanged", None), 2: ("updated", None), 3: ("removed", None), 4: ("added", None), 5: ("skipped", "empty_text"), 6: ("skipped", "missing_audio_path"), 7: ("skipped", "previously_rejected"), 8: ("skipped", "duration_out_of_range")}
    got = {r.recording_id: r for r in after.collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[3].status == "removed" and got[3].text is None and got[3].removed_at == NOW and got[3].first_seen == "old" and got[3].last_seen == "old"
    assert got[4].status == "active" and got[4].first_seen == "old" and got[4].removed_at is None
    assert (got[2].speaker_id, got[2].audio_sha256, got[2].duration) == ("s2", "a2", 3.0)
    assert got[1].last_seen == NOW
    assert {r.recording_id: r.first_seen for r in bad.collect()} == {7: "old", 8: NOW}
    assert {r.reason: r.n for r in ledger.skip_counts(marked).collect()}["speaker_id_email_dropped"] == 1
    again = ledger.removed(after, spark.createDataFrame([(3,)], "recording_id long"), "later")
    assert again.where("removed_at = 'later'").count() == 0


@pytest.mark.parametrize("n,left,refused", [(5, 0, False), (6, 0, True), (12, 6, False), (12, 5, True), (0, 0, False)])
def test_mass_removal_needs_both_limits(spark, n, left, refused):
    old = ledger_of(spark, [(k, "s", "t", "h", "a", "p", "active") for k in range(n)])
    new = listing_of(spark, [(k, "s", None, "t", "h", "p", 1.0, "a", 1.0, None) for k in range(left)])
    assert ledger.mass_removal(old, new).first().refused == refused
    if refused:
        with pytest.raises(ledger.MassRemoval):
            ledger.sync(old, spark.createDataFrame([], ledger.REJECTED), new, 1, NOW)


def test_shared_audio(spark):
    old = ledger_of(spark, [(1, "x", "t", "h", "a", "p", "active"), (2, "y", "t", "h", "a", "p", "active"), (3, "x", "t", "h", "b", "p", "active"), (4, "y", None, None, "b", None, "removed")])
    ids = old.where("speaker_id = 'x'").select("recording_id")
    assert [r.audio_sha256 for r in ledger.erasable_hashes(old, ids).collect()] == ["b"]


def test_guard_takes_null_hashes_as_equal(spark):
    rows = spark.createDataFrame([(1, "s", "dev", "h1"), (2, "s", "test", None), (3, "a", "train", "h1"), (4, "b", "train", None), (5, "c", "train", "h5")], "recording_id long, speaker_id string, split string, text_hash string")
    assert {r.recording_id for r in splits.guarded(rows).collect()} == {1, 2, 5}
    s = splits.leakage_stats(rows).first()
    assert (s.train_rows_before, s.train_dropped, s.train_speakers_lost) == (3, 2, 2)
    assert splits.speaker_disjoint(rows).first().speaker_disjoint is False
    assert splits.speaker_disjoint(rows.limit(0)).first().speaker_disjoint is True
    with pytest.raises(ValueError):
        splits.check_build(splits.leakage_stats(rows), splits.split_sizes(rows), 0.5)
    with pytest.raises(ValueError):
        splits.check_build(splits.leakage_stats(rows), splits.split_sizes(rows.where("split <> 'dev'")))


def test_version_is_the_hash_of_the_canonical_json(spark):
    ratios = {"train": 0.8, "dev": 0.1, "test": 0.1}
    rows = [(2, "h2", None, "ä"), (1, "h1", "a1", None)]
    payload = {"v": 1, "rows": [list(r) for r in sorted(rows)], "split": {"ratios": ratios, "salt": split_salt(42)}}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    df = spark.createDataFrame(rows, "recording_id long, text_hash string, audio_sha256 string, speaker_id string")
    assert splits.dataset_version(df, ratios) == want


def test_rates_are_ratios_of_sums(spark):
    rows = [("a b c d", "a x c d"), ("", "extra words"), (None, None), ("e", "e")]
    m = metrics.metrics(spark.createDataFrame(rows, "reference string, hypothesis string")).first()
    assert (m.n, m.reference_words, m.wer) == (4, 5, 0.6)
    none = metrics.metrics(spark.createDataFrame([("", "x")], "reference string, hypothesis string")).first()
    assert none.wer is None


def test_speaker_spread(spark):
    rows = spark.createDataFrame([("a", 0.0, False), ("b", 0.25, False), ("c", 0.5, False), ("d", 1.0, True)], "speaker_id string, wer double, low_audio boolean")
    s = metrics.speaker_spread(rows, 2).first()
    assert (s.n_speakers, s.n_low_audio, s.wer_median) == (4, 1, 0.375) and abs(s.wer_p90 - 0.85) < 1e-9 and abs(s.reliable_p90 - 0.45) < 1e-9


def test_per_speaker_marks_little_audio(spark):
    rows = [("a", "x y", "x z", 40.0), ("a", "x", "x", None), ("b", "x", "x", 5.0), (None, "x", "q", 9.0), ("", "x", "q", 9.0)]
    got = {r.speaker_id: r for r in metrics.per_speaker(spark.createDataFrame(rows, "speaker_id string, reference string, hypothesis string, audio_seconds double")).collect()}
    assert set(got) == {"a", "b"} and got["a"].wer == round(1 / 3, 6) and not got["a"].low_audio and got["b"].low_audio


def test_gate_columns(spark):
    rows = [(0.1, 0.2, 0.0, True), (0.2, 0.2, 0.0, False), (0.19, 0.2, 0.1, False), (None, 0.2, 0.0, False), (0.0, 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "c double, b double, least double, want boolean")
    assert all(r.want == r.got for r in df.select("want", metrics.beats_baseline(F.col("c"), F.col("b"), F.col("least")).alias("got")).collect())
    one = spark.range(1).select(metrics.verdict(F.lit(None).cast("boolean")).alias("empty"), metrics.verdict(F.lit(True), F.lit(None).cast("boolean")).alias("t"), metrics.verdict(F.lit(True), F.lit(False)).alias("f"), metrics.longform_check(F.lit(True), F.lit(False), F.lit(True)).alias("need")).first()
    assert (one.empty, one.t, one.f, one.need) == (True, True, False, False)


def test_chunk_plans(spark):
    media = spark.createDataFrame([("a", 15000), ("b", 13000), ("c", 6000), ("d", 0), ("e", 100)], "id string, num_samples long")
    got = {}
    for r in jobs.plan_chunks(media, 60.0, 100).orderBy("id", "index").collect():
        got.setdefault(r.id, []).append((r.start_sample, r.end_sample))
    assert got == {"a": [(0, 6000), (6000, 12000), (12000, 15000)], "b": [(0, 6000), (6000, 13000)], "c": [(0, 6000)], "e": [(0, 100)]}
    gaps = spark.createDataFrame([("a", 6000, 200), ("a", 12000, 0)], "id string, boundary long, offset long")
    snapped = [(r.start_sample, r.end_sample, r.snapped) for r in jobs.plan_chunks(media, 60.0, 100, gaps).where("id = 'a'").orderBy("index").collect()]
    assert snapped == [(0, 5700, True), (5700, 12000, False), (12000, 15000, True)]
    for chunk, window in ((4, 1), (301, 5), (10, 5)):
        with pytest.raises(ValueError):
            jobs.check_plan(chunk, window)


def test_longest_gap_ties_go_to_the_centre(spark):
    speech = spark.createDataFrame([(1, 10, 40), (1, 50, 80)], "id int, start long, end long")
    gaps = jobs.gaps_between(speech, F.lit(90).cast("long"), ["id"])
    assert {(r.gap_start, r.gap_end) for r in gaps.collect()} == {(0, 10), (40, 50), (80, 90)}
    assert jobs.longest_gap(gaps, ["id"], F.lit(45), 5).first().cut == 45
    assert not jobs.longest_gap(gaps, ["id"], F.lit(45), 11).collect()


def test_assembly(spark):
    plan = spark.createDataFrame([("j", 0), ("j", 1), ("j", 2), ("k", 0)], "job string, index int")
    results = spark.createDataFrame([("j", 0, " a ", "", "m1"), ("j", 2, "c", "fi", "m2"), ("j", 9, "x", "sv", "m9"), ("k", 0, "", None, None)], "job string, index int, text string, language string, model string")
    got = {r.job: r for r in jobs.assemble(plan, results).collect()}
    assert (got["j"].text, got["j"].language, got["j"].models, got["j"].chunks_done, got["j"].complete) == ("a c", "fi", ["m1", "m2"], 2, False)
    assert got["k"].complete and got["k"].text == "" and got["k"].models == []
    with pytest.raises(ValueError):
        jobs.require_complete(jobs.assemble(plan, results))
    assert [(r.job, r.resume_at) for r in jobs.resume_points(plan, results.select("job", "index")).collect()] == [("j", 1)]


def test_queue_estimates(spark):
    rows = [("r", "running", 0, 100.0, 40.0), ("a", "queued", 1, 50.0, None), ("b", "queued", 2, None, None), ("c", "queued", 3, 20.0, None), ("x", "completed", 0, 9.0, None)]
    df = spark.createDataFrame(rows, "id string, status string, created_at int, duration double, current double")
    got = {r.id: r for r in jobs.queue_overview(df, 2.0).collect()}
    assert (got["a"].position, got["a"].seconds_ahead, got["a"].estimated_start_seconds, got["a"].estimated_finish_seconds) == (1, 60.0, 30.0, 55.0)
    assert (got["b"].seconds_ahead, got["b"].estimated_start_seconds, got["b"].estimated_finish_seconds) == (110.0, 55.0, None)
    assert (got["c"].unknown_ahead, got["c"].estimated_start_seconds) == (1, None)
    s = jobs.queue_summary(df).first()
    assert (s.queued, s.running, s.queued_seconds, s.unknown_duration) == (3, 1, 70.0, 1)


def test_progress(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    base = spark.createDataFrame([([60.0, 120.0, 150.0], d, 150.0, b) for d, b in ((0, 0), (1, 0), (2, 1), (3, 0))] + [([], 0, 0.0, 0)], "ends array<double>, done int, total_seconds double, baseline int")
    df = base.withColumns({"started": at(0), "updated": at(30)})
    got = [(round(r.percent, 1), r.eta_seconds) for r in jobs.progress(df, at(40)).collect()]
    assert got == [(0.0, None), (40.0, 35.0), (80.0, 5.0), (100.0, 0.0), (0.0, None)]


def test_status_and_expiry(spark):
    rows = [("a", "completed", "2024-01-01T00:00:00Z", None), ("b", "running", "2024-01-01T00:00:00Z", None), ("c", "failed", None, "2024-01-01T00:00:00Z"), ("d", "failed", "garbage", None), ("e", "completed", "2024-01-09T00:00:00Z", None)]
    df = spark.createDataFrame(rows, "id string, status string, finished_at string, updated_at string")
    assert {r.id for r in jobs.expired(df, F.lit("2024-01-10").cast("timestamp"), 72).collect()} == {"a", "c"}
    assert jobs.recovered(df).where("status = 'queued'").count() == 1


def test_cues_break_before_a_word(spark):
    def words(tokens, step=0.5):
        return [("d", k, k * step, k * step + 0.4, t, False) for k, t in enumerate(tokens)]

    schema = "doc string, seq int, start double, end double, text string, whole boolean"
    got = captions.make_cues(spark.createDataFrame(words(["One", "two", ".", "Three", "four"]), schema), "doc").orderBy("start").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(0.0, 1.4, "One two."), (1.5, 2.4, "Three four")]
    long = captions.make_cues(spark.createDataFrame(words(["w"] * 40), schema), "doc").collect()
    assert max(r.end - r.start for r in long) <= 7.0
    wide = captions.make_cues(spark.createDataFrame(words(["x" * 30] * 4, 0.1), schema), "doc").orderBy("start").collect()
    assert [len(r.text.replace("\n", "")) for r in wide] == [60, 60]
    mixed = [("d", 0, 0.0, 0.4, "a", False), ("d", 1, 1.0, 0.5, " whole segment ", True), ("d", 2, 2.0, 2.4, "b", False), ("d", 3, None, 3.0, "lost", False)]
    assert [(r.start, r.end, r.text) for r in captions.make_cues(spark.createDataFrame(mixed, schema), "doc").orderBy("start").collect()] == [(0.0, 0.4, "a"), (1.0, 1.0, "whole segment"), (2.0, 2.4, "b")]


def test_caption_formats(spark):
    cues = spark.createDataFrame([("d", 0.0, 1.5, 'a & "b"\nc'), ("d", 3.0, 4.0, " ")], "doc string, start double, end double, text string")
    assert captions.to_vtt(cues.limit(1), "doc").first().content == 'WEBVTT\n\n00:00:00.000 --> 00:00:01.500\na &amp; "b"\nc\n\n'
    assert captions.to_srt(cues, "doc").first().content == '1\n00:00:00,000 --> 00:00:01,500\na & "b"\nc\n\n2\n00:00:03,000 --> 00:00:04,000\n \n\n'
    start = F.lit("2024-01-01 23:59:59.9995").cast("timestamp")
    assert captions.to_youtube(cues, "doc", start, cue="k").first().content == '2024-01-01T23:59:59.999 region:reg1#k\na & "b" c\n'
    with pytest.raises(ValueError):
        captions.to_youtube(cues, "doc", start, region="a b")


def test_words_of_segments(spark):
    seg = "segments array<struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,text:string>>>>"
    df = spark.createDataFrame([([(0.0, 2.0, " t ", [(1.0, 1.5, "b"), (0.0, 0.5, "a")]), (2.0, 3.0, "u", [(0.5, 0.6, "c")])],)], seg)
    moved = df.select(captions.with_offset("segments", "10").alias("segments"))
    assert [(w.start, w.text) for w in moved.select(captions.collected_words("segments").alias("w")).first().w] == [(10.0, "a"), (10.5, "c"), (11.0, "b")]
    assert moved.first().segments[0].text == "t"


def test_lineage_plans(spark):
    rows = [(1, "A", "t", "h", "x", "p", "active"), (2, "A", "t", "h", "y", "p", "active"), (3, "B", "t", "h", "x", "p", "active")]
    manifests = spark.createDataFrame([("A", "va", "train"), ("B", "va", "dev"), ("B", "vb", "train")], "speaker_id string, dataset_version string, split string")
    models = spark.createDataFrame([("m1", "va"), ("m2", "vb"), ("m3", "vold")], "path string, dataset_version string")
    plan = lineage.purge_plan(ledger_of(spark, rows), manifests, spark.createDataFrame([("vold",)], "dataset_version string"), models, "A")
    assert {(r.kind, r.target) for r in plan.collect()} == {("tombstone", "1"), ("tombstone", "2"), ("erase_audio", "y"), ("shared_audio", "x"), ("supersede", "va"), ("review_model", "m1"), ("review_model", "m3")}
    versions = spark.createDataFrame([("v1", 1), ("v2", 2), ("v3", 3)], "version string, created_at int")
    refs = spark.createDataFrame([("m", "v1")], "path string, dataset_version string")
    assert [r.version for r in lineage.retention(versions, refs, 1).collect()] == ["v2"]
    assert {r.version for r in lineage.retention(versions, refs, 1, True).collect()} == {"v1", "v2"}
    files = spark.createDataFrame([("a", "SUPERSEDED.json"), ("b", "build_metadata.json"), ("b", "manifest.json"), ("c", "manifest.json")], "version string, file string")
    assert {r.version: r.state for r in lineage.built_states(files).collect()} == {"a": "superseded", "b": "built", "c": "partial"}
    nodes = spark.createDataFrame([("p", '{"a": [{"dataset_version": "v1"}, {"dataset_version": 3, "b": {"dataset_version": "v2"}}]}'), ("q", "broken"), ("r", None)], "path string, content string")
    assert {(r.path, r.dataset_version) for r in lineage.versions_named(nodes).collect()} == {("p", "v1"), ("p", "v2")}


def test_registry(spark):
    schema = "name string, version string, created_at string, passed boolean"
    versions = spark.createDataFrame([("m", "1", "a", True), ("m", "2", "b", False)], schema)
    current = spark.createDataFrame([("m", "1", "t", "cli", False)], "name string, version string, promoted_at string, promoted_by string, forced boolean")
    with pytest.raises(registry.GateRefused):
        registry.promoted(current, versions, "m", "2", NOW)
    moved = registry.promoted(current, versions, "m", "2", NOW, force=True)
    assert [(r.version, r.forced) for r in moved.collect()] == [("2", True)]
    with pytest.raises(ValueError):
        registry.registered(versions, versions.limit(1))
    assert registry.listing(versions, moved).first().versions == ["1", "2"]
    assert [r.version for r in registry.detail(versions, current, "m").collect()] == ["1"]
    specs = spark.createDataFrame([("registry:m",), ("registry:m@7",), ("large-v3",)], "spec string")
    assert {r.spec: r.label for r in registry.resolved(specs, moved).collect()} == {"registry:m": "m@2", "registry:m@7": "m@7", "large-v3": "large-v3"}
