"""Readers, sinks and live streams on small files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import splits
from vellum.sources import listings, sinks, wav
from vellum.streaming import delay, hearing, live


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    mode = "wb" if isinstance(content, bytes) else "w"
    with open(path, mode) as f:
        f.write(content if isinstance(content, (bytes, str)) else json.dumps(content))


def export_of(rows, kind="text"):
    return {"corpus": {"id": 3, "type": kind}, "total_recordings": len(rows), "recordings": rows}


def test_export_and_listing(spark, tmp_path):
    rows = [{"recording_id": 1, "file": "0001.wav", "audio_url": "/a/1.webm", "original_path": "/o/1", "text": " x\\ny ", "speaker_id": 5}, {"recording_id": 2, "file": "0002.wav", "audio_url": "", "original_path": "o/2", "text": None, "speaker_id": "s"}]
    put(f"{tmp_path}/e.json", export_of(rows))
    export = listings.read_export(spark, f"{tmp_path}/e.json")
    got = listings.listing(export, None).orderBy("recording_id").collect()
    assert [(r.recording_id, r.audio_path, r.text) for r in got] == [(1, "a/1.webm", "x y"), (2, "o/2", None)]
    put(f"{tmp_path}/none.json", {"error": "No recordings found"})
    assert listings.read_export(spark, f"{tmp_path}/none.json").count() == 0
    for bad in ({"error": "boom"}, export_of([], "music")):
        put(f"{tmp_path}/bad.json", bad)
        with pytest.raises(ValueError):
            listings.read_export(spark, f"{tmp_path}/bad.json")


def test_pairing_through_the_manifest(spark, tmp_path):
    rows = [{"file": f"000{k}.wav", "text": f"t {k}", "speaker_id": None} for k in (1, 2)]
    files = [{"id": 10 + k, "export_name": f"000{k}.wav", "source_path": f"/p/{k}", "text": f"t  {k}", "speaker_id": "m"} for k in (1, 2)]
    put(f"{tmp_path}/e.json", export_of(rows))
    put(f"{tmp_path}/m.json", {"total": 2, "files": files})
    put(f"{tmp_path}/shifted.json", {"total": 2, "files": [files[0] | {"text": "t 2"}, files[1]]})
    export, tries = listings.read_export(spark, f"{tmp_path}/e.json"), []

    def fetch():
        tries.append(1)
        return listings.read_manifest(spark, f"{tmp_path}/{'shifted' if len(tries) == 1 else 'm'}.json")

    got = listings.listing(export, fetch).orderBy("recording_id").collect()
    assert len(tries) == 2 and [(r.recording_id, r.audio_path, r.text) for r in got] == [(11, "p/1", "t 1"), (12, "p/2", "t 2")]
    with pytest.raises(ValueError):
        listings.listing(export, lambda: listings.read_manifest(spark, f"{tmp_path}/shifted.json"))


def test_empty_listing(spark):
    df = spark.createDataFrame([(404, '{"error": "No recordings FOUND"}'), (404, "x"), (500, '{"error": "no recordings found"}'), (404, None)], "status int, body string")
    assert [r.e for r in df.select(listings.empty_listing(F.col("status"), F.col("body")).alias("e")).collect()] == [True, False, False, False]


def test_jobs_and_chunks_skip_unreadable_files(spark, tmp_path):
    put(f"{tmp_path}/a/job.json", {"id": "a", "status": "queued", "created_at": "2"})
    put(f"{tmp_path}/b/job.json", {"id": "b", "status": "running", "created_at": "1"})
    put(f"{tmp_path}/c/job.json", "{broken")
    put(f"{tmp_path}/a/chunks/00000.json", {"text": "x"})
    put(f"{tmp_path}/a/chunks/00002.json", "{")
    put(f"{tmp_path}/a/chunks/00003.json.tmp", {"text": "y"})
    assert [r.id for r in listings.read_jobs(spark, str(tmp_path)).collect()] == ["b", "a"]
    assert [(r.job, r["index"], r.text) for r in listings.read_chunks(spark, str(tmp_path)).collect()] == [("a", 0, "x")]


def test_texts_snapshot_and_nodes(spark, tmp_path):
    put(f"{tmp_path}/t/a.txt", "﻿ab  c\n")
    put(f"{tmp_path}/t/b.txt", "kä".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in listings.read_texts(spark, f"{tmp_path}/t").collect()}
    assert got == {"a.txt": "ab c", "b.txt": "kä"}
    put(f"{tmp_path}/s/recordings.json", [{"file": "1.wav", "text": "x", "duration": 1.0, "speaker_id": ""}])
    put(f"{tmp_path}/s/audio/1.wav", b"abc")
    import hashlib

    row = listings.read_snapshot(spark, f"{tmp_path}/s").first()
    assert row.audio_sha256 == hashlib.sha256(b"abc").hexdigest() and row.speaker_id is None
    put(f"{tmp_path}/m/x/y/gate.json", {"dataset_version": "v"})
    assert listings.read_json_nodes(spark, f"{tmp_path}/m", "gate.json").count() == 1
    assert listings.folder_bytes(spark, f"{tmp_path}/s").first()["bytes"] > 3


def test_ordered_hash_depends_on_order_only_through_positions(spark):
    rows = [(k, f"c{k}") for k in range(30)]
    one = listings.ordered_hash(spark.createDataFrame(rows, "p long, c string"), "p", "c", fan=4).first().content_hash
    two = listings.ordered_hash(spark.createDataFrame(rows[::-1], "p long, c string").repartition(5), "p", "c", fan=4).first().content_hash
    rows[3], rows[4] = (3, "c4"), (4, "c3")
    three = listings.ordered_hash(spark.createDataFrame(rows, "p long, c string"), "p", "c", fan=4).first().content_hash
    assert one == two != three


def test_versions_are_committed_last_and_never_mixed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "train", "h", "a", 1.0), (2, "s", "dev", "h2", "b", 1.0)], "recording_id long, speaker_id string, split string, text_hash string, audio_sha256 string, duration double")
    write = lambda **k: sinks.write_version(rows, splits.manifest(rows), {"n": 2}, str(tmp_path), "v1", **k)
    assert write() and not write() and write(force=True)
    assert listings.read_split(spark, f"{tmp_path}/v1/rows", "dev").count() == 1
    with pytest.raises(ValueError):
        listings.require_splits(spark, f"{tmp_path}/v1/rows")
    put(f"{tmp_path}/foreign/x.txt", "mine")
    with pytest.raises(ValueError):
        sinks.clear(spark, f"{tmp_path}/foreign")
    assert sinks.current_version(spark, f"{tmp_path}/table") == 0
    sinks.write_table_version(rows, f"{tmp_path}/table", 1)
    sinks.write_table_version(rows, f"{tmp_path}/table", 2)
    assert sinks.current_version(spark, f"{tmp_path}/table") == 2
    files = spark.createDataFrame([("a",), ("a",), ("b",)], "sha256 string")
    assert [r.sha256 for r in sinks.new_contents(files, files.where("sha256 = 'b'")).collect()] == ["a"]
    with pytest.raises(ValueError):
        sinks.checked_fields({"status", "x"}, {"status"})


def test_wav_columns(spark):
    x = np.array([0, 0.5, -1, 1, 0.25], np.float32)
    df = spark.createDataFrame([(x.tolist(),), ([],)], "x array<float>").select(wav.encoded(F.col("x"), 100).alias("w")).union(spark.createDataFrame([(b"junk",), (None,)], "w binary"))
    got = df.select(wav.header(F.col("w")).alias("h"), "w").select("h.*", wav.samples(F.col("w"), F.col("h"), F.lit(1), F.lit(99)).alias("s"), wav.duration(F.col("h")).alias("d")).collect()
    assert [(r.rate, r.num_samples) for r in got] == [(100, 5), (100, 0), (None, None), (None, None)]
    assert got[0].s == [0.5, -1.0, 32767 / 32768, 0.25] and got[0].d == 0.05 and got[2].s is None
    assert spark.createDataFrame([([3.0, 4.0, 1.0, 1.0, 9.0],)], "x array<float>").select(wav.frame_levels(F.col("x"), 2)).first()[0] == [np.sqrt(12.5), 1.0]


RULES = hearing.SegmentRules(sample_rate=1000)


def tone(seconds, loud):
    t = np.arange(int(seconds * 1000))
    return (0.5 * np.sin(t) if loud else np.zeros(len(t))).astype(np.float32)


def fed(parts, step=400):
    samples, ear = np.concatenate(parts), hearing.Ear(RULES)
    return [x for at in range(0, len(samples), step) for x in ear.hear(samples[at : at + step])] + ear.finish()


def test_segments_end_at_pauses_and_at_the_longest():
    two = fed([tone(1, False), tone(2, True), tone(1, False), tone(2, True), tone(1, False)])
    assert len(two) == 2 and abs(two[0][0] - 850) <= 60 and abs(two[0][1] - 3150) <= 60
    long = fed([tone(25, True)])
    assert [b - a for a, b in long[:2]] == [10000, 10000]
    gap = fed([tone(6, True), tone(0.4, False), tone(8, True), tone(1, False)])
    assert abs(gap[0][1] - 6200) <= 60
    assert fed([tone(5, False)]) == []
    short = fed([tone(0.4, True), tone(3, False)])
    assert len(short) == 1 and short[0][1] - short[0][0] < 1000


def stream(spark, tmp_path, rows, schema, name):
    folder = f"{tmp_path}/{name}-in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def run(df, spark, tmp_path, name, **trigger):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(**trigger or {"availableNow": True}).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def test_streamed_segments_equal_the_batch_ones(spark, tmp_path):
    samples = np.concatenate([tone(1, False), tone(2, True), tone(1, False), tone(3, True), tone(1, False)])
    rows = [("s", k, samples[at : at + 400].tolist(), at + 400 >= len(samples)) for k, at in enumerate(range(0, len(samples), 400))]
    frames = stream(spark, tmp_path, rows, "session string, seq long, samples array<float>, last boolean", "seg")
    got = sorted((r.start_sample, r.end_sample) for r in run(hearing.segments(frames, RULES), spark, tmp_path, "seg"))
    assert got == fed([samples])


def test_streamed_delays_equal_the_batch_ones(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"s{k % 2}", k, float(rng.normal(0, 600)), 250.0) for k in range(120)]
    schema = "session string, seq long, mismatch_ms double, tolerance_ms double"
    batch = sorted(map(tuple, delay.delays(spark.createDataFrame(rows, schema)).collect()))
    assert sorted(map(tuple, run(delay.delays(stream(spark, tmp_path, rows, schema, "del")), spark, tmp_path, "del"))) == batch


def test_delay_policy():
    d = delay.Delay().report(100)
    assert (d.target, d.stable, d.reason) == (0.0, 1, "within_tolerance")
    d = delay.Delay().report(3000)
    assert d.target == 0.5 and d.report(3000).target == 1.5 and d.report(-3000) == delay.Delay(target=0.5, reason="caption_early")
    for _ in range(20):
        d = d.report(0)
    assert (d.target, d.reason, d.stable) == (0.25, "stable_step_down", 0)
    assert d.request(7).target == 7 and delay.Delay(target=120).report(9e9).target == 120
    with pytest.raises(ValueError):
        d.request(121)
    with pytest.raises(ValueError):
        d.report(1, -1)


def test_clock_moves_only_when_caught_up(spark):
    rows = [("s", 0, 0, 100.0, True), ("s", 1, 1000, 101.5, True), ("s", 2, 2000, 105.0, False), ("s", 3, 3000, 105.0, True)]
    got = live.anchors(spark.createDataFrame(rows, "session string, seq long, received long, wall double, caught_up boolean"), 1000).orderBy("seq").collect()
    assert [(r.anchor_sample, r.anchor_wall, r.drift) for r in got] == [(0, 100.0, None), (0, 100.0, None), (0, 100.0, None), (3000, 105.0, 2.0)]


def test_delivery_order_and_release(spark):
    rows = [("s", 1.0, "a", 10.0), ("s", 2.0, " ", 11.0), ("s", 3.0, "b", 9.0)]
    sent = live.released(live.numbered(spark.createDataFrame(rows, "session string, start double, text string, wall_end double")), 5)
    assert [(r.sequence, r.release_at) for r in sent.orderBy("sequence").collect()] == [(1, 15.0), (2, 15.0)]
    assert live.due(live.numbered(spark.createDataFrame(rows, "session string, start double, text string, wall_end double")), F.lit(14.9), 5).count() == 0


def test_hold_back_releases_in_order(spark, tmp_path):
    rows = [("s", 2, 11.0, "b"), ("s", 1, 12.0, "a"), ("s", 3, 99.0, "c")]
    df = stream(spark, tmp_path, rows, "session string, sequence long, wall_end double, text string", "hold")
    got = run(live.hold_back(df, 5.0, clock=lambda: 20.0), spark, tmp_path, "hold", once=True)
    assert [r.sequence for r in got] == [1, 2]


def test_push_batches_and_outcomes(spark, tmp_path):
    events = spark.createDataFrame([("s", k, "p") for k in range(45)], "session string, id long, payload string")
    assert [len(r["items"]) for r in live.push_batches(events).orderBy("batch").collect()] == [20, 20, 5]
    assert [live.outcome(s) for s in (200, 204, 500, 429, 401, 403, None, 400, 302)] == ["sent", "sent", "retry", "retry", "retry", "retry", "retry", "drop", "drop"]
    log = f"{tmp_path}/log"

    def send(session, items):
        with open(log, "a") as f:
            f.write(f"{items[0]['id']} {len(items)}\n")
        with open(log) as f:
            return 500 if len(f.readlines()) == 1 else 200

    df = stream(spark, tmp_path, [("s", k, "p") for k in range(25)], "session string, id long, payload string", "push")
    q = live.push(df, send, f"{tmp_path}/cp", wait=lambda s: None).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert open(log).read().split("\n")[:3] == ["0 20", "0 20", "20 5"]
    assert [r.id for r in live.resumed(events, 40, 3).orderBy("id").collect()] == [42, 43, 44]


def test_a_batch_that_is_never_taken_stops_the_stream_and_is_replayed(spark, tmp_path):
    df = stream(spark, tmp_path, [("s", k, "p") for k in range(25)], "session string, id long, payload string", "failing")
    log = tmp_path / "log"

    def down(session, items):
        return 503

    with pytest.raises(Exception, match="was not taken"):
        live.push(df, down, f"{tmp_path}/cp2", wait=lambda s: None).trigger(availableNow=True).start().awaitTermination()

    def up(session, items):
        with open(log, "a") as f:
            f.write(f"{items[0]['id']} {len(items)}\n")
        return 200

    live.push(df, up, f"{tmp_path}/cp2", wait=lambda s: None).trigger(availableNow=True).start().awaitTermination()
    assert log.read_text().split("\n")[:2] == ["0 20", "20 5"]


def test_refused_batches_are_counted(spark, tmp_path):
    df = stream(spark, tmp_path, [("s", k, "p") for k in range(25)], "session string, id long, payload string", "refused")
    dropped = spark.sparkContext.accumulator(0)
    live.push(df, lambda session, items: 400, f"{tmp_path}/cp3", dropped=dropped).trigger(availableNow=True).start().awaitTermination()
    assert dropped.value == 25


def test_manifest_errors_are_not_empty_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"error": "the server broke"}')
    with pytest.raises(ValueError, match="server broke"):
        listings.read_manifest(spark, str(tmp_path / "m.json"))
    (tmp_path / "e.json").write_text('{"error": "No recordings found for this corpus"}')
    assert listings.read_manifest(spark, str(tmp_path / "e.json")).count() == 0
