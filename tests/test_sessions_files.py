"""Pushed audio, stateful transcripts, whole files, snapshots and stores on small data."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions.text import carry_prompt
from vellum.operators import captions, files, ledger
from vellum.sources import byname, listings, sinks
from vellum.streaming import live, session


def run(df, spark, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def test_pushed_pieces_are_a_stream_of_frames(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    for seq, (values, last) in enumerate((([0, 16384], False), ([-32768], False), ([], True))):
        session.put_audio(spark, folder, "s1", seq, np.array(values, "<i2").tobytes(), last)
    for seq, last in ((0, False), (2, False), (2, True), (3, False), (1, True)):  # there already, or behind the end
        with pytest.raises(OSError):
            session.put_audio(spark, folder, "s1", seq, b"ab", last)
    got = sorted(run(session.pushed_frames(spark, folder, 1), spark, tmp_path, "pushed"), key=lambda r: r.seq)
    assert [(r.session, r.seq, r.samples, r["last"]) for r in got] == [("s1", 0, [0.0, 0.5], False), ("s1", 1, [-1.0], False), ("s1", 2, [], True)]


def test_streamed_transcripts_carry_text_and_count_what_is_sent(spark, tmp_path):
    def opener():
        def model(x, prompt):
            if x[0] < 0:
                raise ValueError("bad")
            return "" if x[0] == 0 else f"w{int(x[0])}({prompt})"

        return model

    schema = "session string, seq long, queued double, wall_start double, wall_end double, samples array<float>"
    rows = [("s", 0, 99.0, 1.0, 2.0, [1.0]), ("s", 1, 10.0, 2.0, 3.0, [2.0]), ("s", 2, 99.0, 3.0, 4.0, [0.0]), ("s", 3, 99.0, 4.0, 5.0, [-1.0]), ("s", 4, 99.0, 5.0, 6.0, [3.0]), ("t", 0, 99.0, 0.0, 1.0, [4.0])]
    for k in (0, 3):  # two files, so two batches with the state between them
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/seg")
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/seg")
    got = run(session.transcripts(df, opener, "names", clock=lambda: 100.0), spark, tmp_path, "said")
    of = lambda s: [(r.id, r.kind, r.sequence, r.text) for r in sorted(got, key=lambda r: r.id) if r.session == s]
    assert of("s") == [(1, "transcript", 1, "w1(names)"), (2, "dropped", None, None), (3, "error", None, "ValueError"), (4, "transcript", 2, "w3(names w1(names))")]
    assert of("t") == [(1, "transcript", 1, "w4(names)")]
    kept = live.resumed(spark.createDataFrame(got), 1, 2)
    assert sorted((r.session, r.id) for r in kept.collect()) == [("s", 3), ("s", 4)]


def test_carried_equals_the_column_form(spark):
    rows = [(p, t) for p in ("names", " ", None) for t in ("one two three", "onetwothree", "ab cd", None, "", "xx y zzzz")]
    for most in (4, 6, 30):
        got = spark.createDataFrame(rows, "p string, t string").select("p", "t", carry_prompt(F.col("p"), F.col("t"), most).alias("c")).collect()
        assert all(r.c == files.carried(r.p, r.t, most) for r in got), most


def test_pause_and_its_fallback():
    x = np.ones(100, np.float32)
    x[60:70] = 0
    assert files.quietest(x, 100) == 65 and files.quietest(x[:5], 100) is None
    assert files.pause(x, 100, lambda s, r: [(0, 20), (55, 100)]) == 37
    assert files.pause(x, 100, lambda s, r: [(0, 50), (60, 100)]) is None

    def broken(s, r):
        raise RuntimeError

    assert files.pause(x, 100, broken) == 65


def test_whole_files_are_cut_in_pauses_and_put_together(spark):
    x = np.ones(1600, np.float32)
    x[520:540] = 0
    media = spark.createDataFrame([("a", x.tolist()), ("b", [1.0] * 300), ("c", [])], "id string, samples array<float>")
    results, whole = files.transcribed(media, lambda: lambda s, p: f"{len(s)}", 5.0, 100, language="xx", model="m")
    # frames of ten samples from 375 on: the one wholly inside the silence is 525 to 535
    assert sorted((r.job, r["index"], r.text) for r in results.collect()) == [("a", 0, "530"), ("a", 1, "470"), ("a", 2, "600"), ("b", 0, "300")]
    assert sorted((r.job, r.text, r.complete, r.models) for r in whole.collect()) == [("a", "530 470 600", True, ["m"]), ("b", "300", True, ["m"])]


def test_normalizer_failures_are_results(spark):
    rows = spark.createDataFrame([("x", b"ab"), ("y", b"")], "path string, content binary")

    def convert():
        def one(raw, name):
            if not raw:
                raise ValueError
            return raw[::-1]

        return one

    got = {r.path: (r.wav, r.failure) for r in files.normalised(rows, convert).collect()}
    assert got == {"x": (bytearray(b"ba"), None), "y": (None, "audio_undecodable")}


def test_snapshot_is_gated_ordered_and_described(spark, tmp_path):
    schema = "position long, file string, text string, duration double, quality_score double, speaker_id string, content binary"
    rows = [(7, "c.wav", "c", 3.0, 1.0, None, b"c"), (2, "a.wav", "a", 1.0, None, "s", b"a"), (5, "b.wav", "b", 99.0, 1.0, None, b"b")]
    said = sinks.write_snapshot(spark.createDataFrame(rows, schema), {"corpus_id": 4}, f"{tmp_path}/snap")
    h = lambda b: hashlib.sha256(b).hexdigest()
    leaf = h((h(b"a") + h(b"c")).encode())
    assert said == {"corpus_id": 4, "recording_count": 2, "total_duration_seconds": 4.0, "has_speaker_id": True, "content_hash": h(h(leaf.encode()).encode())}
    with pytest.raises(ValueError):
        sinks.write_snapshot(spark.createDataFrame(rows, schema), {}, f"{tmp_path}/snap")
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "snapshot.json").write_text(json.dumps({"corpus_id": 4, "content_hash": "h"}))
    assert tuple(listings.snapshot_source(spark, f"{tmp_path}/old").first()) == (4, "h")
    assert tuple(listings.build_source(spark, f"{tmp_path}/old").first()) == (None, None)
    (tmp_path / "old" / "build_metadata.json").write_text('{"dataset_version": "v1"}')
    (tmp_path / "old" / "manifest.json").write_bytes(b"[]")
    assert tuple(listings.build_source(spark, f"{tmp_path}/old").first()) == ("v1", h(b"[]"))


def test_positions_follow_the_order(spark):
    rows = spark.range(0, 500).select((F.col("id") * 3 % 1000).alias("k"), F.col("id").alias("v"))
    got = sorted((r.k, r.v) for r in ledger.with_positions(rows, "k").collect())
    assert [k for k, _ in got] == list(range(500)) and [v for _, v in got] == [v for _, v in sorted((v * 3 % 1000, v) for v in range(500))]


def test_stores_and_chunk_results(spark, tmp_path):
    one = spark.createDataFrame([("aa1", b"1"), ("aa1", b"1"), ("bb2", b"2")], "sha256 string, content binary")
    sinks.store_contents(one, f"{tmp_path}/store")
    was = (tmp_path / "store" / "aa" / "aa1.wav").stat().st_mtime_ns
    sinks.store_contents(one.union(spark.createDataFrame([("cc3", b"3")], one.schema)), f"{tmp_path}/store")
    assert sorted((r.sha256, bytes(r.content)) for r in sinks.stored_contents(spark, f"{tmp_path}/store").collect()) == [("aa1", b"1"), ("bb2", b"2"), ("cc3", b"3")]
    assert (tmp_path / "store" / "aa" / "aa1.wav").stat().st_mtime_ns == was
    schema = "job string, index int, text string, language string, at int"
    write = lambda rows: sinks.write_chunk_results(spark.createDataFrame(rows, schema), f"{tmp_path}/jobs", "at")
    write([("j", 0, "old", "fi", 1), ("j", 0, "x", "fi", 2), ("k", 1, "y", None, 1)])
    assert sorted((r.job, r["index"], r.text, r.language) for r in listings.read_chunks(spark, f"{tmp_path}/jobs").collect()) == [("j", 0, "x", "fi"), ("k", 1, "y", None)]
    write([("j", 0, "newer", "sv", 3)])
    assert sorted((r.job, r["index"], r.text) for r in listings.read_chunks(spark, f"{tmp_path}/jobs").collect()) == [("j", 0, "newer"), ("k", 1, "y")]


def test_small_files_are_replaced_whole(spark, tmp_path):
    for k in range(7):
        sinks.append_rate(spark, f"file://{tmp_path}/rate.json", 10 * k + 0.12349, 1.0)
    assert [x["audio_seconds"] for x in json.loads((tmp_path / "rate.json").read_text())] == [20.123, 30.123, 40.123, 50.123, 60.123]
    sinks.write_record(spark, f"file://{tmp_path}/gate.json", {"verdict": "pass", "wer": {"a": 0.5}, "note": "ä"})
    assert json.loads((tmp_path / "gate.json").read_text()) == {"verdict": "pass", "wer": {"a": 0.5}, "note": "ä"} and sorted(os.listdir(tmp_path)) == ["gate.json", "rate.json"]


def logged_opener(log):
    """Opens local files and writes down their names and the bytes read."""

    def open_file(path):
        from vellum.sources.byname import open_path

        inner = open_path(path)

        class Logged:
            def read(self, n=None):
                data = inner.read() if n is None else inner.read(n)
                with open(log, "a") as f:
                    f.write(f"{path.rsplit('/', 1)[1]} {len(data)}\n")
                return data

            def seek(self, at):
                return inner.seek(at)

            def size(self):
                return inner.size()

            def close(self):
                inner.close()

        return Logged()

    return open_file


def test_only_wanted_files_are_opened(spark, tmp_path):
    (tmp_path / "audio" / "p").mkdir(parents=True)
    for k in range(40):
        (tmp_path / "audio" / "p" / f"{k}.wav").write_bytes(b"w%d" % k)
    wanted = spark.createDataFrame([("p/1.wav", "a"), ("p/99.wav", "b"), ("/p/7.wav", "c"), (None, "d"), ("p/1.wav", "e")], "audio_path string, note string")
    log = tmp_path / "log"
    got = byname.read_files(wanted, f"file://{tmp_path}/audio", open_file=logged_opener(str(log)))
    assert {r.note: r.content and bytes(r.content) for r in got.collect()} == {"a": b"w1", "b": None, "c": b"w7", "d": None, "e": b"w1"}
    assert set(log.read_text().split()[::2]) == {"1.wav", "7.wav"}
    assert {r.audio_path: r.content and bytes(r.content) for r in listings.read_audio(spark, f"{tmp_path}/audio", wanted.select("audio_path").distinct()).collect()} == {"p/1.wav": b"w1", "p/99.wav": None, "/p/7.wav": b"w7", None: None}
    with pytest.raises(Exception, match="below its root"):
        byname.read_files(spark.createDataFrame([("../x",)], "audio_path string"), str(tmp_path)).collect()


def test_bytes_read_grow_with_the_wanted_ranges(spark, tmp_path):
    data = bytes(range(256)) * 4000
    (tmp_path / "big").write_bytes(data)
    log = tmp_path / "log"
    rows = [("big", k * 1000, 10, k) for k in range(20)] + [("big", len(data) - 4, 10, 20), ("big", -5, 10, 21), ("big", len(data) + 9, 3, 22), ("none", 0, 1, 23)]
    got = byname.read_ranges(spark.createDataFrame(rows, "path string, start long, length long, k int"), str(tmp_path), open_file=logged_opener(str(log))).collect()
    want = {k: None if p == "none" else data[max(0, a) : max(0, a + n)] for p, a, n, k in rows}
    assert {r.k: r.content if r.content is None else bytes(r.content) for r in got} == want
    assert sum(int(x) for x in log.read_text().split()[1::2]) == sum(len(x) for x in want.values() if x)


def test_samples_are_read_by_range(spark, tmp_path):
    x = (np.arange(30_000) % 2000 - 1000).astype("<i2")
    head = b"RIFF" + (36 + 60_000 + 9008).to_bytes(4, "little") + b"WAVELIST" + (9000).to_bytes(4, "little") + b"\0" * 9000 + b"fmt " + bytes.fromhex("10000000010001000004000000080000020010 00".replace(" ", ""))
    (tmp_path / "a.wav").write_bytes(head + b"data" + (60_000).to_bytes(4, "little") + x.tobytes())
    log = tmp_path / "log"
    rows = [("a.wav", 100, 110, 0), ("a.wav", 29_990, 40_000, 1), ("a.wav", -3, 2, 2), ("a.wav", 9, 3, 3), ("b.wav", 0, 1, 4)]
    got = {r.k: r.samples for r in byname.read_samples(spark.createDataFrame(rows, "path string, start_sample long, end_sample long, k int"), f"file://{tmp_path}", open_file=logged_opener(str(log))).collect()}
    of = lambda a, b: (x[a:b].astype(np.float32) / 32768).tolist()
    assert got == {0: of(100, 110), 1: of(29_990, 30_000), 2: of(0, 2), 3: [], 4: None}
    assert max(int(n) for n in log.read_text().split()[1::2]) <= 16 * byname.HEAD


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    good = spark.createDataFrame([("a/1", b"x"), ("b", b"y")], "path string, content binary")
    byname.write_files(good, f"file://{tmp_path}/out")
    bad = good.union(spark.createDataFrame([("../evil", b"z")], good.schema))
    with pytest.raises(Exception, match="below its root"):
        byname.write_files(bad, f"file://{tmp_path}/out2")
    assert sorted(os.listdir(tmp_path / "out")) == ["a", "b"] and (tmp_path / "out" / "a" / "1").read_bytes() == b"x"
    assert not (tmp_path / "evil").exists() and not any(n.startswith("_") for n in os.listdir(tmp_path / "out2"))
    byname.write_files(good.selectExpr("path", "cast('new' as binary) as content"), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "b").read_bytes() == b"new"


def test_appended_records_escape_quotes(spark, tmp_path):
    cues = spark.createDataFrame([(1.0, 2.0, "a \"b\" & 'c' <d>")], "start double, end double, text string")
    captions.append_records(captions.quoted_records(cues), f"{tmp_path}/vtt")
    captions.append_records(captions.quoted_records(cues), f"{tmp_path}/vtt")
    assert [r.value for r in spark.read.text(f"{tmp_path}/vtt").collect()] == ["00:00:01.000 --> 00:00:02.000", "a &quot;b&quot; &amp; &#x27;c&#x27; &lt;d&gt;", ""] * 2


def test_chunk_files_are_listed_and_read_in_tasks(spark, tmp_path):
    for name, body in {"j/chunks/00000.json": '{"text": "a"}', "j/chunks/00001.json": '{"text": ', "j/chunks/x.json": '{"text": "no"}', "j/chunks/00002.json": "", "k/chunks/00007.json": '{"text": "b", "language": "fi"}\n', "k/job.json": "{}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    for root in (str(tmp_path), f"file://{tmp_path}"):
        got = listings.read_chunks(spark, root)
        assert sorted((r.job, r["index"], r.text, r.language) for r in got.collect()) == [("j", 0, "a", None), ("k", 7, "b", "fi")]
        assert not got.inputFiles()  # no file is listed on the driver
    with pytest.raises(Exception, match="FileNotFound"):
        listings.read_chunks(spark, f"{tmp_path}/none").count()
