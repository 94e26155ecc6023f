"""Feeds as streaming sources, pieces in any order, state that ends, and deliveries, against plain loops."""

import io
import random

import numpy as np
import pytest

from vellum.sources import feeds
from vellum.streaming import delivery, ending, hearing

RULES = hearing.SegmentRules(sample_rate=1000)


def run(df, spark, tmp_path, name, checkpoint=None):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{checkpoint or name}-cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def written(df, tmp_path, name, **trigger):
    """Run to the end into files, so that a second run adds to the first."""
    q = df.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(**trigger or {"availableNow": True}).start()
    q.awaitTermination(120)
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}").collect()


def growing_files(path):
    """A feed of files that grow; a session has ended when its file `.end` is there.  The class is local, as tasks cannot import tests."""

    class Files:
        def __init__(self, folder):
            self.folder = folder

        def sessions(self):
            import os

            return {n[:-4]: (os.path.getsize(f"{self.folder}/{n}"), os.path.exists(f"{self.folder}/{n}.end")) for n in os.listdir(self.folder) if n.endswith(".pcm")}

        def open(self, session, start):
            f = open(f"{self.folder}/{session}.pcm", "rb")  # noqa: SIM115
            f.seek(start)
            return f

    return Files(path)


def joined(rows, session):
    own = sorted((r.offset, bytes(r.pcm), r["last"]) for r in rows if r.session == session)
    at = 0
    for offset, pcm, _ in own:
        assert offset == at
        at += len(pcm) // 2
    return b"".join(p for _, p, _ in own), [k for k, x in enumerate(own) if x[2]], len(own)


def test_a_feed_starts_again_at_its_checkpoint_without_loss_or_repeat(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    data = {s: np.random.default_rng(k).bytes(5000 + 2 * k) for k, s in enumerate("abc")}
    (folder / "a.pcm").write_bytes(data["a"][:1001])
    (folder / "b.pcm").write_bytes(data["b"])
    source = lambda: feeds.stream(spark, "growing", growing_files(str(folder)), piece_bytes=301)
    first = written(source(), tmp_path, "grown")
    assert joined(first, "a")[0] == data["a"][:1000] and joined(first, "b") == (data["b"], [], 17)  # half a sample waits
    for s in "abc":
        (folder / f"{s}.pcm").write_bytes(data[s])
    (folder / "b.pcm.end").touch()
    (folder / "c.pcm.end").touch()
    second = written(source(), tmp_path, "grown")
    for s in "abc":
        got, last, n = joined(second, s)
        assert got == data[s] and last == ([] if s == "a" else [n - 1])
    assert len(written(source(), tmp_path, "grown")) == len(second)


def test_a_feed_that_announced_too_much_fails(spark, tmp_path):
    class Short:
        def sessions(self):
            return {"s": (10, True)}

        def open(self, session, start):
            return io.BytesIO(b"abcd")

    with pytest.raises(Exception, match="announced"):
        run(feeds.stream(spark, "short", Short()), spark, tmp_path, "short_feed")


def test_streams_that_break_are_recorded_and_read_back(spark, tmp_path):
    log = tmp_path / "opened"

    def open_stream(source, session, attempt):
        with open(log, "a") as f:
            f.write(f"{session}{attempt} ")

        class Breaking(io.BytesIO):
            def read(self, size):
                out = super().read(size)
                if not out and attempt == 1 and session == "x":
                    raise OSError("gone")
                return out

        return Breaking(f"{source}-{attempt}-".encode() * 50)

    sessions = spark.createDataFrame([("x", "u"), ("y", "v")], "session string, source string")
    folder = f"{tmp_path}/recorded"
    said = {r.session: (r.bytes, r.attempts) for r in feeds.record(sessions, open_stream, folder, piece_bytes=64).collect()}
    assert said == {"x": (400, 2), "y": (200, 1)} and sorted(log.read_text().split()) == ["x1", "x2", "y1"]
    rows = run(feeds.stream(spark, "recorded", feeds.Recorded(folder), piece_bytes=90), spark, tmp_path, "read_back")
    assert joined(rows, "x")[0] == b"u-1-" * 50 + b"u-2-" * 50 and joined(rows, "y") == (b"v-1-" * 50, [2], 3)
    again = {r.session: (r.bytes, r.attempts) for r in feeds.record(sessions, open_stream, folder, piece_bytes=64).collect()}
    assert again == {"x": (400, 0), "y": (200, 0)}


def test_a_lost_recorder_goes_on_behind_what_it_landed(tmp_path):
    (tmp_path / "r" / "s").mkdir(parents=True)
    for name, data in (("000000000000000.pcm", b"abcd"), ("000000000000004.pcm", b"ef"), ("000000000000099.pcm", b"zz"), ("_part", b"half")):
        (tmp_path / "r" / "s" / name).write_bytes(data)
    feed = feeds.Recorded(f"file://{tmp_path}/r")
    assert feed.sessions() == {"s": (6, False)}
    assert feed.open("s", 3).read(2) == b"d" and feeds.Recorded(f"{tmp_path}/none").sessions() == {}


def sound(seed, seconds=40):
    """Speech and silence by turns, over some noise."""
    rng, out = np.random.default_rng(seed), []
    while sum(map(len, out)) < seconds * 1000:
        n = int(rng.integers(50, 6000))
        out += [rng.normal(0, 0.3, n), rng.normal(0, rng.choice([0.0005, 0.004]), int(rng.integers(50, 2500)))]
    return np.concatenate(out)[: seconds * 1000].astype(np.float32)


def plain_levels(x, rate=1000):
    n = int(0.03 * rate)
    return [float(np.sqrt(np.mean(x[k : k + n].astype(np.float64) ** 2))) for k in range(0, len(x) // n * n, n)]


def plain_ranges(x, rate=1000):
    level = plain_levels(x, rate)
    if not level:
        return []
    bar = max(0.008, 3 * min(float(np.percentile(level, 10)), 0.01))
    out, n = [], int(0.03 * rate)
    for k, v in enumerate(level):
        if v > bar:
            if out and k - out[-1][1] <= 6:
                out[-1][1] = k
            else:
                out.append([k, k])
    return [(a * n, (b + 1) * n) for a, b in out if (b + 1 - a) * n >= 0.1 * rate]


@pytest.mark.parametrize("seed", range(6))
def test_levels_that_grow_equal_those_of_the_whole_buffer(seed):
    x, rng = sound(seed, 8), random.Random(seed)
    held, start, end = hearing.Loudness(1000), 0, 0
    while end < len(x):
        end = min(len(x), end + rng.randrange(1, 700))
        held.grow(x[start:end])
        assert np.allclose(held.levels, plain_levels(x[start:end]), rtol=1e-12) and held.ranked == sorted(held.levels)
        assert held.ranges(1000) == plain_ranges(x[start:end]) == hearing.loud_ranges(x[start:end], 1000)
        if rng.random() < 0.3:
            drop = rng.choice([30, 60, 7, 400])
            drop = min(drop, end - start)
            start += drop
            held.shift(drop)


def whole_looks(x, cuts, find):
    """Segments by looking at the whole buffer each time, at the same places of the stream."""
    ear = hearing.Ear(RULES, find)
    return [s for a, b in zip([0, *cuts], [*cuts, len(x)], strict=True) for s in ear.hear(x[a:b])] + ear.finish()


@pytest.mark.parametrize("seed", range(4))
def test_incremental_segments_equal_looks_at_whole_buffers(seed):
    x, rng = sound(seed + 10), random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(x)), 300))
    assert whole_looks(x, cuts, None) == whole_looks(x, cuts, plain_ranges) != []

    def broken(samples, rate):
        raise RuntimeError("no model")

    assert whole_looks(x, cuts, broken) == whole_looks(x, cuts, None)


def test_the_buffer_is_looked_at_on_a_cadence():
    seen = []

    def find(samples, rate):
        seen.append(len(samples))
        return [(0, len(samples))]

    ear = hearing.Ear(RULES, find)
    for _ in range(100):
        ear.hear(np.ones(50, np.float32))
    assert seen == [400 * k for k in range(1, 13)]


def test_a_frame_is_measured_once(monkeypatch):
    measured = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda spec, a, b: measured.append(len(a)) or einsum(spec, a, b))
    ear = hearing.Ear(RULES)
    for _ in range(20):
        ear.hear(np.full(400, 0.5, np.float32))
    assert sum(measured) == 8000 // 30


def pieces_of(x, size):
    return [(at, x[at : at + size].tolist(), at + size >= len(x)) for at in range(0, len(x), size)]


def looped(pieces):
    ear = hearing.Ear(RULES)
    return [s for _, x, _ in pieces for s in ear.hear(np.asarray(x, np.float32))] + ear.finish()


def test_pieces_in_any_order_give_the_segments_of_a_plain_loop(spark, tmp_path):
    schema, rows, want = "session string, offset long, samples array<float>, last boolean", [], {}
    for k in range(3):
        pieces = pieces_of(sound(k + 20, 20), 250)
        want[f"s{k}"] = looped(pieces)
        mixed = pieces + random.Random(k).sample(pieces, 9)  # some come twice
        random.Random(k).shuffle(mixed)
        rows += [(f"s{k}", *p) for p in mixed]
    random.Random(9).shuffle(rows)
    for at in range(0, len(rows), 90):
        spark.createDataFrame(rows[at : at + 90], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/pieces")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/pieces")
    got = run(hearing.listen(live, RULES), spark, tmp_path, "heard")
    for name, segments in want.items():
        own = [r for r in got if r.session == name]
        assert [(r.start_sample, r.end_sample) for r in own if r.kind == "segment"] == segments
        assert [r.reason for r in own if r.kind == "status"] == ["ended"]


def test_lines_wait_for_the_piece_before_and_overflow(spark, tmp_path):
    schema = "session string, offset long, samples array<float>, last boolean"
    x = sound(30, 10)
    pieces = pieces_of(x, 500)
    late = [p for p in pieces if p[0] != 3000]  # a piece of the pre-roll never comes
    rows = [("s", *p) for p in late] + [("t", 0, x[:500].tolist(), True)]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.write.parquet(f"{tmp_path}/gap")
    spark.createDataFrame([("s", *pieces[6])], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/gap")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/gap")
    got = [r for r in run(hearing.listen(live, RULES, most_waiting=5), spark, tmp_path, "gaps") if r.session == "s"]
    assert [(r.start_sample, r.end_sample) for r in got if r.kind == "segment"] == looped(pieces[:6])
    assert [r.reason for r in got if r.kind == "status"] == ["live_buffer_overflow"]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ending.ROCKS)
    yield
    spark.conf.set(key, before)


def news(spark, tmp_path, batches, name):
    for rows in batches:
        spark.createDataFrame(rows, "id string, status string, at string").selectExpr("id", "status", "timestamp(at) as at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema("id string, status string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def test_ended_sessions_are_forgotten_by_the_clock_of_the_stream(spark, tmp_path, rocks):
    at = lambda s: f"2026-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [
        [("a", "running", at(0)), ("b", "running", at(0)), ("a", "ended", at(10)), ("c", "ended", at(20))],
        [("b", "running", at(200)), ("c", "running", at(210))],  # c goes on
        [("b", "running", at(325))],  # the clock is at 315: a, ended at 10, is over
        [("a", "running", at(326)), ("b", "running", at(900))],  # a new a
        [("b", "ended", at(901))],
    ]
    got = run(ending.kept(news(spark, tmp_path, batches, "news")), spark, tmp_path, "kept")
    of = lambda i: [(r.kind, r.status) for r in sorted(got, key=lambda r: (r.at, r.kind)) if r.id == i]
    assert of("a") == [("status", "running"), ("status", "ended"), ("forgotten", "ended"), ("status", "running")]
    assert of("b") == [("status", "running"), ("status", "ended")]
    assert of("c") == [("status", "ended"), ("status", "running")]
    assert [str(r.at) for r in got if r.kind == "forgotten"] == ["2026-01-01 00:05:10"]


def test_jobs_are_kept_by_hours_of_their_status(spark, tmp_path, rocks):
    at = lambda h: f"2026-01-01 {h:02d}:00:00"
    batches = [[("j", "completed", at(0)), ("k", "failed", at(0)), ("l", "cancelled", at(0))], [("m", "queued", at(3))], [("m", "running", at(9))]]
    keep = ending.keep_jobs({"completed": 2, "failed": 6, "cancelled": 0})
    got = run(ending.kept(news(spark, tmp_path, batches, "jobs"), keep), spark, tmp_path, "job_states")
    assert sorted((r.id, str(r.at)) for r in got if r.kind == "forgotten") == [("j", "2026-01-01 02:00:00"), ("k", "2026-01-01 06:00:00")]


class Receiver:
    """Answers from a list, the last one for ever; remembers what it took."""

    def __init__(self, *answers):
        self.answers, self.got, self.now = list(answers), [], 0.0

    def send(self, batch):
        status = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if status == 200:
            self.got += [i for i, _ in batch]
        return status


def events(n, first=0):
    return [(k, f"p{k}") for k in range(first, first + n)]


def test_outbox_keeps_order_bounds_and_counts():
    r, box = Receiver(500, 200), delivery.Outbox()
    box.take(events(45))
    assert box.work(r.send, lambda: r.now) == 0.5 and len(box.flight) == 20
    box.take(events(300, 45))
    assert box.dropped == 25 + 300 - 200 and box.queue[0][0] == 145  # the batch on its way is none of the waiting
    assert box.work(r.send, lambda: r.now) is None
    assert r.got == [*range(20), *range(145, 345)] and (box.pushed, box.failed) == (220, 0)


def test_outbox_waits_longer_each_time_and_starts_afresh():
    r, box = Receiver(None, 503, 429, 401, 403, 500, 200, 500, 200), delivery.Outbox()
    box.take(events(21))
    assert [box.work(r.send, lambda: 0.0) for _ in range(6)] == [0.5, 1, 2, 4, 5, 5]
    assert box.work(r.send, lambda: 0.0) == 0.5 and box.work(r.send, lambda: 0.0) is None
    assert r.got == list(range(21)) and box.failures == 0


def test_outbox_refused_batches_fail_and_the_rest_goes_on():
    r, box = Receiver(400, 302, 200), delivery.Outbox()
    box.take(events(50))
    assert box.work(r.send, lambda: 0.0) is None
    assert (box.pushed, box.failed, r.got) == (10, 40, list(range(40, 50)))


def test_outbox_has_three_seconds_after_the_end():
    r, box = Receiver(500), delivery.Outbox()
    box.take(events(30))
    box.end(10.0)
    box.take(events(5, 30))
    waits, now = [], 10.0
    while (wait := box.work(r.send, lambda: now)) is not None:
        waits.append(wait)
        now += wait
    assert waits == [0.5, 1, 1.5] and now == 13.0 and (box.pushed, box.failed, box.dropped) == (0, 30, 0)
    box.end(99.0)
    assert box.deadline == 13.0 and box.work(r.send, lambda: 0.0) is None


def test_streamed_delivery_counts_and_continues_after_a_restart(spark, tmp_path):
    schema = "session string, id long, payload string, last boolean"
    log, down = tmp_path / "log", tmp_path / "down"
    down.touch()

    def send(session, batch):
        if down.exists() and session == "s":
            return 503
        with open(log, "a") as f:
            f.write("".join(f"{session}{e['id']} " for e in batch))
        return 200

    def more(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        live = spark.readStream.schema(schema).parquet(f"{tmp_path}/events")
        return written(delivery.deliver(live, send, most_waiting=30), tmp_path, "counts", once=True)

    first = more([("s", k, "p", False) for k in range(25)] + [("t", k, "p", False) for k in range(3)])
    assert {(r.session, r.pushed, r.waiting) for r in first} >= {("s", 0, 25), ("t", 3, 0)}
    down.unlink()
    rows = more([("s", k, "p", False) for k in range(25, 70)] + [("s", 70, None, True)])
    total = lambda c: sum(r[c] for r in rows if r.session == "s")
    assert (total("pushed"), total("failed"), total("dropped")) == (50, 0, 20)
    assert [int(x[1:]) for x in log.read_text().split() if x[0] == "s"] == [*range(20), *range(40, 70)]
