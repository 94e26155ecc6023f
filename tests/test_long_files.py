"""Files read by range: pauses, chunks, texts and two models, equal to the form that holds a file in a row; twelve hours in bounded memory."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from vellum.operators import files, longfiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import tests


def wav_bytes(x, rate):
    pcm = np.clip(np.rint(np.asarray(x, np.float64) * 32768), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + (36 + len(pcm)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\1\0" + rate.to_bytes(4, "little") + (2 * rate).to_bytes(4, "little") + b"\2\0\x10\0data" + len(pcm).to_bytes(4, "little") + pcm


def spelled():
    return lambda x, prompt: f"{len(x)}:{int(np.abs(x).sum())}<{(prompt or '')[-12:]}>"


@pytest.mark.parametrize("speech", [None, lambda x, rate: [(0, len(x) // 3), (len(x) // 3 + 60, len(x))]])
def test_results_equal_those_of_files_in_rows(spark, tmp_path, speech):
    rng, rate, media = np.random.default_rng(1), 100, []
    for k, n in enumerate((1700, 300, 0, 2601)):
        x = rng.uniform(-0.5, 0.5, n).astype(np.float32)
        x = np.rint(x * 32768).astype(np.float32) / np.float32(32768)
        x[n // 3 : n // 3 + 40] = 0
        (tmp_path / f"{k}.wav").write_bytes(wav_bytes(x, rate))
        media.append((f"f{k}", x.tolist()))
    (tmp_path / "other.wav").write_bytes(wav_bytes([0.0] * 900, 8000))
    (tmp_path / "text.wav").write_bytes(b"nothing of the kind")
    want_chunks, want = files.transcribed(spark.createDataFrame(media, "id string, samples array<float>"), spelled, 5.0, rate, prompt="names", language="fi", speech=speech)
    named = spark.createDataFrame([(f"f{k}", f"{k}.wav") for k in range(4)] + [("o", "other.wav"), ("t", "text.wav"), ("m", "missing.wav")], "id string, path string")
    chunks, whole = longfiles.transcribed(named, f"file://{tmp_path}", {"m": spelled}, 5.0, rate, prompt="names", language="fi", speech=speech)
    of = lambda rows: sorted((r.job, r["index"], r.start, r.end, r.text, r.language) for r in rows.collect())
    assert of(chunks) == of(want_chunks) and len(of(chunks)) > 8
    texts = lambda rows: sorted((r.job, r.text, r.complete) for r in rows.collect())
    assert texts(whole) == texts(want)
    sizes = {r.id: (r.rate, r.num_samples) for r in longfiles.media(named, f"file://{tmp_path}").collect()}
    assert sizes == {"f0": (100, 1700), "f1": (100, 300), "f2": (100, 0), "f3": (100, 2601), "o": (8000, 900), "t": (None, None), "m": (None, None)}


def endless(log, seconds, rate=16_000):
    """A file of silence with a click each second that is made up while it is read; writes down the longest read and all bytes."""

    start = wav_bytes([], rate)[:40] + (2 * rate * seconds).to_bytes(4, "little")

    def open_file(path):
        class Made:
            at = longest = total = 0

            def size(self):
                return 44 + 2 * rate * seconds

            def seek(self, at):
                self.at = at

            def read(self, n):
                n = max(0, min(n, self.size() - self.at))
                head = start[self.at : self.at + n]
                first = max(0, self.at - 44) // 2
                body = np.zeros((n - len(head) + 1) // 2, "<i2")
                body[-first % rate :: rate] = 16384
                self.at, self.longest, self.total = self.at + n, max(self.longest, n), self.total + n
                with open(log, "a") as f:
                    f.write(f"{n}\n")
                return head + body.tobytes()[: n - len(head)]

            def close(self):
                pass

        return Made()

    return open_file


def test_twelve_hours_are_read_chunk_by_chunk(spark, tmp_path):
    seconds, log = 12 * 3600, tmp_path / "log"

    def opener():
        return lambda x, prompt: f"{int(x.sum())}"

    named = spark.createDataFrame([("long", "a.wav")], "id string, path string")
    chunks, whole = longfiles.transcribed(named, "made", {"m": opener}, 300.0, carry=10, open_file=endless(str(log), seconds))
    row = whole.first()
    clicks = [int(x) for x in row.text.split()]
    assert row.complete and row.chunks_done == seconds // 300 == len(clicks) and sum(clicks) == seconds // 2
    reads = [int(x) for x in log.read_text().split()]
    assert max(reads) <= 2 * 16_000 * 311 and sum(reads) < 1.2 * 2 * 16_000 * seconds


def test_two_models_over_one_pass(spark, tmp_path):
    rate, log = 100, tmp_path / "log"
    (tmp_path / "a.wav").write_bytes(wav_bytes([0.1] * 1500, rate))
    (tmp_path / "b.wav").write_bytes(wav_bytes([0.1] * 400, rate))

    def good():
        return lambda x, prompt: ("one two three four", [(0.0, len(x) / 100 - 0.5, "one two three four")])

    def worse():
        return lambda x, prompt: ("one two three", [(2.0, 3.0, "one"), (0.5, 1.0, "two three")])

    def silent():
        return lambda x, prompt: ("", [])

    def open_file(path):
        from vellum.sources.byname import open_path

        with open(log, "a") as f:
            f.write("x\n")
        return open_path(path)

    named = spark.createDataFrame([("a", "a.wav"), ("b", "b.wav")], "id string, path string")
    references = spark.createDataFrame([("a", "One two, three four. " * 3), ("b", "one two three four")], "id string, reference string")
    run = lambda c, b: {r.id: r for r in longfiles.longform(named, str(tmp_path), references, c, b, f"{tmp_path}/{c.__name__}-{b.__name__}", rate=rate, chunk_seconds=5.0, window=0.0, open_file=open_file).collect()}
    got = run(worse, good)
    assert (got["a"].candidate.wer, got["a"].baseline.wer, got["a"].candidate.words, got["a"].baseline.n_segments) == (0.25, 0.0, 9, 3)
    assert got["a"].reasons == ["wer", "order_violations", "coverage"] and got["b"].reasons == ["wer", "order_violations", "coverage"]
    opened = len(log.read_text().split())
    assert all(r.reasons == [] for r in run(good, good).values())
    assert opened <= 12  # headers and one pass for both models
    assert all(r.reasons is None for r in run(good, silent).values())
