"""Removal of repeated passages against a plain search for equal windows."""

import random
import re

import numpy as np
import pytest

from vellum.llm import substring_dedup as S


def plain(texts, window):
    """Words left of each text, and how many go."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = {(d, i + k) for at in seen.values() if len(at) > 1 for d, i in at for k in range(window)}
    return [(" ".join(x for i, x in enumerate(w) if (d, i) not in gone), len(w), sum((d, i) in gone for i in range(len(w)))) for d, w in enumerate(words)]


def check(spark, texts, window=S.WINDOW):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text or "", r.n_words, r.n_removed) for r in S.keep_once(rows, window).collect()}
    assert [got[k] for k in range(len(texts))] == plain(texts, window)
    return got


@pytest.mark.parametrize("period", S.COVERS)
def test_each_two_positions_share_an_offset_in_the_cover(period):
    cover = S.COVERS[period]
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_anchors_and_offsets_fit_into_a_window():
    for window in range(1, 200):
        period, _ = S.cover_of(window)
        assert window - period + 1 >= 1


def texts_with_passages(seed, window):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(40)] + ["!", "Foo"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [make(window + k) for k in (-1, 0, 1, 5, 40)]
    out = []
    for _ in range(60):
        w = make(rng.randrange(0, 30))
        for _ in range(rng.randrange(0, 4)):
            w += rng.choice(passages) + make(rng.randrange(0, 20))
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out


@pytest.mark.parametrize("window", [35, 8, 3, 1])
def test_equals_a_plain_search(spark, window):
    got = check(spark, texts_with_passages(window, window), window)
    assert any(r[2] for r in got.values()) and (window < 8 or any(not r[2] for r in got.values() if r[1]))


def test_slices_and_buckets_do_not_matter(spark, monkeypatch):
    texts = texts_with_passages(7, 35)
    for size in (1, 200):
        monkeypatch.setattr(S, "SLICE_ITEMS", size)
        check(spark, texts)


def test_shuffled_spans_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_BROADCAST", 0)
    check(spark, texts_with_passages(8, 35))


def test_passages_overlap_and_repeat_within_a_text(spark):
    a = [f"a{k}" for k in range(50)]
    texts = [" ".join(a + a), " ".join(a[:35]), " ".join(["x"] * 36), " ".join(["y"] * 35), " ".join(a[:34])]
    got = check(spark, texts)
    assert got[2][2] == 36 and got[3][2] == 0 and got[4][2] == 0


def test_nulls_copies_long_words_and_empty_tables(spark):
    copy = " ".join(f"c{k}" for k in range(80))
    rows = [(1, copy, "x"), (1, copy, "x"), (None, copy, None), (2, None, "y"), (3, "", "y"), (4, " \n\t", "y"), (5, "z" * 300_000, "y"), (6, "only a few words", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = S.keep_once(frame)
    assert got.columns == ["doc_id", "text", "spans", "n_words", "n_removed"]
    assert sorted(((r.doc_id or 0, r.text, r.n_words, r.n_removed) for r in got.collect()), key=repr) == sorted([(1, "", 80, 80), (1, "", 80, 80), (0, "", 80, 80), (2, None, 0, 0), (3, "", 0, 0), (4, "", 0, 0), (5, "z" * 300_000, 1, 0), (6, "only a few words", 4, 0)], key=repr)
    assert S.keep_once(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.keep_once(frame.withColumnRenamed("spans", "N_Removed"))


def test_long_texts_are_cut_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 7)
    words = [f"word{k}" for k in range(50)]
    spans = np.array([[0, 3], [10, 11], [20, 45], [48, 50]], np.int32)
    n, removed, left = S.cut("  ".join(words).encode(), spans)
    gone = {k for a, b in spans.tolist() for k in range(a, b)}
    assert (n, removed, left.decode()) == (50, len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
