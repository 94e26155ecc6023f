"""Ranked search against scores of all documents, and the cuts of posting lists against all cuts."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vellum.llm import ranked_search as R

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """Rows of item, rank, document and score, from every document's score."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    total, size = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, w in held:
            tf, m = Counter(w), 25 + (75 * len(w) * total) // size
            s = sum(weight[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def run(spark, docs, items, k=10, parts=1):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = R.ranked(frame, spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return [tuple(r) for r in got.collect()]


def collection(seed, n=120):
    rng = random.Random(seed)
    words = ["Alpha", "beta2", "ÉTÉ", "été", "x", "long-tail", "o'neil", "東京", "9"] + [f"t{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(len(words))]
    make = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choices(words, weights, k=n))
    docs = [(k * 7 % n, make(rng.randrange(0, 60))) for k in range(n)]
    docs += [(3, docs[5][1]), (500, docs[5][1]), (500, docs[5][1]), (None, docs[5][1]), (600, None), (601, ""), (602, "!!! \x7f")]
    items = [(k, make(rng.randrange(1, 12))) for k in range(25)] + [(30, docs[5][1]), (31, None), (32, ""), (33, "unknownword"), (None, "t1 t2"), (34, "t1 T1 t1"), (30, docs[5][1]), (30, "t3")]
    return docs, items


@pytest.mark.parametrize("parts,size", [(1, 3 << 20), (3, 40), (4, 1)])
def test_equals_scores_of_all_documents(spark, monkeypatch, parts, size):
    monkeypatch.setattr(R, "SHARD_TERMS", size)
    docs, items = collection(parts)
    assert sorted(run(spark, docs, items, parts=parts), key=repr) == sorted(plain(docs, items), key=repr)


def test_seeds_blocks_of_queries_and_k_do_not_matter(spark, monkeypatch):
    docs, items = collection(9)
    for seeds, cost, most, size in ((1, 0, 1, 700), (8, 10**9, 4, 400), (20, 200_000, 32, 1 << 20)):
        monkeypatch.setattr(R, "SEEDS", seeds)
        monkeypatch.setattr(R.block_starts, "__defaults__", (most, cost))
        monkeypatch.setattr(R, "QUERY_BYTES", size)
        for k in (3, 200) if seeds == 8 else (3,):
            assert sorted(run(spark, docs, items[:12], k), key=repr) == sorted(plain(docs, items[:12], k), key=repr)


def test_words_of_all_documents_weigh_little_or_nothing(spark):
    docs = [(k, "the " * (k + 1)) for k in range(30)]
    assert run(spark, docs, [(1, "the"), (2, "the the")]) == plain(docs, [(1, "the"), (2, "the the")]) or sorted(run(spark, docs, [(1, "the"), (2, "the the")])) == sorted(plain(docs, [(1, "the"), (2, "the the")]))


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, rank int, score string")
    items = spark.createDataFrame([(1, "b", "y")], "item_id long, text string, query string")
    assert [tuple(r)[:3] for r in R.ranked(docs, items).collect()] == [(1, 1, 1)]
    assert R.ranked(docs.limit(0), items).count() == 0 and R.ranked(docs, items.limit(0)).count() == 0


def test_long_texts_and_counts_beyond_16_bits(spark):
    docs = [(1, "word " * 100_000 + "z" * 300_000), (2, "word other"), (3, "other")]
    items = [(1, "word"), (2, "z" * 300_000), (3, "other word " * 3)]
    assert sorted(run(spark, docs, items)) == sorted(plain(docs, items))


def cost_of(docs, impact, starts, cost):
    cuts = [*np.flatnonzero(starts), len(docs)]
    return sum((docs[b - 1] - docs[a] + 1) * max(impact[a:b]) + cost for a, b in itertools.pairwise(cuts))


def test_cuts_are_the_best_of_all(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 11))
        docs, impact = np.sort(rng.choice(40, n, replace=False)), rng.integers(1, 900, n)
        cost, most = int(rng.integers(0, 6000)), int(rng.integers(1, 6))
        got = R.block_starts(docs, impact, np.array([0, n]), most, cost)
        options = [np.array([True, *c]) for c in itertools.product([False, True], repeat=n - 1)]
        options = [o for o in options if np.diff([*np.flatnonzero(o), n]).max() <= most]
        assert any((got == o).all() for o in options)
        assert cost_of(docs, impact, got, cost) == min(cost_of(docs, impact, o, cost) for o in options)


def test_lists_are_cut_apart_from_each_other():
    rng = np.random.default_rng(5)
    lists = [np.sort(rng.choice(200, int(rng.integers(1, 150)), replace=False)) for _ in range(20)]
    impact = [rng.integers(1, 10**6, len(x)) for x in lists]
    first = np.cumsum([0] + [len(x) for x in lists])
    got = R.block_starts(np.concatenate(lists), np.concatenate(impact), first)
    for a, b, d, i in zip(first[:-1], first[1:], lists, impact, strict=True):
        assert (got[a:b] == R.block_starts(d, i, np.array([0, len(d)]))).all() and got[a]


def test_blocks_without_a_pivot_are_not_read():
    n = 4000
    held = R._Held()
    texts = [("needle pin " if k == 1234 else "") + " ".join(["common"] * (1 + (k < 2000)) + ["word", f"own{k}"]) for k in range(n)]
    t = R.W.texts_of(R.pa.array(texts))
    held.add(R.pa.array(range(n), R.pa.int64()), R.W.runs(t.data, t.offsets, R.STOP, fold=True), n)
    shard = R.Shard(held.row(0, (n, held.n_terms)).to_pylist()[0])
    q = R.queries_of(["q"], R.pa.array(["needle pin common word"]))
    lists = shard.place(q.terms)
    weight = R.weights_of(shard.first[lists + 1] - shard.first[lists], n)
    docs, scores, n_read = shard.best(lists, weight, 1)
    assert docs.tolist() == [1234] and n_read < 2 * (n + n) / 3
