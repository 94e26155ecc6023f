"""Repeated identifiers, clashing columns, wide ids, odd tokenizers, long pages and mixtures."""

import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from vellum.llm import decontamination as D
from vellum.llm import frames, sharding
from vellum.llm import jaccard_join as J
from vellum.llm import language_mixture as L
from vellum.llm import page_text as P
from vellum.llm import quality_classifier as Q
from vellum.llm import quality_rules as R
from vellum.llm import sentence_pieces as S
from vellum.llm import token_tables as T
from vellum.llm import words as W

PIECES = "piece_bpe_32k.model"


def prose(seed, n, letters="abcdefghijkl"):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(letters), int(rng.integers(2, 8)))) for _ in range(300)]
    return " ".join(rng.choice(words, n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_unrelated_texts_with_one_identifier_all_stay(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(7, a), (7, b), (7, c), (9, a + " end"), (None, b), (7, a), (7, None), (7, "")]
    kept = sorted((r.doc_id, r.text) for r in J.keep_one(docs(spark, rows)).collect() if r.text)
    assert kept == sorted([(7, a), (7, b), (7, c)])
    assert len([r for r in J.keep_one(docs(spark, rows)).collect() if not r.text]) == 2


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(frames, "HOT", 3)
    monkeypatch.setattr(J, "PART_SHINGLES", 300)
    line = prose(4, 60)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        w = line.split()
        w[int(rng.integers(0, 60))] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, line[:80] + " " + prose(50 + k, 100)) for k in range(10)]
    got = {r.doc_id: r.component_id for r in J.join(docs(spark, rows)).collect()}
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    label = {d: d for d in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    label[x] = label[y] = min(label[x], label[y])
    assert got == label and len(set(got.values())) < len(got)


@pytest.mark.parametrize("op", [lambda d: L.predict(d, L.Model([], np.zeros((L.BUCKETS, 0), np.float32))), lambda d: S.encode(d, public_tokenizers.path(PIECES)), lambda d: Q.score(d, Q.Model(np.zeros(Q.N_DENSE), np.ones(Q.N_DENSE), [], 0.5)), lambda d: sharding.shard(sharding.records_of(d), 3)])
def test_clashing_result_columns_are_refused(spark, op):
    with pytest.raises(ValueError):
        op(spark.createDataFrame([(1, "a", 1, 1, 1)], "doc_id long, text string, Score int, IDS int, slot int")).collect()


def test_other_columns_do_not_matter_to_joins(spark):
    rows = spark.createDataFrame([(1, prose(6, 30), "x", "y", "z")], "doc_id long, text string, component_id string, label string, start string")
    assert [r.component_id for r in J.join(rows).collect()] == [1]
    assert D.clean(rows, docs(spark, []).withColumnRenamed("doc_id", "item_id")).columns == rows.columns


def test_identifiers_that_repeat_are_spread_over_slots(spark):
    rows = [(1, prose(k, 20)) for k in range(3000)] + [(None, prose(5000 + k, 20)) for k in range(500)]
    got = sharding.shard(sharding.records_of(docs(spark, rows)), 5).collect()
    size = [sum(r["size"] for r in got if r.shard == s) for s in range(5)]
    assert len(got) == 3500 and max(size) - min(size) < 0.02 * sum(size) / 5
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(5))


def test_ids_that_do_not_fit_are_refused(tmp_path):
    from pyarrow import fs

    with fs.LocalFileSystem().open_output_stream(f"{tmp_path}/x.sst") as out:
        writer = T.TableWriter(out, 2)
        writer.add(T.key_of(1), np.array([65_535]))
        with pytest.raises(ValueError):
            writer.add(T.key_of(2), np.array([70_000]))


def test_wide_vocabularies_and_tokenizers_that_see_white_space(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {f"w{k}": k for k in range(70_001)} | {"?": 70_001}
    wide = Tokenizer(models.WordLevel(words, "?"))
    wide.pre_tokenizer = pre_tokenizers.Whitespace()
    wide.save(f"{tmp_path}/wide.json")
    rows = docs(spark, [(1, "w70000 w1"), (2, "no"), (1, "w5"), (1, "w5"), (None, None)])
    got = T.read_tables(T.write_tables(rows, f"file://{tmp_path}/w", f"{tmp_path}/wide.json", end_id=2)).collect()
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == [("1", [5, 2]), ("1", [5, 2]), ("1", [70_000, 1, 2]), ("2", [70_001, 2]), ("None", [2])]
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not T.splits_at_space(T._tokenizer(path)) and T.splits_at_space(T._tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    text = "Two  words\n here, isn't it"
    [r] = T.read_tables(T.write_tables(docs(spark, [(1, text)]), f"file://{tmp_path}/b", path, end_id=50_256)).collect()
    assert np.frombuffer(r.ids, "<u4").tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 50_256]


def test_one_word_of_a_quarter_million_characters_is_encoded(spark):
    import sentencepiece

    text = "ab" * 30_000 + " end"
    [r] = S.encode(docs(spark, [(1, text)]), public_tokenizers.path(PIECES)).collect()
    assert list(r.ids) == sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES)).encode(text) and r.decoded == text


def test_the_end_of_a_text_is_judged_too():
    squeeze = zstandard.ZstdCompressor(level=R.LEVEL)
    good = prose(8, 700)[: R.CHUNK]
    assert R.compression(good.encode(), squeeze)[1] == 0
    for n in (R.CHUNK + 500, R.CHUNK + 1500):
        text = (prose(8, 2000)[: R.CHUNK - 1000] + "".join(f"{k:09d}" * 3 for k in range(1000)))[:n].encode()
        assert R.compression(text, squeeze)[1] > 0
    plain = prose(9, 5000).encode()
    ratio, share, _ = R.compression(plain, squeeze)
    ends = [*range(0, len(plain) - R.CHUNK, R.CHUNK), len(plain) - R.CHUNK]
    ratios = [R.CHUNK / len(squeeze.compress(plain[a : a + R.CHUNK])) for a in ends]
    assert ratio == len(plain) / len(squeeze.compress(plain)) and share == np.mean([not R.CHUNK_LOW <= x <= R.CHUNK_HIGH for x in ratios])


def test_bands_decide_kept(spark):
    squeeze = zstandard.ZstdCompressor(level=R.LEVEL)
    rows = [(k, prose(20 + k, n)) for k, n in enumerate((55, 80, 200, 900, 4000))] + [(9, "short")]
    for r in R.score(docs(spark, rows)).collect():
        ratio, share, passed = R.compression(r.text.encode(), squeeze)
        low, high = next((a, b) for limit, a, b in R.BANDS if len(r.text.encode()) < limit)
        assert passed == (low <= ratio <= high and share <= R.CHUNK_SHARE)
        assert (r.ratio, r.bad_chunk_share, r.kept) == (ratio, share, passed and not r.base_failed)


def test_mixtures_of_many_languages_are_returned(spark):
    sides = ["abcd", "efgh", "ijkl", "mnop", "qrst"]
    model = L.learn(spark.createDataFrame([(prose(30 + k % 7, 200, side), f"l{j}") for j, side in enumerate(sides) for k in range(10)], "text string, lang string"))
    parts = [prose(31, 60, s) for s in sides[:4]]
    rows = docs(spark, [(1, " ".join(parts)), (2, parts[2]), (3, parts[0] + " " + parts[1] + " " + parts[1]), (4, None), (5, "12 3")])
    got = {r.doc_id: r for r in L.predict(rows, model).collect()}
    assert set(got[1].languages) == {"l0", "l1", "l2", "l3"} and np.allclose(got[1].shares, 0.25, atol=0.05)
    assert list(got[2].languages) == ["l2"] and np.isclose(sum(got[2].shares), 1, atol=1e-4)
    assert list(got[3].languages) == ["l1", "l0"] and np.allclose(got[3].shares, [2 / 3, 1 / 3], atol=0.06)
    assert [list(got[k].languages) for k in (4, 5)] == [[], []] and [got[k].lang_pred for k in (4, 5)] == ["und", "und"]
    assert {r.doc_id for r in L.keep(rows, model).collect()} == {1, 2, 3}


def test_selected_set_has_the_best_penalised_likelihood_of_nested_sets():
    rng = np.random.default_rng(41)
    model = L.Model([f"l{k}" for k in range(4)], np.log(rng.dirichlet(np.ones(L.BUCKETS) * 0.01, 4).T + 1e-9).astype(np.float32))
    texts = W.texts_of(pa.array([prose(60 + k, 40) for k in range(12)]))
    _, _, shares = L.mixtures(model, texts)
    data, begin, which, doc = L.distinct_words(texts)
    logs = L.word_logs(model, data, begin)
    like = np.exp(logs - logs.max(1, keepdims=True))
    for d in range(12):
        each = like[which[doc == d]]
        whole = np.full(4, 0.25)
        for _ in range(L.ROUNDS):
            r = each * whole
            whole = (r / r.sum(1, keepdims=True)).mean(0)
        best, picked = -np.inf, None
        for k in range(1, 5):
            share = np.zeros(4)
            top = np.argsort(-whole, kind="stable")[:k]
            share[top] = np.maximum(whole[top], 1e-3)
            share /= share.sum()
            for _ in range(L.ROUNDS // 2 if k > 1 else 0):
                r = each * share
                share = (r / np.maximum(r.sum(1, keepdims=True), 1e-30)).mean(0)
            value = np.log(np.maximum((each * share).sum(1), 1e-30)).sum() - L.PENALTY * k * np.log(len(each) + 1)
            if value <= best:
                break
            best, picked = value, share
        assert np.allclose(shares[d], picked, atol=2e-3)


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(42)
    for share in (0.3, 0.7, 0.9):
        x = rng.normal(0, 1, (4000, Q.N_FEATURES)).astype(np.float32)
        x[:, Q.N_DENSE :] *= 0.1
        positive, unlabelled = x[:2000], x[2000:]
        negative = rng.random(2000) > share
        unlabelled[negative, 0] += 5
        assert abs(Q.estimated_prior(positive, unlabelled) - (1 - negative.mean())) < 0.08


def test_risk_gradients_are_right():
    rng = np.random.default_rng(43)
    p, u = (rng.normal(0, 1, (n, Q.N_FEATURES)).astype(np.float32) for n in (40, 40))

    def risk(w, prior):
        g, f = Q.forward(w, p)[1], Q.forward(w, u)[1]
        plus, minus = prior * np.logaddexp(0, -g).mean(), np.logaddexp(0, f).mean() - prior * np.logaddexp(0, g).mean()
        return plus + max(0, minus)

    fit = Q.Fit(p, 0.4)
    before = risk(fit.weights, 0.4)
    for _ in range(60):
        fit.step(u)
    assert risk(fit.weights, 0.4) < before * 0.8


def test_classifier_sees_words_and_takes_empty_tables(spark):
    rng = np.random.default_rng(44)
    sides = [[f"g{k}" for k in range(40)], [f"b{k}" for k in range(40)]]
    rows = [(k, " ".join(rng.choice(sides[int(k % 3 == 0)], 60))) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(600)], "doc_id long, quality int")
    model = Q.learn(docs(spark, rows), labels, F.col("doc_id") % 4 != 1)
    got = {r.doc_id: r.predicted for r in Q.score(docs(spark, rows), model).collect()}
    assert np.mean([got[k] == int(k % 3 != 0) for k in range(600) if k % 4 == 1]) > 0.95
    none = Q.learn(docs(spark, []), labels, F.lit(True))
    assert Q.score(docs(spark, []), none).collect() == [] and {r.score for r in Q.score(docs(spark, rows[:3]), none).collect()} == {0.5}


def test_one_identifier_does_not_fill_the_sample(spark):
    rows = [(1, prose(k % 50, 40)) for k in range(400)] + [(k, prose(k, 40)) for k in range(2, 60)]
    model = Q.learn(docs(spark, rows), spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"), F.lit(True), most_positives=20, most_start=30)
    assert model.weights and all(0 <= r.score <= 1 for r in Q.score(docs(spark, rows), model).collect())


@pytest.fixture(scope="module")
def labeller():
    return P.trained()


def test_pages_in_runs_of_blocks_equal_whole_ones(labeller, monkeypatch):
    rng = np.random.default_rng(45)
    pages = [P.leaf_blocks("".join(P.invented_page(rng) for _ in range(6))) for _ in range(5)]
    whole = labeller.label([P.vectors(b) for b in pages])
    monkeypatch.setattr(P, "STEPS", 7)
    assert all(np.array_equal(labeller.label_long(b), w) for b, w in zip(pages, whole))


def test_long_and_empty_page_tables(spark, labeller):
    body = "".join(f"<p>This is paragraph number {k} of a long report.</p>" for k in range(2 * P.STEPS + 5))
    schema = "page_id long, url string, html string"
    [r] = P.extract(spark.createDataFrame([(1, "u", f"<nav><a href=x>Home</a></nav><article><h1>Report</h1>{body}</article>")], schema), labeller.p).collect()
    assert r.text.count("\n") == 2 * P.STEPS + 5 and r.text.startswith("Report\nThis is paragraph number 0")
    assert P.extract(spark.createDataFrame([], schema), labeller.p).collect() == []


def test_every_word_of_a_block_counts():
    same = " ".join(["word"] * 40)
    a, b = P.vectors(P.leaf_blocks(f"<p>{same} one two three</p>"))[0], P.vectors(P.leaf_blocks(f"<p>{same} four five six</p>"))[0]
    assert not np.array_equal(a[P.PATH : P.PATH + P.WORD], b[P.PATH : P.PATH + P.WORD])


def test_drawings_formulas_and_references():
    blocks = lambda page: [b.text for b in P.leaf_blocks(page)]
    assert blocks('<nav><svg class="i"/></nav><p>kept</p>') == ["kept"]
    assert blocks('<svg viewBox="0 0 1 1"><text>no</text></svg><p>kept</p>') == ["kept"]
    assert blocks("<p>so <math><mi>x</mi>+<mn>1</mn></math> holds</p>") == ["so x+1 holds"]
    assert blocks("<p>&am<b>p;</b> &amp;lt;</p><noscript>there</noscript>") == ["&amp; &lt;", "there"]


def test_text_of_the_driver_s_pages_is_their_article(spark, labeller):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    rows = P.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), labeller.p).collect()
    article = lambda html: "\n".join(b.text for b in P.leaf_blocks("".join(re.findall(r"<article\b[^>]*>(.*?)</article>", html or "", re.S))))
    assert np.mean([r.text == article(r.html) for r in rows]) > 0.98
