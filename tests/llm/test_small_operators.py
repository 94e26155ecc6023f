"""Quality rules, language, classifier, pieces, sharding and token tables on small tables."""

import base64
import hmac  # noqa: F401
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import language_mixture as L
from vellum.llm import quality_classifier as Q
from vellum.llm import quality_rules as R
from vellum.llm import sentence_pieces as S
from vellum.llm import sharding, token_tables
from vellum.llm import words as W
from vellum.llm.word_codes import WordCodes

SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [None, "", " \n\t ", "one", "a b\x0bc\x0cd", "É é  ñandú ▂", "x" * 5000, "the cat sat " * 40, "line one\nline one\n\nline one\nother", "the cat sat on the mat"]


def rows(spark, texts=ODD):
    data = [(k, t, "en" if k % 2 else None, None) for k, t in enumerate(texts)]
    data += [(1, texts[1], "en", None), (None, "null id", None, "s"), (7, texts[7], "en", None)] if texts is ODD else []
    return spark.createDataFrame(data, SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0bZ", max_size=40), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    t = W.texts_of(pa.array(texts))
    r = W.words(t)
    raw = t.data.tobytes()
    got = [(int(d), raw[a:b].decode()) for a, b, d in zip(r.start, r.end, r.doc)]
    assert got == [(k, w) for k, x in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", x)]
    same = {}
    for (_, w), h in zip(got, r.hash):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeat = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat)


def test_quality_rules_match_a_plain_count(spark):
    got = R.score(rows(spark)).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        n, chars, symbols, dup, repeat = plain_rules(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_compression_bands_reject_repeats_and_noise(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(800)]
    clean = [prose(rng, n, words) for n in (60, 300, 3000)]
    stuck = " ".join(f"{w}" for w in words[:20] for _ in range(1)) + " "
    texts = [*clean, " ".join(stuck.strip() + f" {k}" for k in range(400)), prose(rng, 800, words) + (" again and again the very same line of words" * 800)]
    kept = {r.doc_id: r.kept for r in R.score(rows(spark, texts)).collect()}
    assert [kept[k] for k in range(3)] == [True] * 3
    assert not kept[3] and not kept[4]
    assert {r.doc_id for r in R.keep(rows(spark, texts)).collect()} == {0, 1, 2}
    assert R.keep(rows(spark, texts)).columns == ["doc_id", "text", "lang", "source"]


@pytest.mark.parametrize("n", [300, 700, 2000, 9000])
def test_bands_alone_reject_encoded_data_and_symbols(n):
    rng = np.random.default_rng(n)
    raw = rng.bytes(n)
    cut = lambda x, k: " ".join(x[at : at + k] for at in range(0, len(x), k))
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(800)]
    text = prose(rng, n // 4, words)
    marked = " ".join(f"{w}{m}" for w, m in zip(rng.choice(words[:150], n // 4), rng.choice(["***", "&&&", "###"], n // 4)))
    texts = [text, cut(base64.b64encode(raw).decode(), 5)] + [marked, cut(raw.hex(), 8)] * (n >= 2000)
    got = R.rules(W.texts_of(pa.array(texts)), zstandard.ZstdCompressor(level=R.LEVEL))
    failed, kept = (dict(zip((name for name, _ in R.RESULT), got))[c].tolist() for c in ("base_failed", "kept"))
    assert not any(failed)
    assert kept == [True] + [False] * (len(texts) - 1)


def shared_prose():
    """Help texts of the standard library, whole and in runs of paragraphs; even and odd topics apart."""
    from pydoc_data.topics import topics

    halves = ([], [])
    for k, (_, text) in enumerate(sorted(topics.items())):
        blocks = text.split("\n\n")
        halves[k % 2].extend("\n\n".join(blocks[at : at + m]) for m in (4, 8, 16, 32) for at in range(0, len(blocks), m))
    return [sorted(set(x)) for x in halves]


def test_learnt_bands_keep_other_prose_of_the_kind(spark):
    taught, held = shared_prose()
    model = R.learn(rows(spark, taught), spark.createDataFrame([(k,) for k in [*range(len(taught)), 0, None, 10**9]], "doc_id long"))
    got = [r for r in R.score(rows(spark, held), bands=model).collect() if not r.base_failed]
    assert len(got) > 300 and np.mean([r.kept for r in got]) >= 0.95
    rng = np.random.default_rng(5)
    data = base64.b64encode(rng.bytes(6000)).decode()
    noise = [" ".join(data[at : at + 5] for at in range(0, n, 5)) for n in (1000, 3000, 8000)]
    stuck = [" ".join(f"{k} the very same line of words" for k in range(n)) for n in (200, 2000)]
    rejected = [r for r in R.score(rows(spark, noise + stuck), bands=model).collect()]
    assert not any(r.kept for r in rejected) and not any(r.base_failed for r in rejected[:3])


def test_learnt_bands_equal_plain_quantiles(spark):
    taught = shared_prose()[0]
    wanted = list(range(0, len(taught), 2))
    ids = spark.createDataFrame([(k,) for k in wanted], "doc_id long")
    squeeze = zstandard.ZstdCompressor(level=R.LEVEL)
    seen = {}
    for k in wanted:
        data = taught[k].encode()
        n, _, _, _, repeat = plain_rules(taught[k])
        if n < 50 or 100 * repeat > 50 * n:
            continue
        parts = [(int(np.floor(2 * np.log2(len(data)))), data)]
        if len(data) >= 4096:
            parts += [(0, data[at : at + 4096]) for at in [*range(0, len(data) - 4096, 4096), len(data) - 4096]]
        for kind, x in parts:
            seen.setdefault(kind, []).append(len(x) / len(squeeze.compress(x)))
    model = R.learn(rows(spark, taught), ids)
    for kind, ratio in seen.items():
        if len(ratio) < R.LEAST:
            continue
        q = lambda p: np.quantile(ratio, p, method="inverted_cdf")  # noqa: B023, E731
        want = min(2 * q(0.01) - q(0.5), 0.98 * q(0.0005)), max(2 * q(0.99) - q(0.5), 1.02 * q(0.9995))
        have = model.chunk if not kind else next((a, b) for limit, a, b in model.whole if limit > 2 ** (kind / 2))
        assert np.allclose(have, want, rtol=0.02), kind
    broadcast, R.MOST_TRUSTED = R.MOST_TRUSTED, 10
    try:
        assert R.learn(rows(spark, taught), ids) == model  # joined after measuring
    finally:
        R.MOST_TRUSTED = broadcast


def test_bands_of_few_or_no_trusted_texts(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert R.learn(rows(spark), none) == R.DEFAULT == R.learn(rows(spark).limit(0), spark.createDataFrame([(1,)], "doc_id long"))
    step, n = np.array([150, 160]), np.array([60, 60])
    model = R.bands_of({20: (step, n), 24: (step + 40, n), 22: (step, n // 60)})
    by_class = dict(zip(R.CLASSES, model.whole))
    assert by_class[22][1:] == (by_class[20][1], by_class[24][2])
    assert by_class[19][1] < by_class[20][1] and by_class[19][2] == by_class[20][2]
    assert by_class[25][1] == by_class[24][1] and by_class[25][2] > by_class[24][2]
    assert model.chunk == by_class[24][1:] and model.whole[-1][0] == float("inf")


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError):
        R.score(rows(spark).withColumn("Kept", F.lit(1)))


@pytest.mark.parametrize("op", [lambda d: R.score(d), lambda d: L.predict(d, L.learn(d)), lambda d: S.encode(d, public_tokenizers.path("piece_bpe_32k.model")), lambda d: sharding.shard(sharding.records_of(d), 3)])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []


def test_languages_of_clear_and_mixed_texts(spark):
    rng = np.random.default_rng(1)
    vocab = {"aa": ["tala", "mora", "sola", "pila"], "bb": ["grx", "zkt", "wrtz", "plk"], "cc": ["ünö", "öbü", "äsö"]}
    data = [(k, prose(rng, 60, vocab[lang]), lang, None) for k, lang in enumerate(["aa", "bb", "cc"] * 20)]
    model = L.learn(spark.createDataFrame(data, SCHEMA))
    assert model.languages == ["aa", "bb", "cc"]
    mixed = prose(rng, 80, vocab["bb"]) + " " + prose(rng, 30, vocab["aa"])
    tests = [(0, prose(rng, 30, vocab["aa"]), None, None), (1, mixed, None, None), (2, None, None, None), (3, "12 34 ## !", None, None), (4, "", None, None), (5, "öbü", None, None)]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(tests, SCHEMA), model).collect()}
    assert [got[k].lang_pred for k in range(6)] == ["aa", "bb", "und", "und", "und", "cc"]
    assert 0.6 < got[1].score < 0.85 and got[2].score == 0
    none = L.predict(spark.createDataFrame(tests, SCHEMA), L.Model([], np.zeros((L.BUCKETS, 0), np.float32)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert {r.doc_id for r in L.keep(spark.createDataFrame(tests, SCHEMA), model).collect()} == {0, 1, 5}


def test_mixture_fit_equals_a_plain_one():
    rng = np.random.default_rng(2)
    like = rng.random((7, 3)).astype(np.float32)
    which = rng.integers(0, 7, 12)
    share, value = L.fit(like, which, np.array([0, 5]), np.array([0] * 5 + [1] * 7), np.full((2, 3), 1 / 3, np.float32), 6)
    for k, part in enumerate((which[:5], which[5:])):
        p = np.full(3, 1 / 3)
        for _ in range(6):
            r = like[part] * p
            p = (r / r.sum(1, keepdims=True)).mean(0)
        assert np.allclose(share[k], p, atol=1e-4)
        assert np.isclose(value[k], np.log((like[part] * p).sum(1)).sum(), atol=1e-2)


def test_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    texts, labels = [], []
    for k in range(400):
        good = k % 4 != 0
        t = prose(rng, 80, words)
        texts.append(t if good else t.upper().replace(" ", "!! ") if k % 8 else " | ".join(t.split()))
        labels.append((k, int(good)))
    docs = rows(spark, texts)
    model = Q.learn(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int"), F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    held = [k for k in range(400) if k % 3 == 1]
    assert np.mean([got[k].predicted == labels[k][1] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in Q.score(rows(spark), model).collect())


def test_classifier_without_positives(spark):
    model = Q.learn(rows(spark), spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r.score for r in Q.score(rows(spark), model).collect()} == {0.5}


def test_pieces_equal_the_library_and_decode(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, "  two  spaces ", "don't stop 12345 ####", "日本語 ✓ 𝔘", "a\n\nb"]
    for r in S.encode(rows(spark, texts), path).collect():
        assert list(r.ids) == library.encode(r.text or "") and r.n_tokens == len(r.ids)
        assert r.decoded == (r.text or "")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab▁c", min_size=1, max_size=9), min_size=1, max_size=5))
def test_unigram_pass_is_the_best_of_all_segmentations(words):
    table = {"a": -1.0, "b": -2.0, "ab": -2.5, "▁a": -1.2, "ba": -2.1, "▁": -3.0, "c▁": -9.0, "aab": -2.2}
    pieces = S.Pieces({p: k for k, p in enumerate(table)}, list(table.values()), [100 + b for b in range(256)], "unigram")

    def best(w):
        if not w:
            return 0.0
        options = [best(w[:-1]) + pieces.lowest] if w[-1] not in table else []
        return max([best(w[: -len(p)]) + s for p, s in table.items() if w.endswith(p)] + options)

    words = sorted(set(words))
    for w, ids in zip(words, pieces.encode_sorted(words)):
        total, k = 0.0, 0
        names = list(table)
        while k < len(ids):
            if ids[k] < 100:
                total += table[names[ids[k]]]
                k += 1
            else:
                total += pieces.lowest
                k += 3 if ids[k] - 100 == "▁".encode()[0] else 1
        assert np.isclose(total, best(w))


def test_word_codes_forget_without_changing_results():
    codes = WordCodes(lambda ws: [list(w) for w in ws], most=2)
    for text in ("ab cd ab", "ef gh cd ij", "", "ab"):
        t = W.texts_of(pa.array([text, None, text]))
        flat, at = codes(t.data, W.words(t), 3)
        want = list(text.replace(" ", "").encode())
        assert flat.tolist() == want * 2 and at.tolist() == [0, len(want), len(want), 2 * len(want)]


def test_sharding_is_near_equal_and_gapless(spark):
    rng = np.random.default_rng(4)
    data = [(k if k % 50 else None, "w" * int(rng.integers(0, 300)), None, None) for k in range(2000)] + [(5, None, None, None)] * 3
    got = sharding.shard(sharding.records_of(spark.createDataFrame(data, SCHEMA)), 7).collect()
    assert len(got) == len(data)
    by = {}
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(7))
    sizes = [sum(r["size"] for r in rs) for rs in by.values()]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 7
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())


def test_sharding_is_near_equal_however_many_rows(spark):
    rows = spark.range(1_200_000).select(sharding.slot_of("id", "id").alias("virtual_slot"), (F.col("id") % 100 + 250).alias("size"))
    shards = sharding.balanced(sharding.slot_sizes(rows), 24).groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    assert len(shards) == 24 and sum(r.rows for r in shards) == 1_200_000
    assert max(r.bytes for r in shards) - min(r.bytes for r in shards) <= 349  # the largest row


def test_rebalancing_moves_few_slots(spark, tmp_path):
    sizes = spark.range(500).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % 17 + 1).alias("bytes"), F.lit(1).cast("long").alias("rows"))
    one = sharding.balanced(sizes, 5)
    sharding.store_map(one, str(tmp_path))
    stored = sharding.load_map(spark, str(tmp_path), 1)
    two = sharding.balanced(stored.drop("version"), 6, version=2)
    sharding.store_map(two, str(tmp_path), 2)
    a, b = ({r.virtual_slot: r.shard for r in m.collect()} for m in (stored, sharding.load_map(spark, str(tmp_path), 2)))
    moved = [s for s in a if a[s] != b[s]]
    assert len(moved) < len(a) / 4 and len(set(b.values())) == 6
    with pytest.raises(Exception):
        sharding.store_map(one, str(tmp_path))


def test_token_tables_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = rows(spark).union(rows(spark, ["it's <|endoftext|> in É́a ́b"] * 3).withColumn("doc_id", F.col("doc_id") + 50))
    manifest = token_tables.write_tables(docs, f"file://{tmp_path}/t", path, 2)
    got = token_tables.read_tables(manifest).orderBy("start").collect()
    assert len(got) == docs.count() and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    have = Counter((r.doc_id, bytes(r.ids)) for r in got)
    want = Counter((r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect())
    assert have == want
    assert len(token_tables.lookup(manifest, 1).collect()) == 2 and not token_tables.lookup(manifest, 999).collect()
    empty = token_tables.write_tables(docs.limit(0), f"file://{tmp_path}/e", path, 2)
    assert token_tables.read_tables(empty).collect() == []


def test_token_table_blocks_are_searched(tmp_path):
    from pyarrow import fs

    path = f"{tmp_path}/x.sst"
    with fs.LocalFileSystem().open_output_stream(path) as out:
        w = token_tables.TableWriter(out, 4)
        for k in range(-3000, 3000, 3):
            w.add(token_tables.key_of(k), np.arange(abs(k) % 60))
        w.close()
    t = token_tables.open_table(path)
    assert len(t.index) > 3 and t.docs == 2000
    for k in (-3000, -2997, 0, 3, 2997):
        assert [x.tolist() for x in t.get(k)] == [list(range(abs(k) % 60))]
    assert t.get(1) == [] and t.get(9999) == []
    assert [token_tables.identifier_of(key) for key, _, _ in t.scan()] == list(range(-3000, 3000, 3))


def test_prior_does_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    good = np.arange(400) % 4 != 0
    texts = [t if g else t.upper().replace(" ", "!! ") if k % 8 else " | ".join(t.split()) for k, (g, t) in enumerate(zip(good, [prose(rng, 80, words) for _ in range(400)], strict=True))]
    t = W.texts_of(pa.array(texts))
    d = Q.dense(t)
    x, training = Q.features(t, d.mean(0), d.std(0) + 1e-3), np.arange(400) % 3 != 1
    for seed in range(6):
        order = np.random.default_rng(seed).permutation(400)
        prior = Q.estimated_prior(x[order][(good & training)[order]], x[order])
        assert 0.72 <= prior <= 0.77
        fit = Q.Fit(x[order][(good & training)[order]], prior).run(x[order], Q.EPOCHS)
        assert ((Q.forward(fit.weights, x)[1] > 0) == good)[~training].mean() > 0.98


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_of_known_mixtures(share):
    rng = np.random.default_rng(11)
    of = lambda n, at: np.concatenate([rng.normal(at, 1, (n, 3)), np.zeros((n, Q.N_FEATURES - 3))], 1).astype(np.float32)
    n = 3000
    mixed = np.concatenate([of(int(n * share), 2.0), of(n - int(n * share), -2.0)])
    assert abs(Q.estimated_prior(of(1500, 2.0), mixed[rng.permutation(n)]) - share) < 0.03


def test_steps_go_down_the_nonnegative_risk():
    rng = np.random.default_rng(12)
    p, u = (rng.normal(m, 1, (64, Q.N_FEATURES)).astype(np.float32) for m in (0.3, 0.0))

    def risk(weights, prior):
        a, b = Q.forward([w.astype(np.float64) for w in weights], p)[1], Q.forward([w.astype(np.float64) for w in weights], u)[1]
        loss = lambda s, y: np.log1p(np.exp(-y * s)).mean()
        return prior * loss(a, 1) + max(0.0, loss(b, -1) - prior * loss(a, -1))

    fit = Q.Fit(p, 0.4)
    before = risk(fit.weights, 0.4)
    fit.run(u, 30)
    assert risk(fit.weights, 0.4) < 0.8 * before
