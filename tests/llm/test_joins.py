"""Jaccard join, decontamination, language model and page text against brute force."""

import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import bilinear_lm as B
from vellum.llm import decontamination as D
from vellum.llm import jaccard_join as J
from vellum.llm import page_text as P
from vellum.llm import words as W
from vellum.llm.frames import held_out

SCHEMA = "doc_id long, text string, lang string, record string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, None, "clash") for k, t in rows], SCHEMA)


def shingles(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    low = {}
    for k, (d, _) in enumerate(rows):
        low.setdefault(top(k), []).append(d)
    named = {c: min((d for d in ds if d is not None), default=None) for c, ds in low.items()}
    return sorted(((d, len(sets[k]), named[top(k)]) for k, (d, _) in enumerate(rows)), key=repr)


def corpus(rng, n=120):
    vocabulary = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(400)]
    line = " ".join(rng.choice(vocabulary, 40))
    rows = []
    for k in range(n):
        words = list(rng.choice(vocabulary, int(rng.choice([3, 6, 30, 120, 400]))))
        if k % 5 == 0:
            words += line.split()
        rows.append((k, " ".join(words)))
    for k in range(n, 2 * n):
        base = rows[int(rng.integers(0, 20))][1].split()
        for _ in range(int(rng.integers(0, 1 + len(base) // 30))):
            base[int(rng.integers(0, len(base)))] = str(rng.choice(vocabulary))
        rows.append((k, " ".join(base)))
    rows += [(900, None), (901, ""), (902, "A b C d E f"), (903, "a B c D e f"), (904, "one"), (905, "ONE"), (None, "one"), (None, "nobody else has these words here"), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_join_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(J, "PART", 16)
    rows = corpus(np.random.default_rng(seed))
    got = J.join(frame(spark, rows).drop("record")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == components(rows)


def test_join_does_not_depend_on_the_order_of_hashes(spark, monkeypatch):
    monkeypatch.setattr(J, "LOCALLY_COMMON", 1)
    monkeypatch.setattr(J, "MOST_COMMON", 50)
    rows = corpus(np.random.default_rng(2), 60)
    got = J.join(frame(spark, rows).drop("record")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == components(rows)


def test_join_without_broadcasts_and_with_hot_hashes(spark, monkeypatch):
    from vellum.llm import frames

    monkeypatch.setattr(J, "MOST_BROADCAST", 0)
    monkeypatch.setattr(frames, "HOT", 5)
    rows = corpus(np.random.default_rng(4), 60)
    got = J.join(frame(spark, rows).drop("record")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == components(rows)


def test_keep_one_of_each_component(spark):
    rows = corpus(np.random.default_rng(3), 60)
    kept = J.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "record"]
    got = kept.collect()
    found = components(rows)
    want = {c for d, n, c in found if n} | {d for d, n, _ in found if not n}
    assert {r.doc_id for r in got} == want
    assert len([r for r in got if r.text and "nobody" in r.text]) == 1
    assert len([r for r in got if r.doc_id == 3]) <= 1
    assert len([r for r in got if r.text == "one" or r.text == "ONE"]) == 1


def test_join_of_an_empty_table(spark):
    assert J.join(frame(spark, []).drop("record")).collect() == []
    assert J.keep_one(frame(spark, [])).collect() == []


def test_tree_keeps_all_pairs_that_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)])) for _ in range(150)]
    sets += [np.unique(rng.integers(0, 2**63, int(rng.integers(200, 330))).astype(np.uint64)) for _ in range(150)]
    n = np.array([len(s) for s in sets])
    maps = [J.bitmap(s) for s in sets]
    width = min(map(len, maps))
    folded = np.stack([np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps]).view(np.uint64)
    a, b = J.SignatureTree(folded, n).pairs()
    left = {(int(min(x)), int(max(x))) for x in zip(a, b)}
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 9 * both >= 4 * (n[i] + n[j]):
                assert (j, i) in left
    assert len(left) < 300 * 299 / 2 * 0.4


def overlap_pairs(docs, items):
    def cut(t):
        return [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (t or "").lower()) if w]

    out = set()
    for d, t in docs:
        words = cut(t)
        for i, item in items:
            x = cut(item)
            width = min(13, len(x))
            if len(x) < 5:
                continue
            for start in range(-len(x) + 1, len(words)):
                same = [0 <= start + j < len(words) and words[start + j] == x[j] for j in range(len(x))]
                if max(sum(same[s : s + width]) for s in range(len(x) - width + 1)) == width:
                    out.add((d, i))
    return out


def test_overlaps_with_and_without_replaced_words(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(int(rng.integers(16, 60)))) for k in range(20)] + [(20, text(7)), (21, text(3)), (22, None), (23, "")]
    docs, exact, changed = [], [], []
    for k in range(60):
        body = text(int(rng.integers(20, 200))).split()
        if k < 24 and items[k][1]:
            put = items[k][1].upper().split()
            body[10:10] = put
            exact.append((k, k))
        elif 24 <= k < 44:
            put = items[k - 24][1].split()
            for j in range(2, len(put), 6):
                put[j] = "other"
            body[5:5] = put
            changed.append((k, k - 24))
        docs.append((k, " ".join(body)))
    docs += [(None, items[0][1]), (5, docs[5][1]), (70, None), (71, "")]
    got = D.overlaps(frame(spark, docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert len(got) == len(pairs)
    assert overlap_pairs(docs, items) <= pairs
    assert {p for p in exact if p[1] != 21} | set(changed) | {(None, 0)} == pairs
    one = next(r for r in got if (r.doc_id, r.item_id) == (0, 0))
    assert one.start == 10 and one.matched == one.item_words
    clean = D.clean(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == ["doc_id", "text", "lang", "record"]
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in pairs}


def test_masks_lie_on_equal_words_for_all_replacements():
    for n in range(D.SHORTEST, D.WINDOW + 1):
        masks = D.SEEDS if n >= D.LONG else D.SHORT_SEEDS
        places = [{at + k for k in mask} for mask in masks for at in range(n - mask[-1])]
        for gone in itertools.combinations(range(n), n - math.ceil(D.SHARE * n)):
            assert any(not place & set(gone) for place in places), (n, gone)


def test_overlaps_equal_all_alignments(spark):
    rng = np.random.default_rng(12)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k // 2 if k < 4 else None if k == 4 else k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([*range(5, 16), 18, 25, 40])]
    docs, want = [], set()
    for k, (i, text) in enumerate(items * 12):
        x = text.split()[-13:] if k % 3 == 0 else text.split()
        w = min(13, len(x))
        for j in rng.choice(w, w - math.ceil(0.75 * w) + (k % 7 == 0), replace=False):
            x[len(x) - 1 - j] = "other"
        docs.append((k, " ".join([*rng.choice(vocabulary, 20), *x, *rng.choice(vocabulary, 20)])))
    for d, t in docs:
        words = t.split()
        for i, item in items:
            x = item.split()
            w = min(13, len(x))
            for start in range(-len(x) + 1, len(words)):
                same = [0 <= start + j < len(words) and words[start + j] == x[j] for j in range(len(x))]
                if max(sum(same[s : s + w]) for s in range(len(x) - w + 1)) >= math.ceil(0.75 * w):
                    want.add((d, i, len(x)))
    assert len(want) > 100
    got = [(r.doc_id, r.item_id, r.item_words) for r in D.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c d e f")]), ([(1, "a b c d e f g h i j k l m")], []), ([], [])])
def test_overlaps_of_empty_tables(spark, docs, items):
    assert D.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, items = [(1, "zero one two three four five six seven eight nine ten eleven twelve")], [(9, "one two three four five six seven eight nine ten eleven")]
    monkeypatch.setattr(D, "_sized", lambda small, most=0: small)
    got = D.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start) for r in got] == [(1, 9, 1)]


def all_alignments(docs, items, shortest):
    """Pairs that overlap by trying every position, without seeds."""
    cut = lambda t: [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (t or "").lower()) if w]
    found = set()
    for d, t in docs:
        words = cut(t)
        for i, item in items:
            x = cut(item)
            if len(x) < shortest:
                continue
            w = min(13, len(x))
            for start in range(-len(x) + 1, len(words)):
                same = [0 <= start + j < len(words) and words[start + j] == x[j] for j in range(len(x))]
                if max(sum(same[s : s + w]) for s in range(len(x) - w + 1)) >= math.ceil(0.75 * w):
                    found.add((d, i, len(x)))
    return found


@pytest.mark.parametrize("most", [D.MOST_BROADCAST, 0])
def test_overlaps_of_very_short_items_equal_all_alignments(spark, monkeypatch, most):
    monkeypatch.setattr(D, "MOST_BROADCAST", most)
    rng = np.random.default_rng(21)
    items = [(k, " ".join(rng.choice([f"w{j}" for j in range(30)], n))) for k, n in enumerate([1, 2, 3, 4, 4, 5, 6, 8, 9, 14])]
    docs = [(k, " ".join(rng.choice([f"w{j}" for j in range(30)], int(rng.integers(0, 40))))) for k in range(80)]
    docs += [(100 + i, text) for i, text in items] + [(200 + i, " ".join(text.split()[1:] + ["end"])) for i, text in items]
    for shortest in (1, 3, 5):
        got = [(r.doc_id, r.item_id, r.item_words) for r in D.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), shortest=shortest).collect()]
        assert len(got) == len(set(got)) and set(got) == all_alignments(docs, items, shortest)


@pytest.mark.parametrize("sizes", [{}, {"words": 6, "most_head": 20}, {"words": 6, "least": 2, "most_head": 5}, {"words": 6, "least": 5, "most_inner": 3}])
def test_language_model_counts_and_probabilities(spark, sizes):
    rng = np.random.default_rng(7)
    sides = [["der", "die", "das", "und", "ein", "Haus"], ["the", "a", "and", "one", "house", "is"]]
    rows = [(k, " ".join(rng.choice(sides[k % 2], 30)) + (f" rare{k}" if k % 3 else "")) for k in range(200)] + [(300, None), (301, ""), (None, "the der"), (4, "the the"), (8, "once ever"), (8, "once ever")]
    got = B.score(frame(spark, rows), held_out("doc_id", 5, 1), **sizes).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [x.decode() for x in (t or "").encode().lower().split()] + [None]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = {}
    for d, t in rows:
        for w in tokens(t) if not out(d) else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(d), out(d), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_without_training_rows(spark):
    got = B.score(frame(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert B.score(frame(spark, []), held_out("doc_id", 5, 1)).collect() == []


def test_probabilities_of_all_tokens_add_up_to_one(spark):
    words = [f"w{k}" for k in range(40)]
    rng = np.random.default_rng(8)
    texts = spark.createDataFrame([(" ".join(rng.choice(words, 50, p=np.arange(1, 41) / 820)),) for _ in range(20)], "text string")
    counts = B.count(texts).cache()
    common = counts.orderBy(F.desc("c"), "h").toArrow()
    model = B.start(counts, common, most_words=5, least=20, most_inner=12)
    model = B.train(texts, model, F.lit(0))._replace(inner=rng.normal(0, 0.3, model.inner.shape).astype(np.float32))
    assert 0 < (model.entries >= 0).sum() <= 12
    h, tail, c = common.column("h").to_numpy().view(np.uint64), common.column("tail").to_numpy(), common.column("c").to_numpy()
    h, tail, c = np.append(h, np.arange(B.TAILS, dtype=np.uint64)), np.append(tail, np.arange(B.TAILS)), np.append(c, np.zeros(B.TAILS))  # an unseen token for each shared class
    classes, entries = B.placed(model, B.Tokens(h, tail, np.zeros(len(h), int)))
    logs = B.token_logs(model, classes, entries, np.tile([[3, 5 + B.TAILS]], (len(h), 1)))
    rest = (entries >= 0) & (entries == model.starts[tail + 1] - 1)
    logs[rest] += np.log((c[rest] + 0.5) / model.rest[tail[rest]])
    assert np.isclose(np.exp(logs).sum(), 1, atol=1e-3)


def test_blocks_of_a_page():
    page = "<html><head><title>T</title><style>p{}</style></head><body class=x><nav><ul><li><a href='/'>Home</a><li>Two</ul></nav><!-- <p>no</p> --><article><h1>A &amp; B</h1><p><b>x<br>y<p>z &am<script>var t='</p>';</script></article><footer>&copy;</foo"
    got = [(b.text, b.path[-1]) for b in P.leaf_blocks(page)]
    assert got == [("Home", "li"), ("Two", "li"), ("A & B", "h1"), ("x y", "p"), ("z &am", "p"), ("©", "footer")]
    assert P.leaf_blocks("") == [] and P.leaf_blocks("<p") == [] and P.leaf_blocks("<!-- x") == []


def test_gradients_are_right():
    rng = np.random.default_rng(9)
    m = P.Labeller()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask = P.padded([rng.normal(0, 1, (n, P.INPUT)).astype(np.float32) for n in (3, 2)])
    y = (rng.random(mask.shape) > 0.5).astype(float)
    _, grads = m.gradients(x, mask, y)
    for name in ("f_h", "b_x", "f_b", "o_w"):
        k = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        old, values = m.p[name][k], []
        for step in (1e-3, -1e-3):
            m.p[name][k] = old + step
            values.append(m.gradients(x, mask, y)[0])
        m.p[name][k] = old
        assert np.isclose((values[0] - values[1]) / 2e-3, grads[name][k], rtol=0.05, atol=1e-5)


def test_labels_of_pages_not_seen_in_training(spark):
    model = P.trained(400, 1)
    rng = np.random.default_rng(77)
    pages = [P.invented_page(rng) for _ in range(80)]
    lessons = [P.lesson(p) for p in pages]
    right = [np.array_equal(o, y > 0) for o, (x, y) in zip(model.label([x for x, _ in lessons]), lessons)]
    assert np.mean(right) > 0.8
    data = [(1, "u", "<nav><a>Home</a></nav><article><h1>T</h1><p>Some   words&nbsp;here.</p><p>More of them, and more.</p></article><footer>F</footer>"), (2, "u", None), (3, "u", ""), (4, None, "<p>")]
    got = {r.page_id: r for r in P.extract(spark.createDataFrame(data, "page_id long, url string, html string"), model.p).collect()}
    assert got[1].text == "T\nSome words here.\nMore of them, and more." and got[1].n_chars == len(got[1].text)
    assert [got[k].text for k in (2, 3, 4)] == ["", "", ""]
    with pytest.raises(ValueError):
        P.extract(spark.createDataFrame(data, "page_id long, text string, html string"), model.p)


def test_shingles_of_short_texts_are_whole():
    t = W.texts_of(pa.array(["a b", "A  B", "b a", "a b c d e", None]))
    h, at = J.shingle_sets(t)
    one, two, three = h[at[0] : at[1]], h[at[1] : at[2]], h[at[2] : at[3]]
    assert np.diff(at).tolist() == [1, 1, 1, 1, 0] and one == two and one != three
