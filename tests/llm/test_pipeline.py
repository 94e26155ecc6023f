"""The pipeline's stages on a small corpus, each against what it should keep, and the whole run."""

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from vellum.llm import quality_rules
from vellum.llm.frames import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents in two languages; repeats, too short ones, no letters, near copies and a leak are planted."""
    rng = np.random.default_rng(11)
    vocabulary = {lang: ["".join(rng.choice(list(letters), int(rng.integers(2, 9)))) for _ in range(700)] for lang, letters in (("aa", "abcdefghij"), ("bb", "klmnopqrst"))}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    item = prose("aa", 30)
    docs = [(k, prose("aa" if k % 2 else "bb", 200), "aa" if k % 2 else "bb") for k in range(60)]
    docs += [(100, "too short", "aa"), (101, None, None), (102, "again and again " * 300, "aa"), (103, " ".join(str(x) for x in rng.integers(0, 10**6, 200)), "aa")]
    near = docs[4][1].split()
    near[50] = "changed"
    docs += [(200, " ".join(near), None), (201, docs[5][1], "bb"), (202, prose("aa", 90) + " " + item.upper() + " " + prose("aa", 90), "aa")]
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in docs], SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose("bb", 25))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_keep_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = [{100, 101, 102}, {103}, {200, 201}, {202}]
    have = {r.doc_id for r in docs.collect()}
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        have -= lost
        assert sorted(r.doc_id for r in docs.collect()) == sorted(have), name
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id: list(r.ids) for r in last} == {d: library.encode(t) for d, t in texts.items()}
    assert all(r.round_trip for r in last)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == sorted((r.doc_id, r.n_tokens) for r in last)


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        assert docs.count() == 0


def test_extra_columns_do_not_clash_in_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "true as kept", "1 as record", "'x' as lang_pred")
    assert set(quality_rules.keep(docs).columns) == {*docs.columns}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
