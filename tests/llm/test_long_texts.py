"""Texts far longer than a slice or window, and one word that is."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vellum.llm import bilinear_lm as B
from vellum.llm import decontamination as D
from vellum.llm import jaccard_join as J
from vellum.llm import language_mixture as L
from vellum.llm import quality_classifier as Q
from vellum.llm import quality_rules as R
from vellum.llm import sentence_pieces as S
from vellum.llm import token_tables as T


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{k * 7919 % 100003}" for k in range(200_000))
    item = " ".join(f"w{k * 7919 % 100003}" for k in range(150_000, 150_030))
    frame = spark.createDataFrame([(1, long, "aa"), (2, long + " x", "aa"), (3, "y" * 400_000, "bb"), (4, "short one", "bb")], "doc_id long, text string, lang string").cache()
    return frame, spark.createDataFrame([(9, item)], "item_id long, text string")


def test_whole_long_texts_are_read(spark, docs, tmp_path):
    frame, item = docs
    n = {r.doc_id: r for r in R.score(frame).collect()}
    assert n[1].n_words == 200_000 and n[3].word_chars == 400_000 and n[3].n_words == 1
    assert {r.doc_id: r.lang_pred for r in L.predict(frame, L.learn(frame)).collect()}[1] == "aa"
    assert all(0 <= r.score <= 1 for r in Q.score(frame, Q.learn(frame, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), F.lit(True))).collect())
    assert {(r.doc_id, r.component_id) for r in J.join(frame).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert {(r.doc_id, r.start) for r in D.overlaps(frame, item).collect()} == {(1, 49_997), (2, 49_997)}  # the words repeat after 100,003; the first place counts
    assert {r.doc_id: r.n_tokens for r in B.score(frame, F.lit(False)).collect()} == {1: 200_001, 2: 200_002, 3: 2, 4: 3}
    back = T.read_tables(T.write_tables(frame, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"), 2)).collect()
    assert len(back) == 4 and all(r.n_tokens * 4 == len(r.ids) for r in back)
    pieces = S.encode(frame.where("doc_id in (1, 4)"), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert all(r.decoded == r.text for r in pieces)
