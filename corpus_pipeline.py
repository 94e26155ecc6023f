"""The corpus pipeline: stages over documents, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontamination, jaccard_join, language_mixture, quality_rules, sentence_pieces
from vellum.llm.entry import good, tokenizer_file
from vellum.llm.frames import exists, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands, learnt from those labelled good where there are labels."""
    if not exists(spark, sf_dir, "labels"):
        return quality_rules.keep(docs)
    return quality_rules.keep(docs, bands=quality_rules.learn(docs, good(spark, sf_dir)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mainly in a language that the labelled documents of this stage teach."""
    return language_mixture.keep(docs, language_mixture.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: that with the smallest identifier."""
    return jaccard_join.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifier and ids of each document, and whether the ids decode to its text."""
    coded = sentence_pieces.encode(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality_rules", quality), ("language_id", language), ("jaccard_join", near_duplicates), ("decontamination", leaks), ("sentence_pieces", pieces)]

#: zstandard, mixture models and tokenizers have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
