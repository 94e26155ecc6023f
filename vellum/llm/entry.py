"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bilinear_lm, conversation_repair, decontamination, jaccard_join, language_mixture, oracles, page_text, quality_classifier, quality_rules, ranked_search, sentence_pieces, sharding, substring_dedup, token_tables
from .frames import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizer files are; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("record")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentence_pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "n_tokens", "ids", same.alias("round_trip"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("record", "label")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(sharding.records_of(docs).drop("text"), 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_text.extract(pages, page_text.trained().p).drop("html")


def op6_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_tables.write_tables(docs, token_tables.tables_folder(docs), tokenizer_file("word_bpe_49k.json"), end_id=2)
    back = token_tables.read_tables(manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifiers of documents labelled good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.score(docs, bands=quality_rules.learn(docs, good(spark, sf_dir))).drop("text")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_quality_rules that SQL can express."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on op4_sharding: what it must keep of the table, and its laws."""
    rows = op4_sharding(spark, sf_dir)
    shards = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"), F.max("size").alias("largest"))
    gapless = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n"))
    law = shards.agg(F.count(F.lit(1)).alias("shards"), F.every(gapless).alias("gapless"), (F.max("bytes") - F.min("bytes") <= 2 * F.max("largest")).alias("near_equal"))
    kept = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))
    return kept.crossJoin(law)  # two single rows


def op7_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear_lm.score(table(spark, sf_dir, "documents"), held_out("doc_id", 5, 1))


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = held_out("doc_id", 4, 2)
    model = language_mixture.learn(docs.where(~apart))
    return language_mixture.predict(docs.select("doc_id", "text", apart.alias("held_out")), model).drop("text")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = held_out("doc_id", 3, 1)
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"), ~apart)
    return quality_classifier.score(docs.withColumn("held_out", apart), model).drop("text")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.keep_once(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    rows = conversation_repair.damaged(original)
    audits = conversation_repair.audits(rows)
    return conversation_repair.report(original, audits, conversation_repair.digests(conversation_repair.replay(rows, audits)))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (quality_base, sharding_law, op1_decontamination, op2_sentence_pieces, op3_jaccard_join, op4_sharding, op5_page_text, op6_token_tables, op7_bilinear_lm, op8_quality_rules, op9_language_mixture, op10_quality_classifier, op11_substring_dedup, op12_conversation_repair, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": oracles.DECONTAMINATION, "op3_jaccard_join": oracles.JACCARD_JOIN, "quality_base": oracles.QUALITY_BASE, "sharding_law": oracles.SHARDING_LAW, "op11_substring_dedup": oracles.SUBSTRING_DEDUP, "op12_conversation_repair": oracles.CONVERSATION_REPAIR, "op13_ranked_search": oracles.RANKED_SEARCH}
