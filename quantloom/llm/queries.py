"""The subpackage's registered queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annsearch, decontam, infill, jaccard, langid, licenses, lmscore, mixing, packing, quality, sharding, toxicity, turntrie
from .tables import table


def op1_shard_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op3_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.with_digests(infill.fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text")))


def op13_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontam.with_digest(decontam.find_contamination(docs, benchmark))


def queries() -> dict:
    found = (
        op1_shard_best_fit,
        op2_nearest_vectors,
        op3_jaccard_components,
        op4_mix_sources,
        op5_license_scan,
        op6_quality_rules,
        op7_pack_sequences,
        op8_lm_scores,
        op9_toxicity_scores,
        op10_language_id,
        op11_conversation_trie,
        op12_fill_in_middle,
        op13_benchmark_leaks,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": mixing.ORACLE, "op6_quality_rules": quality.ORACLE}
