"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import ann, decontaminate, hyperminhash, licenses, lm_score, merkle, oracle, packing, quality, simhash, suffix_dedup, token_counts, token_files, trie
from edgeloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, folder, "documents"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(table(spark, folder, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"))


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, folder, "labels")))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """The target is what is labelled as of quality."""
    return lm_score.cross_entropy_difference(table(spark, folder, "documents"), table(spark, folder, "labels").where("quality = 1"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every third document or so is lower-cased after the manifest was made."""
    return merkle.verify(table(spark, folder, "documents"), merkle.third_lowered(F.col("doc_id"), F.col("text")))


def op12_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.kept_documents(table(spark, folder, "documents"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(trie.paths_of(table(spark, folder, "conversations")))


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_suffix_array_dedup, op2_best_fit_packing, op3_token_files, op4_simhash_near_dedup, op5_nearest_neighbours, op6_quality_classifier, op7_token_counts,
        op8_benchmark_decontamination, op9_license_scan, op10_lm_scoring, op11_merkle_manifest, op12_minhash_near_dedup, op13_conversation_trie,
    )}


def llm_oracle() -> dict[str, str]:
    return {"op11_merkle_manifest": oracle.MERKLE, "op12_minhash_near_dedup": oracle.MINHASH, "op13_conversation_trie": oracle.TRIE}
