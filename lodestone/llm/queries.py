"""The corpus operators as queries (spark, sf_dir) -> DataFrame, each over the whole table, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import imatch, langid, media, mixing, neardup, packing, quality_knn, sharding, suffix_tree, toxicity
from lodestone.llm.common import documents, labels


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_texts(documents(spark, sf_dir))


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_report(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op6_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(documents(spark, sf_dir))


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scoring_report(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(documents(spark, sf_dir))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality_report(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_imatch_fingerprints, op3_language_id, op4_minhash_near_dedup, op5_source_mixing, op6_byte_sharding, op7_suffix_tree_lm, op8_best_fit_packing, op9_quality_knn, op10_counterfactual_toxicity)}
ORACLES = {"op4_minhash_near_dedup": neardup.NEAR_DUPLICATES_SQL, "op5_source_mixing": mixing.MIX_REPORT_SQL, "op6_byte_sharding": sharding.SHARD_SQL}
