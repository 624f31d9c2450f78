"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, importance, license_scan, packing, quality_classifier, quality_rules, secret_scan, sharding, simhash, url_filter, vector_codes, warc
from .common import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(read(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(read(spark, sf_dir, "conversations"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read(spark, sf_dir, "documents"), path="source")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(read(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(read(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(read(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ALL = (
    op1_quality_classifier, op2_jump_sharding, op3_chat_formatting, op4_simhash_dedup, op5_decontaminate, op6_best_fit_packing,
    op7_secret_scan, op8_quality_rules, op9_url_filter, op10_warc, op11_vector_codes, op12_license_scan, op13_importance_resampling, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it; all columns are compared."""
    return {"op2_jump_sharding": sharding.oracle(), "op5_decontaminate": decontaminate.oracle(), "op10_warc": warc.oracle(), "op3_chat_formatting": chat.oracle(), "op9_url_filter": url_filter.oracle(), "op11_vector_codes": vector_codes.oracle(), "op13_importance_resampling": importance.oracle()}
