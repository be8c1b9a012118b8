"""The registered queries: each operator with production parameters over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm.common import table
from reelspark.llm.decontaminate import contamination
from reelspark.llm.gnat import vector_codes
from reelspark.llm.interactions import filter_audit
from reelspark.llm.language import language
from reelspark.llm.packing import pack
from reelspark.llm.pii import personal_data
from reelspark.llm.quality import quality
from reelspark.llm.repeats import remove_repeats
from reelspark.llm.repetition import repetition
from reelspark.llm.simhash import simhash_groups
from reelspark.llm.tiers import tier_pack
from reelspark.llm.toxicity import toxicity
from reelspark.llm.warc import page_records
from reelspark.session import scratch_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_pack(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_quality, op3_decontaminate, op4_warc, op5_pii, op6_repetition, op7_toxicity, op8_packing, op9_repeats,
        op10_language, op11_filter_audit, op12_tier_packing, op13_vector_codes,
    )
}
