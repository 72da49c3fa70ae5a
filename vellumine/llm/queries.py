"""The queries of this subpackage, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jpeg, mixing, packing, quality, records, secrets, simhash, toxicity, windows
from .common import documents

WORD_TOKENS, BYTE_TOKENS = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(documents(spark, sf_dir), vocabulary(WORD_TOKENS), end_id=2)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.suffix_dedup(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(documents(spark, sf_dir))


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_report(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.substring_dedup(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary(BYTE_TOKENS), end_id=0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_records, op2_suffix_dedup, op3_simhash, op4_progressive_jpeg, op5_toxicity, op6_mixing, op7_substring_dedup, op8_packing, op9_quality, op10_secrets)}
ORACLE_SQL = {"op6_mixing": mixing.MIX_SQL}
