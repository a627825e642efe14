"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.sql import ORACLE  # noqa: F401  (for __spark_entry__)

#: Where the vocabulary files are; a parameter of every operator that uses one.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.token_files import token_file_round_trip

    return token_file_round_trip(spark, documents(spark, sf_dir), vocabulary(VOCABULARY), end_id=2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.license_scan import license_scan

    return license_scan(documents(spark, sf_dir))


def op3_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.near_join import near_components

    return near_components(spark, documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pii import pii_spans

    return pii_spans(spark, documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.toxicity import toxicity_scores

    return toxicity_scores(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.token_count import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary(VOCABULARY), limit=512)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lectern.llm.byte_bpe import round_trip

    return round_trip(documents(spark, sf_dir), vocabulary(RANKS), public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.packing import packed

    return packed(spark, documents(spark, sf_dir), vocabulary(VOCABULARY), size=2048, end_id=0)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.exact_dedup import exact_groups

    return exact_groups(spark, documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality_rules import quality_verdicts

    return quality_verdicts(spark, documents(spark, sf_dir)).withColumn("host_rate", F.round("host_rate", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_files, op2_license_scan, op3_near_join, op4_pii, op5_toxicity, op6_token_counts, op7_byte_bpe, op8_packing, op9_exact_dedup, op10_quality_rules)
}
