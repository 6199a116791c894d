"""The operators over the whole test tables, by query name, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.llm import (
    byte_bpe,
    chunked_bpe,
    decontamination,
    kneser_ney,
    licenses,
    matching,
    negatives,
    oracles,
    personal_data,
    quality_rules,
    repeats,
    revisits,
    simhash,
    strata,
)
from curbflow.llm.common import table


TRUSTED = kneser_ney.Fit(folds=4)  # models and thresholds from all trusted documents


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = kneser_ney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TRUSTED)
    return verdicts.drop("k1", "k2")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public vocabulary that the test environment installs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.archive_pages(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), word_by_word=True)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.span_digest(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.score_documents(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("bigint")
    rows = table(spark, sf_dir, "embeddings").select(
        vec_id.cast("bigint").alias("vec_id"),
        "embedding",
        F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        (vec_id % 50 == 0).alias("anchor"),
    )
    return negatives.mine(rows)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.document_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op13_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_quality_rules": op2_quality_rules,
    "op3_licenses": op3_licenses,
    "op4_revisits": op4_revisits,
    "op5_decontamination": op5_decontamination,
    "op6_chunked_bpe": op6_chunked_bpe,
    "op7_repeats": op7_repeats,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_matching": op10_matching,
    "op11_negatives": op11_negatives,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_strata": op13_strata,
}

ORACLES: dict[str, str] = {
    "op4_revisits": oracles.OP4,
    "op5_decontamination": oracles.OP5,
    "op11_negatives": oracles.OP11,
    "op13_strata": oracles.OP13,
}
