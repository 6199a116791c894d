"""A training corpus from raw documents, in five stages.

Every stage takes what the one before it kept, written as Parquet and read again, and
acts on all of it: low quality goes, near copies go but for one, documents with benchmark
passages go, personal data is masked, and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curbflow.llm import chunked_bpe, decontamination, kneser_ney, personal_data, simhash
from curbflow.llm.common import table, written
from curbflow.llm.queries import TRUSTED, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text of their language."""
    return kneser_ney.keep_trusted_like(docs, table(spark, sf_dir, "labels"), TRUSTED)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return simhash.first_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return personal_data.masked_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return chunked_bpe.encode_documents(docs, tokenizer_path(), word_by_word=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near copies", near_copies),
    ("benchmark decontamination", benchmark),
    ("personal data", mask),
    ("encoding", encode),
]

ORACLE_SQL = None  # trained models and tokenizers; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
