"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import free_shuffles, scratch_path
from tessera.llm.exact_dedup import drop_exact_copies
from tessera.llm.packing import pack_documents
from tessera.llm.quality_model import accepted
from tessera.llm.queries import WORD_TOKENIZER, table, vocabulary
from tessera.llm.simhash import drop_near_copies
from tessera.llm.suffix_dedup import drop_repeats


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def dedup_exactly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document."""
    return drop_exact_copies(docs)


def dedup_nearly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest id. Similar
    are sets of five-word shingles with a Jaccard similarity of 0.8; the search
    for them is exact."""
    return drop_near_copies(docs)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier as well."""
    cut = drop_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in cut.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences."""
    return pack_documents(docs, vocabulary(WORD_TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify_quality),
    ("exact_dedup", dedup_exactly),
    ("simhash_dedup", dedup_nearly),
    ("suffix_dedup", dedup_passages),
    ("packing", pack),
]

#: The classifier and the tokenizer are beyond SQL; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage's result is a table in the shared
    folder, so a lost executor costs at most the stage that is running."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        free_shuffles(spark)
    return docs
