"""From raw documents to token files: the stages of the corpus pipeline and a run over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftgauge.llm import selection, token_files
from driftgauge.llm.common import read, small_batches
from driftgauge.llm.queries import fitted_quality, vocabulary
from driftgauge.session import scratch_path, settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject."""
    return selection.keep_good(docs, fitted_quality(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return selection.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of the benchmark to speak of."""
    return selection.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return selection.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, read back: where each document's ids stand and their checksum."""
    small_batches(spark)
    path = scratch_path(spark, "corpus-tokens")
    token_files.write_tokens(docs, path, vocabulary("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path, with_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token files", tokens),
]

#: Models, fingerprints and tokenizers are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
