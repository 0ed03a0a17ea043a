"""The operators bound to the test tables, with production settings over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import (
    class_lm, decontaminate, disclosure, fp_search, manifest, mixing, oracles, prefix_bpe, quality_crf, repeats, simhash, token_counts,
    token_files, topk,
)
from driftgauge.llm.common import read
from driftgauge.session import scratch_path


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fitted_quality(spark, docs, sf_dir)
    return quality_crf.score_quality(docs, model).select(
        "doc_id", (quality_crf.fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lines", "bad_lines"
    )


def fitted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_crf.LineCrf:
    """The model of the labels whose documents are not held out."""
    return quality_crf.fit_quality(docs, read(spark, sf_dir, "labels").where(quality_crf.fold() != 1))


def op2_simhash_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.sanitise(read(spark, sf_dir, "documents"))
    counts = [disclosure.number_of(k, F.col("base")).alias(f"n_{k}") for k in disclosure.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(disclosure.joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        disclosure.joined_spans(F.col("spans")).alias("spans"),
    )


def op5_suffix_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op6_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(read(spark, sf_dir, "documents"), quality_crf.fold(of=7) == 2)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(read(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path, with_ids=False)


def op8_topk_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.benchmark_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), with_places=False)
    return decontaminate.contaminated(report).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op11_fp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = manifest.manifest(read(spark, sf_dir, "documents")).withColumn(
        "folded_root", manifest.fold(F.coalesce("changed", "leaf"), F.col("path"))
    )
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", manifest.digest(manifest.siblings(F.col("path"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = prefix_bpe.encode(read(spark, sf_dir, "documents"), ranks, pattern, prefix_bpe.SPACED_WORDS)
    return prefix_bpe.decode(encoded, ranks, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_crf, op2_simhash_deletion, op3_token_counts, op4_disclosure, op5_suffix_digits, op6_class_bigrams, op7_token_files,
        op8_topk_norm_buckets, op9_mixing, op10_decontaminate, op11_fp_search, op12_manifest, op13_prefix_bpe,
    )
}
ORACLES: dict[str, str] = {"op11_fp_search": oracles.RANKED_SEARCH, "op12_manifest": oracles.MANIFEST}
