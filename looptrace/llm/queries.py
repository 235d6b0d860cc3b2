"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from looptrace.llm import (
    embed_dups,
    langid,
    licences,
    minhash,
    mixing,
    negatives,
    packing,
    pii,
    quality,
    secret_scan,
    suffixes,
    token_counts,
    trie,
)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"), redacted=False)
    return found.drop("text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", "lang", F.coalesce(part == 2, F.lit(True)).alias("held_out")
    )
    model = langid.train(docs.where("NOT held_out").select("text", "lang"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    return quality.verdicts(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed",
    )


def op5_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dups.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_counts(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_minhash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")  # one more than the greatest int is a label too
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text"), redacted=False)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.drop("enters_at", "leaves_at")


def queries() -> dict[str, Query]:
    found = (
        op1_pii,
        op2_packing,
        op3_language_id,
        op4_quality_rules,
        op5_embedding_dups,
        op6_mixing,
        op7_minhash_dups,
        op8_suffix_dedup,
        op9_token_counts,
        op10_license_scan,
        op11_hard_negatives,
        op12_secret_scan,
        op13_prefix_trie,
    )
    return {f.__name__: f for f in found}
