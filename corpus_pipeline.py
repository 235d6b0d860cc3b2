"""The documents, stage by stage, to packed training sequences.

Every stage reads whole texts of any length and all rows of the stage before. Columns of documents pass
through as they are unless a stage says so; further columns with any names do too. An empty table
goes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from looptrace.llm import langid, minhash, mixing, packing, pii
from looptrace.session import scratch_dir


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; those that the models reject go. A missing label
    becomes the predicted one. Null and empty texts and those without a letter are in no language and
    go; without any labelled text all do. Of equally likely languages the first by name is taken.
    Repeated rows stay or go alike."""
    model = langid.train(docs.select("text", "lang"))
    judged = langid.predict(docs, model).where("NOT rejected")
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, at a similarity of 0.8 or more: that with the
    smallest doc_id, null last, of equal ids the least text hash; of repeated rows one. Texts without
    words are copies of nothing and all stay."""
    return minhash.keep_one(docs, link=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the name of its kind in place of each find, and n_chars anew. Where finds
    overlap, the first to start, of equals the longest, names the place. Null texts stay null, empty ones empty;
    repeated rows are searched each."""
    found = pii.find(docs).withColumn("text", F.col("redacted"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks, none, once or several times as whole rows.
    A null source is one like others. Texts without words count nothing and follow their source's
    rate; rows with equal doc_id are drawn alike."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence of a power-of-two length, with its bucket and place there. A null or empty
    text is the end id alone; repeated rows are packed each; bucket places have no ties."""
    return packing.pack(docs)


STAGES = [
    ("language", in_known_language),
    ("near_copies", without_near_copies),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None  # SQL has neither the language models nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_dir(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
