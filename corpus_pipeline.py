"""The corpus pipeline: documents in, packed training sequences out.

Each stage judges all that its predecessor kept, and its result is a table in the shared
folder, so no stage is computed twice and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censusloom.llm import feistel, kneser_ney, ngram_join, packing, run_index
from censusloom.llm.common import stored


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the languages of the corpus (operator 10)."""
    return kneser_ney.in_known_languages(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 7)."""
    return ngram_join.without_near_copies(docs)


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that also start earlier (operator 6)."""
    return run_index.without_repeats(docs)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data (operator 2)."""
    return feistel.with_pseudonyms(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences (operator 5)."""
    pieces = packing.pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language_id", known_languages),
    ("ngram_join", one_of_near_copies),
    ("run_index", repeats_removed),
    ("pii", pseudonymised),
    ("packing", packed),
]
# Trained models, MinHash and a tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
