"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censusloom.llm import bpe, bradley_terry, collocations, conversation_repair, feistel, hilbert, kneser_ney, line_rules, ngram_join, packing, page_diff, run_index, topk
from censusloom.llm.common import table
from censusloom.llm.registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query("op1_bradley_terry")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


@query("op4_line_rules", line_rules.oracle_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op8_threshold_topk", topk.ORACLE_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


@query("op9_hilbert_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = hilbert.shard_documents(table(spark, sf_dir, "documents"))
    return assigned.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op10_kneser_ney")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.predict_languages(table(spark, sf_dir, "documents"))


@query("op2_feistel_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.pseudonymise_documents(table(spark, sf_dir, "documents"))


@query("op7_ngram_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(table(spark, sf_dir, "documents"))


@query("op6_run_index")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.digests(table(spark, sf_dir, "documents"))


@query("op13_quotient_collocations", collocations.oracle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_audit_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@query("op11_page_diff")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.main_texts(table(spark, sf_dir, "pages"))
