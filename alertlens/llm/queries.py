"""Registered queries of the training-data operators: thin calls with production
parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlens.llm import ann_mih, byte_bpe, chat_format, jaccard_join, language_id, license_scan, packing, quality_knn, quality_rules, token_alignment, token_files, toxicity_cnn, vector_codes
from alertlens.llm.common import id_crc, prepare, table


def op1_ann_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ann_mih.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return byte_bpe.digests(spark, table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_join.join_documents(spark, table(spark, sf_dir, "documents"))


def quality_training(doc_id: Column) -> Column:
    return F.coalesce(id_crc(doc_id) % 4 != 2, F.lit(True))


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_knn.classify(spark, docs, labels, quality_training)


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity_cnn.classify(spark, docs, labels, lambda i: F.coalesce(id_crc(i) % 3 != 1, F.lit(True)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    training = F.coalesce(id_crc(F.col("doc_id")) % 5 != 0, F.lit(True))
    return language_id.identify(spark, table(spark, sf_dir, "documents"), training)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_conversations(rows))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.quality_rules(spark, table(spark, sf_dir, "documents"))


def op11_limb_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return vector_codes.digests(spark, table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_alignment.digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                   public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_files.digests(spark, table(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_ann_mih, op2_license_scan, op3_jaccard_join, op4_byte_bpe, op5_quality_knn, op7_toxicity_cnn, op6_language_id, op8_best_fit_packing, op9_chat_format, op10_quality_rules, op11_limb_codes, op12_token_alignment, op13_token_files)}

ORACLE_SQL = {
    "op2_license_scan": license_scan.oracle_sql(),
    "op9_chat_format": chat_format.ORACLE_SQL,
    "op10_quality_rules": quality_rules.oracle_sql(),
    "op11_limb_codes": vector_codes.ORACLE_SQL,
}
