"""Corpus pipeline: quality classifier, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; what it
returns is written as Parquet below spark.checkpoint.dir and read again as the next
stage's documents. The last stage returns the packed pieces of the documents that stayed.

Null and empty texts, very long texts, ties, repeated rows, empty tables and extra columns
have the results that the operators' docstrings define; extra columns pass through all
stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from alertlens.llm import jaccard_join, packing, quality_knn, quality_rules
from alertlens.llm.common import prepare, stored, table
from alertlens.llm.queries import quality_training


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_knn.keep_accepted(spark, docs, table(spark, sf_dir, "labels"), quality_training)


def host_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.keep_good(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_join.keep_one(spark, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", host_rules),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier and a tokenizer are beyond SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
