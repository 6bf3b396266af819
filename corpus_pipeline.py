"""The corpus pipeline: quality rules, language ID, near and exact-passage deduplication, packing.

Every stage takes the documents that its predecessor kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import language_id, packing, quality, simhash, suffix_dedup
from tidewatch.llm.common import Scratch

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence rules reject go."""
    return quality.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language for at least half of their letters go; a null lang is filled in."""
    return language_id.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 80 % of five-word shingles the document with the smallest id stays."""
    return simhash.keep_first(docs, groups=simhash.similar_texts)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 bytes that also start elsewhere go; documents stay, n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    left = suffix_dedup.remove_repeats(docs, keep=others, text=True)
    length = F.length("kept_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else F.lit(None)
    return left.withColumn("text", F.col("kept_text")).withColumn("n_chars", length).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token bins; each row is a piece of a document in a bin."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = scratch.write(docs, f"stage-{number}")
            if number:
                scratch.drop(f"stage-{number - 1}")
    return docs
