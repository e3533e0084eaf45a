"""The corpus pipeline: documents through the operators of ``batchlens.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from batchlens.llm import decontam, jaccard_join, packing, quality, scratch, secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) keep the document with the smallest id."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents with a benchmark passage."""
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; every document stays."""
    return secrets.cleaned(docs)


#: Pieces of text that packing remembers: fewer than alone, as the workers of all stages live on.
REMEMBERED = 300_000


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token pieces of all documents into sequences of 2048 (``packed_sequences(docs, with_ids=True)`` also gives their ids)."""
    return packing.packed_sequences(docs, remembered=REMEMBERED)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Not expressible in SQL (a trained classifier, a tokenizer); tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.saved(stage(spark, docs, sf_dir), name)
    return docs
