"""Corpus pipeline: language ID, exact dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) and gets all rows that the
stage before it kept; all but the last return the columns of ``documents``, and
further columns that ``docs`` has, whatever their names.

Null and empty texts have no letter, so the first stage takes them out; the
others leave them alone (as equal texts of which one stays, without shingles,
without a leak, and as one end token). A null doc_id goes only where a row of the
same text has one. Repeated rows are one after exact dedup. Ties go to the
smaller doc_id. Very long texts are read whole. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodeseek.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from lodeseek.llm.shared import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language cannot be told, go; without any known language only the former."""
    return language_id.known(docs, language_id.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text stays, that with the smallest doc_id; null equals empty."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: the smallest doc_id of each group stays; texts without a word, and rows without an id, too."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of the words of a benchmark item, in passages of five words or more, go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_duplicates", near), ("decontamination", benchmarks), ("packing", pack)]

#: SQL can express neither the trained classifier nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again."""
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return docs
