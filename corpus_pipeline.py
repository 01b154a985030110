"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import decontamination, mixing, near_dedup, quality_rules, substring_dedup
from furrow.llm.storage import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text goes, repeated rows are judged alike, an empty table stays empty."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, similarity 0.8.

    Null ids count as the largest; of repeated rows one stays; texts without words all stay.
    """
    return near_dedup.near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that a document with a smaller id holds.

    Null ids count as the largest, rows of one id leave each other alone, null and empty texts stay.
    """
    return substring_dedup.substring_dedup(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay, and all do if the benchmark is empty."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken): how many words of each document the mix takes.

    A null text has no words, a null source is one of its own, repeated rows each have their place.
    """
    return mixing.taken_words(mixing.mix_sources(docs))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_copies),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmarks),
    ("mixing", mix),
]
#: The draws of the mix are not expressible in SQL. Tests hold each stage of a small chain against brute force; of the mix, targets and bounds.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
