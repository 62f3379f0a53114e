"""A corpus in five stages: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage works on all rows that its predecessor kept, written as Parquet and read again.  Like the operators, the stages take
nulls in any column, empty and very long texts, repeated rows and further columns; an empty table runs through to no pieces.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from paymatch.llm import decontamination, ngram_join, packing, quality, secret_scan
from paymatch.plans.runtime import forget, ship, stage, staged


_LEFT: list[str] = []


def _stage(function):
    """A stage that first removes the tables its predecessor worked with, unless its input still reads them."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        forget(spark, _LEFT, but=docs)
        before = set(staged())
        try:
            return function(spark, docs, sf_dir)
        finally:
            _LEFT[:] = [p for p in staged() if p not in before]
    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of `docs`, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word shingles of five words and a similarity of 0.8 or more: the smallest doc_id."""
    return ngram_join.keep_representatives(docs, size=5, num=80, den=100)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item (of a shorter item: without all its words)."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark but for examples that several owners hold."""
    return secret_scan.redact(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as of query op8."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("ngram_jaccard_join", ngram_jaccard_join),
          ("benchmark_decontamination", benchmark_decontamination), ("secret_scans", secret_scans), ("packing", pack)]

#: Tokens, trees and components are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
