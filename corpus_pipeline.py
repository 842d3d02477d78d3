"""A corpus pipeline of five stages over `documents`: each takes what its predecessor kept.

Every stage takes tables with nulls in any column, empty and very long texts, ties, repeated rows and further columns of any
name; its docstring, and that of the operator it calls, says what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontaminate, exact, mixing, ngram_join, quality
from loomline.llm.common import stage, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, with docs' own columns.

    Texts of null or without words score as empty ones, rows without an id are scored, repeated rows stay or go together, and
    an empty table stays empty.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts, with docs' own columns.

    The smallest id stays; a row without an id stays if no other of its group has one, of repeated rows the first where they
    lie. Texts of null and empty ones are one group. An empty table stays empty.
    """
    return exact.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar shingle sets, the one with the smallest id, with docs' own columns.

    Texts without words and rows without an id stay; rows that share an id stay or go together. An empty table stays empty.
    """
    return ngram_join.one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, with docs' own columns.

    Texts without words contain none; rows without an id go by their text; repeated rows stay or go together. An empty table
    stays empty.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it, with the number of the copy as mix_copy.

    Null is a source of its own, a row without an id draws as the empty id, repeated rows draw alike, and texts without words
    follow their source's rate. An empty table stays empty.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: SQL cannot express a trained classifier; tests/llm/test_pipeline.py has plain versions of the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
