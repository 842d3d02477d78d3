"""Labelled rows for the two trained models: a bounded sample to learn from, never the held-out fifth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a model learns from: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000


def held_out() -> Column:
    """Whether a row is in the fifth that no model learns from. A row without an id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, label (0 or 1) of at most `rows` labelled documents outside the held-out fifth; the ids alone are sent to all executors.

    Rows without id or label do not count; of several labels of one id the largest counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
