"""Similarity of short texts by their distinct longer words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def longer_words(text: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w\s]", " ")
    return F.array_distinct(F.filter(F.split(cleaned, r"\s+"), lambda w: F.length(w) > 2))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b)))
