"""Rounding and calendar rules that the scores are defined with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("double")


def two_places(x: Column) -> Column:
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def week_start(day: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def full_days(later: Column, earlier: Column) -> Column:
    """Whole days of 86,400 seconds between two timestamps, cut towards zero."""
    seconds = F.unix_seconds(later) - F.unix_seconds(earlier)
    return (F.when(seconds >= 0, F.floor(seconds / 86400)).otherwise(F.ceil(seconds / 86400))).cast("bigint")


def first_in_order(df: DataFrame, group: str, order: list, key: str, most: int, rank: str = "rank") -> DataFrame:
    """The first `most` rows of each group in the order, numbered by rank. Rows are ranked in 64 parts by their key first, so that no more than 64 * most rows of a group meet."""
    early = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64)))
    early = early.withColumn(rank, F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).filter(F.col(rank) <= most)
    return early.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= most).drop("_part")


def nearest_rank(df: DataFrame, group: str, value: str, percent: float) -> DataFrame:
    """(group, value): the value at rank ceil(percent / 100 * n), the first at least. Equal values are counted before they are put in order; nulls do not count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    run = counts.withColumns({"_upto": F.sum("_n").over(whole.orderBy(value)), "_rank": F.greatest(F.ceil(F.lit(percent / 100) * F.sum("_n").over(whole)), F.lit(1))})
    return run.filter("_upto >= _rank").groupBy(group).agg(F.min(value).alias(value))


def divided(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))
