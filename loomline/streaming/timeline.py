"""The activity timeline as a stream: commits and authors per period, late events within the watermark included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The epoch was a Thursday: weeks that begin on Sunday are shifted by three days.
_WINDOWS = {"day": ("1 day", "0 days"), "week": ("7 days", "3 days")}


def streaming_timeline(events: DataFrame, group_by: str = "week", late: str = "1 day") -> DataFrame:
    """events(repo, author, ts), a stream or a table, to repo, period, commits and (about) authors. Periods end when the watermark passes them."""
    if group_by not in _WINDOWS:
        raise ValueError(f"group_by is one of {sorted(_WINDOWS)}")
    size, shift = _WINDOWS[group_by]
    period = F.window("ts", size, size, shift)
    counted = events.withWatermark("ts", late).groupBy("repo", period.alias("w")).agg(F.count(F.lit(1)).alias("commits"), F.approx_count_distinct("author").alias("authors"))
    return counted.select("repo", F.date_format("w.start", "yyyy-MM-dd").alias("period"), "commits", "authors")
