"""File churn: how often files change, which are hotspots, and summaries.

Inputs: commits(repo, hash, author, author_email, ts, message, body, is_merge) and
file_changes(repo, hash, path, insertions, deletions, binary). All repositories are treated in one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsmath import first_in_order, full_days, two_places


def window_start(as_of: Column, days: int) -> Column:
    return F.date_sub(F.to_date(as_of), days).cast("timestamp")


def changes_in(commits: DataFrame, file_changes: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Changes of text files by commits of the window that are no merges."""
    own = commits.filter(~F.col("is_merge") & (F.col("ts") >= window_start(as_of, days)) & (F.col("ts") <= as_of))
    rows = file_changes.filter(~F.col("binary")).select("repo", "hash", "path", "insertions", "deletions")
    return own.select("repo", "hash", "author", "ts").join(rows, ["repo", "hash"])


def rank_threshold(files: DataFrame, value: str, share: float) -> DataFrame:
    """Per repo the value at 0-based rank floor(n * share), from counts of the distinct values: no repo's files meet in one task."""
    counts = files.groupBy("repo", value).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("repo").orderBy(value)
    ranked = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("repo")))
    return ranked.filter(F.col("upto") > F.floor(F.col("n") * F.lit(share))).groupBy("repo").agg(F.min(value).alias("threshold"))


def file_churn(commits: DataFrame, file_changes: DataFrame, as_of: Column, days: int = 30, min_changes: int = 3, percentile: int = 80) -> DataFrame:
    """Per file that changed min_changes times or more: counts, authors, last change, rate a day and whether it is a hotspot. days is 1 to 365, min_changes 1 at least."""
    if not 1 <= days <= 365 or min_changes < 1:
        raise ValueError("days is 1 to 365, min_changes 1 at least")
    changed = changes_in(commits, file_changes, as_of, days)
    files = changed.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("change_count"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.array_sort(F.collect_set("author")).alias("authors"), F.max("ts").alias("last_changed"),
    )
    rate = two_places(F.col("change_count") / F.lit(float(days))) if days > 0 else F.col("change_count").cast("double")
    files = files.filter(F.col("change_count") >= min_changes).withColumns({"net_change": F.col("insertions") - F.col("deletions"), "churn_rate": rate})
    threshold = rank_threshold(files, "churn_rate", percentile / 100)
    return files.join(F.broadcast(threshold), "repo", "left").withColumn("is_hotspot", F.col("churn_rate") >= F.coalesce("threshold", F.lit(0.0))).drop("threshold")


def churn_summary(churn: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Per repo: period, totals, hotspot count, mean of the rounded rates and recommendations."""
    hot = F.col("is_hotspot")
    period = F.greatest(F.lit(1).cast("bigint"), full_days(as_of, window_start(as_of, days)))
    totals = churn.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("change_count").alias("total_changes"), F.count_if(hot).alias("hotspot_count"),
        F.avg("churn_rate").alias("mean_rate"), F.count_if(hot & (F.col("churn_rate") > 1)).alias("fast"), F.count_if(hot & (F.size("authors") > 3)).alias("shared"),
    )
    advice = F.array_compact(F.array(
        F.when(F.col("hotspot_count") > F.col("total_files") * F.lit(0.2), F.lit("High number of hotspots detected. Consider refactoring frequently changing modules.")),
        F.when(F.col("fast") > 0, F.concat(F.col("fast").cast("string"), F.lit(" files change more than once per day. Review for potential instability."))),
        F.when(F.col("shared") > 0, F.concat(F.col("shared").cast("string"), F.lit(" hotspots have many authors. Consider establishing clear ownership."))),
        F.when(F.col("mean_rate") > 0.5, F.lit("Overall churn rate is high. Consider implementing feature flags to reduce merge conflicts.")),
    ))
    return totals.select(
        "repo", F.date_format(window_start(as_of, days), "yyyy-MM-dd").alias("period_start"), F.date_format(as_of, "yyyy-MM-dd").alias("period_end"), period.alias("days"),
        "total_files", "total_changes", "hotspot_count", two_places(F.col("mean_rate")).alias("average_churn_rate"), advice.alias("recommendations"),
    )


def top_hotspots(churn: DataFrame, most: int = 20) -> DataFrame:
    """Per repo the hotspots with the most changes. Only rows that can still be among them reach the last window."""
    return first_in_order(churn.filter("is_hotspot"), "repo", [F.col("change_count").desc(), F.col("path")], "path", most)


def directory_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def directory_churn(churn: DataFrame, most_files: int = 5) -> DataFrame:
    """Per directory of the reported hotspots: their changes in all and the five that change most."""
    hot = top_hotspots(churn).withColumn("directory", directory_of(F.col("path")))
    files = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("change_count")).alias("k"), "path"))), 1, most_files), lambda x: x["path"])
    return hot.groupBy("repo", "directory").agg(F.sum("change_count").alias("total_changes"), F.count(F.lit(1)).alias("file_count"), files.alias("top_files"))


def file_history(commits: DataFrame, file_changes: DataFrame, path: str, as_of: Column, days: int = 90) -> DataFrame:
    """Per repo: commits, sums, authors and mean size of the changes to one file."""
    own = commits.filter((F.col("ts") >= window_start(as_of, days)) & (F.col("ts") <= as_of))
    rows = file_changes.filter(F.col("path") == path).select("repo", "hash", "insertions", "deletions").join(own, ["repo", "hash"])
    return rows.groupBy("repo").agg(
        F.countDistinct("hash").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.countDistinct("author").alias("unique_authors"),
        F.floor(F.sum(F.col("insertions") + F.col("deletions")).cast("double") / F.countDistinct("hash") + 0.5).cast("bigint").alias("average_change_size"),
    )
