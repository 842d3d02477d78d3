"""Contributors: totals, timelines, streaks, heatmap and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsmath import divided, full_days, half_up, week_start


def _period(commits: DataFrame, since: Column | None, until: Column | None) -> DataFrame:
    own = commits.filter(~F.col("is_merge"))
    if since is not None:
        own = own.filter(F.col("ts") >= since)
    return own if until is None else own.filter(F.col("ts") <= until)


def commit_sizes(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Commits with their sums; commits without files count, binary files count as changed by nothing."""
    sizes = file_changes.groupBy("repo", "hash").agg(
        F.sum(F.when(F.col("binary"), 0).otherwise(F.col("insertions"))).alias("insertions"), F.sum(F.when(F.col("binary"), 0).otherwise(F.col("deletions"))).alias("deletions"), F.count(F.lit(1)).alias("files"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("insertions", "deletions", "files")}
    return commits.join(sizes, ["repo", "hash"], "left").withColumns(zero)


def streaks(days: DataFrame, as_of: Column) -> DataFrame:
    """Per repo and author of (repo, author, day): longest run of days, and the last run if it ends today or yesterday."""
    own = days.select("repo", "author", "day").distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("repo", "author").orderBy("day")))
    runs = own.withColumn("island", island).groupBy("repo", "author", "island").agg(F.count(F.lit(1)).alias("run"), F.max("day").alias("until"))
    last = F.max(F.struct("until", "run")).alias("last")
    found = runs.groupBy("repo", "author").agg(F.max("run").alias("longest_streak"), last)
    fresh = full_days(as_of, F.col("last.until").cast("timestamp")) <= 1
    return found.select("repo", "author", F.when(fresh, F.col("last.run")).otherwise(0).cast("bigint").alias("current_streak"), "longest_streak")


def top_files(commits: DataFrame, file_changes: DataFrame, most: int = 10) -> DataFrame:
    """Per repo and author the files changed in most commits, ties by path."""
    counted = commits.join(file_changes, ["repo", "hash"]).groupBy("repo", "author", "path").agg(F.count(F.lit(1)).alias("changes"))
    rank = F.row_number().over(Window.partitionBy("repo", "author").orderBy(F.col("changes").desc(), "path"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= most)


def contributor_stats(commits: DataFrame, file_changes: DataFrame, as_of: Column, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Per repo and author: commits, sums, distinct files, mean size, active days, first and last commit, streaks. The address is the newest commit's."""
    own = _period(commits, since, until)
    sized = commit_sizes(own, file_changes).withColumn("day", F.to_date("ts"))
    files = own.join(file_changes, ["repo", "hash"]).groupBy("repo", "author").agg(F.countDistinct("path").alias("files_changed"))
    total = sized.groupBy("repo", "author").agg(
        F.max(F.struct("ts", "hash", "author_email"))["author_email"].alias("email"), F.count(F.lit(1)).alias("commit_count"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.countDistinct("day").alias("active_days"), F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit"),
    )
    mean = half_up(divided(F.col("insertions") + F.col("deletions"), F.col("commit_count"))).cast("bigint")
    return (
        total.join(files, ["repo", "author"], "left").join(streaks(sized, as_of), ["repo", "author"])
        .withColumns({"files_changed": F.coalesce("files_changed", F.lit(0)), "average_commit_size": mean})
    )


def contributor_summary(commits: DataFrame, file_changes: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    sized = commit_sizes(_period(commits, since, until), file_changes)
    return sized.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_commits"), F.countDistinct("author").alias("total_contributors"), F.sum("insertions").alias("total_insertions"), F.sum("deletions").alias("total_deletions"),
        F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit"),
    )


def period_key(ts: Column, group_by: str) -> Column:
    day = F.to_date(ts)
    keys = {"day": lambda: F.date_format(day, "yyyy-MM-dd"), "week": lambda: F.date_format(week_start(day), "yyyy-MM-dd"), "month": lambda: F.date_format(day, "yyyy-MM")}
    if group_by not in keys:
        raise ValueError(f"group_by is one of {sorted(keys)}")
    return keys[group_by]()


def timeline(commits: DataFrame, file_changes: DataFrame, group_by: str = "week", since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Per repo and day, week (from Sunday) or month: commits, authors and sums; files are counted anew in each commit."""
    sized = commit_sizes(_period(commits, since, until), file_changes).withColumn("period", period_key(F.col("ts"), group_by))
    return sized.groupBy("repo", "period").agg(
        F.count(F.lit(1)).alias("commits"), F.array_sort(F.collect_set("author")).alias("authors"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.sum("files").alias("files_changed"),
    )


def heatmap(commits: DataFrame, since: Column | None = None) -> DataFrame:
    """Per repo all 168 cells of day (Sunday is 0) and hour with their commits."""
    own = _period(commits, since, None)
    counts = own.groupBy("repo", (F.dayofweek("ts") - 1).alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    cells = commits.select("repo").distinct().select("repo", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day")).select("repo", "day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return cells.join(counts, ["repo", "day", "hour"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def peak(cells: DataFrame) -> DataFrame:
    """Per repo the first fullest cell by day and hour; Sunday noon if all are empty."""
    best = cells.groupBy("repo").agg(F.max(F.struct("count", (-F.col("day")).alias("d"), (-F.col("hour")).alias("h"))).alias("b"))
    some = F.col("b.count") > 0
    return best.select("repo", F.when(some, -F.col("b.d")).otherwise(0).alias("peak_day"), F.when(some, -F.col("b.h")).otherwise(12).alias("peak_hour"), F.col("b.count").alias("peak_count"))


def find_contributor(stats: DataFrame, needle: str) -> DataFrame:
    """Per repo the contributor with most commits whose name or address holds the needle."""
    low = needle.lower()
    hit = stats.filter(F.lower("author").contains(low) | F.lower("email").contains(low))
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("commit_count").desc(), "author"))).filter("rank = 1").drop("rank")


def compare_contributors(stats: DataFrame, files: DataFrame, first: str, second: str) -> DataFrame:
    """Per repo two contributors side by side, with the files that are among both's most changed and their share in percent."""
    def one(needle: str, tag: str) -> DataFrame:
        paths = files.groupBy("repo", "author").agg(F.collect_set("path").alias("paths"))
        found = find_contributor(stats, needle).join(paths, ["repo", "author"], "left")
        return found.select("repo", F.col("author").alias(f"author_{tag}"), F.col("commit_count").alias(f"commits_{tag}"), F.coalesce("paths", F.array().cast("array<string>")).alias(f"paths_{tag}"))

    both = F.array_intersect("paths_1", "paths_2")
    share = half_up(divided(F.size("shared_files") * 100, F.size(F.array_union("paths_1", "paths_2")))).cast("bigint")
    joined = one(first, "1").join(one(second, "2"), "repo")
    return joined.withColumn("shared_files", F.array_sort(both)).withColumn("overlap_percent", share).drop("paths_1", "paths_2")
