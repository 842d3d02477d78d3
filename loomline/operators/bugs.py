"""Where a pattern came in: suspected commits, timelines, risk, and the search for commits that change a text's count.

commit_patches(repo, hash, path, patch) joins commits(repo, hash, author, ts, message) on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diffs import diff_lines

# Words that make a commit suspicious; each counts once.
SUSPICIOUS = ("fix", "bug", "hotfix", "patch", "workaround", "hack", "temporary", "todo", "fixme", "quick", "urgent")
KEYS = ["repo", "hash", "path"]


def patch_lines(patches: DataFrame) -> DataFrame:
    return diff_lines(patches, KEYS, skip_markers=True)


def suspicion_score(message: Column, matched: Column, changes: Column) -> Column:
    words = F.lit(0)
    for w in SUSPICIOUS:
        words = words + F.when(F.lower(message).contains(w), 10).otherwise(0)
    return F.least(F.lit(100), F.least(matched * 15, F.lit(50)) + words + F.when(changes > 100, 15).when(changes > 50, 10).otherwise(0))


# The sentences of reasons here and of recommendations in bug_risk.
def suspicion_reason(message: Column, matched: Column, changes: Column) -> Column:
    low = F.lower(message)
    return F.concat_ws(
        "; ", F.when(matched > 1, F.concat(F.lit("Pattern matched "), matched.cast("string"), F.lit(" times"))).otherwise(F.lit("Pattern match found")),
        F.when(low.contains("fix") | low.contains("bug"), F.lit("Commit message indicates bug fix")), F.when(low.contains("hotfix") | low.contains("urgent"), F.lit("Marked as urgent/hotfix")),
        F.when(changes > 100, F.lit("Large commit with many changes")),
    )


def _changes(commits: DataFrame, patches: DataFrame, since: Column | None, pattern: str | None) -> DataFrame:
    lines = patch_lines(patches)
    hit = F.col("content").rlike(f"(?i){pattern}") & (F.col("type") == "add") if pattern else F.lit(False)
    found = F.regexp_extract_all(F.col("content"), F.lit(f"(?i){pattern}"), F.lit(0)) if pattern else F.array().cast("array<string>")
    per_commit = lines.groupBy(*KEYS).agg(
        F.count_if(F.col("type") == "add").alias("added"), F.count_if(F.col("type") == "del").alias("removed"), F.count_if(hit).alias("matched"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(hit, found))))).alias("matched_patterns"),
        F.array_sort(F.collect_list(F.when(hit, F.struct(F.col("new_line").alias("line"), F.trim("content").alias("content"))))).alias("affected_lines"),
    )
    known = patches.select(*KEYS).distinct().join(per_commit, KEYS, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("added", "removed", "matched")})
    own = commits.select("repo", "hash", "author", "ts", "message")
    return known.join(own if since is None else own.filter(F.col("ts") >= since), ["repo", "hash"])


def suspected_commits(commits: DataFrame, patches: DataFrame, pattern: str, since: Column | None = None) -> DataFrame:
    """Commits that add lines fitting the pattern, per file, with score and reason; the most suspicious of a file has rank 1, ties by time and hash."""
    hits = _changes(commits, patches, since, pattern).filter("matched > 0")
    n = F.col("added") + F.col("removed")
    order = Window.partitionBy("repo", "path").orderBy(F.col("suspicion_score").desc(), "ts", "hash")
    found = hits.select(
        *KEYS, "author", "ts", "message", F.col("matched").alias("matched_lines"), "matched_patterns", "affected_lines",
        suspicion_score(F.col("message"), F.col("matched"), n).cast("bigint").alias("suspicion_score"), suspicion_reason(F.col("message"), F.col("matched"), n).alias("reason"),
    )
    return found.withColumn("rank", F.row_number().over(order))


def change_timeline(commits: DataFrame, patches: DataFrame, since: Column | None = None) -> DataFrame:
    """Commits of each file in order of time; the first introduced it, the others say how they changed it."""
    rows = _changes(commits, patches, since, None)
    number = F.row_number().over(Window.partitionBy("repo", "path").orderBy("ts", "hash"))
    kind = F.when(F.col("seq") == 1, "introduced").when((F.col("removed") > 0) & (F.col("added") == 0), "deleted").when((F.col("added") > 0) & (F.col("removed") == 0), "restored").otherwise("modified")
    return rows.withColumn("seq", number).select("repo", "path", "seq", "hash", "author", "ts", "message", kind.alias("change_type"))


def bug_risk(commits: DataFrame, patches: DataFrame, pattern: str, since: Column | None = None) -> DataFrame:
    """Per file: commits, suspected ones, first commit with the pattern, risk level and recommendation."""
    rows = _changes(commits, patches, since, pattern)
    n = F.col("added") + F.col("removed")
    scored = rows.withColumn("score", suspicion_score(F.col("message"), F.col("matched"), n))
    hit = F.col("matched") > 0
    per = scored.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("total_commits"), F.count_if(hit).alias("suspected"), F.count_if(hit & (F.col("score") >= 70)).alias("high"),
        F.min(F.when(hit, F.struct("ts", "hash")))["hash"].alias("first_introduced"),
    )
    share = F.col("suspected") / F.greatest(F.col("total_commits"), F.lit(1)).cast("double")
    level = F.when(F.col("suspected") == 0, "low").when((F.col("high") >= 3) | (share > 0.5), "high").when((F.col("high") >= 1) | (share > 0.2), "medium").otherwise("low")
    count = F.col("suspected").cast("string")
    text = (
        F.when(F.col("risk_level") == "high", F.concat(F.lit("High risk: "), count, F.lit(" commits introduced the pattern. Review all suspected commits carefully and consider refactoring.")))
        .when(F.col("risk_level") == "medium", F.concat(F.lit("Medium risk: Pattern found in "), count, F.lit(" commit(s). Review the suspected commits to understand the context.")))
        .when(F.col("suspected") > 0, F.lit("Low risk: Pattern found but appears intentional. Verify the implementation."))
        .otherwise(F.lit(f'Pattern "{pattern}" not found in recent history. Consider extending the search range or checking if the file was renamed.'))
    )
    return per.withColumn("risk_level", level).withColumn("recommendation", text)


def pickaxe(commits: DataFrame, patches: DataFrame, text: str, since: Column | None = None) -> DataFrame:
    """Commits and files in which the number of occurrences of a literal text changes."""
    occurs = ((F.length("content") - F.length(F.replace(F.col("content"), F.lit(text), F.lit("")))) / len(text)).cast("bigint")
    counted = patch_lines(patches).groupBy(*KEYS).agg(F.sum(F.when(F.col("type") == "add", occurs).otherwise(0)).alias("plus"), F.sum(F.when(F.col("type") == "del", occurs).otherwise(0)).alias("minus"))
    own = commits if since is None else commits.filter(F.col("ts") >= since)
    return counted.filter("plus <> minus").join(own.select("repo", "hash", "author", "ts", "message"), ["repo", "hash"]).select("repo", "hash", "path", "author", "ts", "message", F.lit(1).alias("match_count"))
