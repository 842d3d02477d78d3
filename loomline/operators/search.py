"""Ranked search in commit messages, details of a commit, and the commits of a file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsmath import half_up
from ..functions.textsim import longer_words, similarity


def query_terms(query: str) -> list[str]:
    if not query:
        raise ValueError("the query is empty")
    return [t for t in re.split(r"\s+", query.lower().strip()) if len(t) > 2]


def search_commits(commits: DataFrame, file_changes: DataFrame, query: str, author: str | None = None, since: Column | None = None, until: Column | None = None, limit: int = 50, max_scan: int | None = None) -> DataFrame:
    """The best matches by relevance, then date. Relevance weighs the message 0.7 and the body 0.3; a commit with any term in its text has 10 at least.

    The first longer term prefilters; max_scan keeps the newest commits only (the interactive tool's 1000), and is off by default.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit is 1 to 500")
    terms = query_terms(query)
    own = commits
    if author is not None:
        own = own.filter(F.col("author").rlike(author) | F.col("author_email").rlike(author))
    if since is not None:
        own = own.filter(F.col("ts") >= since)
    if until is not None:
        own = own.filter(F.col("ts") <= until)
    if terms:
        own = own.filter(F.lower(F.concat_ws("\n", "message", F.coalesce("body", F.lit("")))).contains(terms[0]))
    if max_scan is not None:
        own = own.orderBy(F.col("ts").desc(), "repo", "hash").limit(max_scan)
    # the word sets and the text are made once: each is used several times below, so they stay a projection of their own
    words = own.select(
        "repo", "hash", "author", "ts", "message", longer_words(F.lit(query)).alias("wanted"), longer_words(F.col("message")).alias("m"), longer_words(F.col("body")).alias("b"),
        F.lower(F.concat_ws(" ", "message", F.coalesce("body", F.lit("")))).alias("text"),
    )
    score = half_up((similarity(F.col("wanted"), F.col("m")) * F.lit(0.7) + similarity(F.col("wanted"), F.col("b")) * F.lit(0.3)) * F.lit(100.0)).cast("int")
    any_term = F.lit(False)
    for t in terms:
        any_term = any_term | F.col("text").contains(t)
    kept = words.withColumn("score", score).filter((F.col("score") > 0) | any_term)
    best = kept.select("repo", "hash", "author", "ts", "message", F.greatest("score", F.lit(10)).alias("relevance")).orderBy(F.col("relevance").desc(), F.col("ts").desc(), "repo", "hash").limit(limit)
    sizes = file_changes.join(F.broadcast(best.select("repo", "hash")), ["repo", "hash"]).groupBy("repo", "hash").agg(
        F.count(F.lit(1)).alias("files_changed"), F.sum(F.when(~F.col("binary"), F.col("insertions")).otherwise(0)).alias("insertions"), F.sum(F.when(~F.col("binary"), F.col("deletions")).otherwise(0)).alias("deletions"),
    )
    return best.join(sizes, ["repo", "hash"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files_changed", "insertions", "deletions")})


def commit_details(commits: DataFrame, file_changes: DataFrame, repo: str, hash_: str) -> DataFrame:
    """One commit with its files, in order of path."""
    one = commits.filter((F.col("repo") == repo) & (F.col("hash") == hash_))
    files = file_changes.filter((F.col("repo") == repo) & (F.col("hash") == hash_)).groupBy("repo", "hash").agg(
        F.array_sort(F.collect_list("path")).alias("files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    return one.join(files, ["repo", "hash"], "left")


def commits_for_file(commits: DataFrame, file_changes: DataFrame, path: str, limit: int = 50) -> DataFrame:
    """The newest commits that changed a file; sums are not filled in."""
    hits = file_changes.filter(F.col("path") == path).select("repo", "hash").distinct()
    found = commits.join(hits, ["repo", "hash"]).select("repo", "hash", "author", "ts", "message", F.lit(1).alias("files_changed"), F.lit(0).alias("insertions"), F.lit(0).alias("deletions"))
    return found.orderBy(F.col("ts").desc(), "repo", "hash").limit(limit)
