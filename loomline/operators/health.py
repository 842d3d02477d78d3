"""Repository health: six metrics with bands, overall score, grade, recommendations, comparison and trend."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsmath import full_days, half_up
from ..functions.paths import CODE, DOCS, any_of
from .churn import churn_summary, file_churn, window_start


class Band(NamedTuple):
    excellent: float
    good: float
    fair: float
    poor: float
    higher: bool
    weight: float
    describe: str
    unit: str


# Bands, direction, weight and description of each metric, in the order in which they are listed.
BANDS = {
    "commitFrequency": Band(10, 5, 2, 0.5, True, 1.5, "Average commits per week: ", "/week"),
    "averageCommitSize": Band(50, 150, 300, 500, False, 1.0, "Average lines changed per commit: ", " lines"),
    "documentationRatio": Band(15, 8, 3, 1, True, 0.8, "Documentation files ratio: ", "%"),
    "codeChurnRate": Band(0.5, 1, 2, 4, False, 1.2, "Code churn rate: ", "/file/week"),
    "contributorActivity": Band(5, 3, 2, 1, True, 0.8, "Active contributors in last 30 days: ", ""),
    "branchHealth": Band(10, 25, 50, 75, False, 0.7, "Stale branches: ", "%"),
}
# Priority, category, message and action for each metric that is poor or critical.
ADVICE = {
    "commitFrequency": ("high", "Activity", "Very low commit frequency detected", "Consider breaking work into smaller, more frequent commits for better tracking and easier code reviews"),
    "averageCommitSize": ("medium", "Commit Quality", "Commits are too large on average", "Break down changes into smaller, atomic commits that are easier to review and revert if needed"),
    "documentationRatio": ("medium", "Documentation", "Low documentation ratio", "Add README files, inline comments, and API documentation to improve code maintainability"),
    "codeChurnRate": ("high", "Code Stability", "High code churn rate indicates instability", "Review frequently changing files for potential architectural issues or unclear requirements"),
    "contributorActivity": ("low", "Team", "Low contributor diversity", "Encourage more team members to contribute and consider knowledge sharing sessions"),
    "branchHealth": ("low", "Repository", "Too many stale branches", "Clean up merged and abandoned branches to keep the repository organized"),
}


def band_score(value: Column, band: Band) -> Column:
    """0 to 100, linear within each band, rounded half up."""
    e, g, f, p = (F.lit(float(x)) for x in band[:4])
    if band.higher:
        raw = F.when(value >= e, 90 + (value - e) / e * 10).when(value >= g, 70 + (value - g) / (e - g) * 20).when(value >= f, 50 + (value - f) / (g - f) * 20).when(value >= p, 25 + (value - p) / (f - p) * 25)
        raw = raw.otherwise(F.greatest(F.lit(0.0), value / p * 25))
    else:
        raw = F.when(value <= e, 90 + (e - value) / e * 10).when(value <= g, 70 + (g - value) / (g - e) * 20).when(value <= f, 50 + (f - value) / (f - g) * 20).when(value <= p, 25 + (p - value) / (p - f) * 25)
        raw = raw.otherwise(F.greatest(F.lit(0.0), 25 - (value - p) / p * 25))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), half_up(raw))).cast("int")


def band_status(value: Column, band: Band) -> Column:
    reached = (lambda limit: value >= limit) if band.higher else (lambda limit: value <= limit)
    out = F.lit("critical")
    for name in ("poor", "fair", "good", "excellent"):
        out = F.when(reached(float(getattr(band, name))), F.lit(name)).otherwise(out)
    return out


def metric_rows(values: DataFrame, name: str) -> DataFrame:
    """values(repo, value) to metric rows. A null value means that there is nothing to measure: score 50, fair, N/A."""
    band, value = BANDS[name], F.col("value")
    shown = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    known = value.isNotNull()
    display = F.col("display") if "display" in values.columns else F.when(known, F.concat(shown, F.lit(band.unit))).otherwise(F.lit("N/A"))
    return values.select(
        "repo", F.lit(name).alias("metric"), F.lit(list(BANDS).index(name)).alias("metric_ix"), value.alias("raw_value"), F.when(known, band_score(value, band)).otherwise(50).alias("score"), F.lit(band.weight).alias("weight"),
        F.when(known, band_status(value, band)).otherwise("fair").alias("status"), display.alias("value"), F.concat(F.lit(band.describe), display).alias("description"),
    )


def health_metrics(commits: DataFrame, file_changes: DataFrame, branches: DataFrame, repo_files: DataFrame, as_of: Column, size_mode: str = "reference") -> DataFrame:
    """The six metrics of every repository.

    size_mode 'reference' takes all changes of the 30 days as one commit, as the tool this follows does; 'per_commit' divides.
    """
    if size_mode not in ("reference", "per_commit"):
        raise ValueError("size_mode is reference or per_commit")
    repos = commits.select("repo").union(branches.select("repo")).union(repo_files.select("repo")).distinct()
    recent = commits.filter((F.col("ts") >= window_start(as_of, 30)) & (F.col("ts") <= as_of))

    def full(df: DataFrame, default: float | None) -> DataFrame:
        value = F.col("value").cast("double")
        return repos.join(df, "repo", "left").select("repo", value.alias("value") if default is None else F.coalesce(value, F.lit(default)).alias("value"))

    activity = recent.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("authors"))
    frequency = activity.select("repo", (half_up(F.col("n") / F.lit(30.0) * 7 * 10) / 10).alias("value"))
    lines = recent.filter("not is_merge").join(file_changes, ["repo", "hash"], "left").groupBy("repo").agg(
        F.sum(F.when(~F.col("binary"), F.col("insertions") + F.col("deletions")).otherwise(0)).alias("lines"), F.countDistinct("hash").alias("n"))
    size = lines.select("repo", (F.col("lines") if size_mode == "reference" else half_up(F.col("lines") / F.col("n"))).alias("value"))
    kinds = repo_files.groupBy("repo").agg(F.count_if(any_of(F.col("path"), DOCS)).alias("docs"), F.count_if(F.col("path").rlike(CODE)).alias("code"))
    ratio = kinds.select("repo", F.when(F.col("code") > 0, half_up(F.col("docs") / F.col("code") * 100)).otherwise(0.0).alias("value"))
    churn = churn_summary(file_churn(commits, file_changes, as_of, 30, 1), as_of, 30).select("repo", (F.col("average_churn_rate") * 7).alias("value"))
    age = full_days(as_of, F.col("ts"))
    counted = repos.join(branches.groupBy("repo").agg(F.count_if(age > 30).alias("old"), F.count(F.lit(1)).alias("n")), "repo", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("old", "n")})
    ratio_text = F.concat(F.col("old").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" stale"))
    stale = counted.select("repo", F.when(F.col("n") > 0, F.col("old") / F.col("n").cast("double") * 100).otherwise(0.0).alias("value"), ratio_text.alias("display"))
    parts = [
        metric_rows(full(frequency, 0.0), "commitFrequency"), metric_rows(full(size, None), "averageCommitSize"), metric_rows(full(ratio, 0.0), "documentationRatio"),
        metric_rows(full(churn, 0.0), "codeChurnRate"), metric_rows(full(activity.select("repo", F.col("authors").alias("value")), 0.0), "contributorActivity"), metric_rows(stale, "branchHealth"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def overall(metrics: DataFrame) -> DataFrame:
    """Per repo: weighted score, grade and a summary that names strengths and weaknesses."""
    names = lambda *kinds: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status").isin(*kinds), F.struct("metric_ix", "metric")))), lambda s: s["metric"]), ", ")
    rows = metrics.groupBy("repo").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("s"), names("excellent", "good").alias("strong"), names("poor", "critical").alias("weak"))
    score = half_up(F.col("s")).cast("int")
    text = F.concat_ws(
        " ", F.concat(F.lit("Repository health score: "), F.col("score").cast("string"), F.lit("/100 (Grade "), F.col("grade"), F.lit(").")),
        F.when(F.col("strong") != "", F.concat(F.lit("Strengths: "), F.col("strong"), F.lit("."))), F.when(F.col("weak") != "", F.concat(F.lit("Areas needing attention: "), F.col("weak"), F.lit("."))),
    )
    return rows.withColumn("score", score).withColumn("grade", grade(F.col("score"))).select("repo", "score", "grade", text.alias("summary"))


def health_recommendations(metrics: DataFrame) -> DataFrame:
    """One for each poor or critical metric; seq orders them by priority within a repo."""
    table = F.create_map(*[x for m, a in ADVICE.items() for x in (F.lit(m), F.struct(*[F.lit(v).alias(k) for k, v in zip(("priority", "category", "message", "action"), a, strict=True)]))])
    rows = metrics.filter(F.col("status").isin("poor", "critical")).withColumn("a", table[F.col("metric")])
    rank = F.when(F.col("a.priority") == "high", 0).when(F.col("a.priority") == "medium", 1).otherwise(2)
    return rows.select("repo", F.row_number().over(Window.partitionBy("repo").orderBy(rank, "metric_ix")).alias("seq"), "a.priority", "a.category", "a.message", "a.action")


def compare_health(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """Two repositories metric by metric: scores, winner or tie."""
    a = metrics.filter(F.col("repo") == first).select("metric", F.col("score").alias("score_1"))
    b = metrics.filter(F.col("repo") == second).select("metric", F.col("score").alias("score_2"))
    winner = F.when(F.col("score_1") > F.col("score_2"), F.lit(first)).when(F.col("score_2") > F.col("score_1"), F.lit(second)).otherwise(F.lit("tie"))
    return a.join(b, "metric").withColumn("winner", winner)


def health_trend(commits: DataFrame, file_changes: DataFrame, branches: DataFrame, repo_files: DataFrame, ends: Sequence[str]) -> DataFrame:
    """Score and grade of every repository as of each given time."""
    out = None
    for at in ends:
        one = overall(health_metrics(commits, file_changes, branches, repo_files, F.lit(at).cast("timestamp"))).select("repo", F.lit(at).alias("as_of"), "score", "grade")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no times are given")
    return out


def repository_info(commits: DataFrame, branches: DataFrame, repo_files: DataFrame) -> DataFrame:
    """Per repo: commits, contributors, branches, files, first and last commit; reported_created is the newest commit, which is what the tool this follows reports."""
    c = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("total_commits"), F.countDistinct("author").alias("total_contributors"), F.min("ts").alias("created"), F.max("ts").alias("last_commit"), F.max("ts").alias("reported_created"))
    b = branches.groupBy("repo").agg(F.count(F.lit(1)).alias("total_branches"))
    f = repo_files.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files"))
    return c.join(b, "repo", "left").join(f, "repo", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("total_branches", "total_files")})
