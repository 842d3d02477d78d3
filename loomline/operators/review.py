"""Review of pull requests: issues, suggestions, risk, quality score, action, details and the outbox of comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rules
from .diffs import added_lines, diff_lines

KEYS = ["pr_id", "file_ix", "filename"]


def pr_added_lines(files: DataFrame) -> DataFrame:
    return added_lines(diff_lines(files, KEYS))


def pr_issues(files: DataFrame, focus: list[str] | None = None) -> DataFrame:
    """Issues of all pull requests, numbered within each in order of file, line, category and rule."""
    found = rules.issues(pr_added_lines(files), focus)
    order = Window.partitionBy("pr_id").orderBy("file_ix", "pos", "category_ix", "rule_ix")
    number = F.concat(F.lit("issue-"), F.row_number().over(order).cast("string"))
    return found.select("pr_id", number.alias("issue_id"), "file_ix", "filename", "line", "pos", "category", "severity", "title", "suggestion")


def issue_suggestions(issues: DataFrame) -> DataFrame:
    """A suggestion for each critical or high issue with a line."""
    kinds = F.create_map(*[F.lit(x) for pair in (("security", "security-fix"), ("performance", "optimization"), ("bug", "refactor"), ("style", "best-practice"), ("maintainability", "best-practice")) for x in pair])
    own = issues.filter(F.col("severity").isin("critical", "high") & (F.col("line") > 0))
    return own.select("pr_id", "issue_id", "filename", "line", F.col("suggestion").alias("reason"), F.coalesce(kinds[F.col("category")], F.lit("refactor")).alias("type"), F.when(F.col("severity") == "critical", "high").otherwise("medium").alias("confidence"))


# What makes a file sensitive or configuration, and the sentences about risk and comments below, with their limits.
def sensitive(filename: Column) -> Column:
    return filename.rlike(r"(?i)\.(env|pem|key|secret|credential|password|auth)") | filename.rlike(r"(?i)(config|secret|credential|password|auth)")


def configuration(filename: Column) -> Column:
    return filename.rlike(r"(?i)\.(json|yaml|yml|toml|ini|conf)$") | filename.rlike(r"(?i)package\.json|tsconfig|webpack|babel|eslint")


def pr_risk(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Per pull request: risk score, level and factors."""
    size = files.groupBy("pr_id").agg(
        F.sum(F.col("additions") + F.col("deletions")).alias("changes"), F.count(F.lit(1)).alias("n_files"),
        F.sort_array(F.collect_list(F.when(sensitive(F.col("filename")), F.struct("file_ix", "filename")))).alias("sensitive"), F.count_if(configuration(F.col("filename"))).alias("config"),
    )
    counted = issues.groupBy("pr_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    full = size.join(counted, "pr_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("critical", "high")})
    n_sensitive = F.size("sensitive")
    score = (
        F.col("critical") * 10 + F.col("high") * 5 + F.when(F.col("changes") > 1000, 3).when(F.col("changes") > 500, 2).otherwise(0)
        + F.when(F.col("n_files") > 20, 3).when(F.col("n_files") > 10, 1).otherwise(0) + F.when(n_sensitive > 0, 5).otherwise(0) + F.when(F.col("config") > 0, 1).otherwise(0)
    )
    factors = F.array_compact(F.array(
        F.when(F.col("critical") > 0, F.concat(F.col("critical").cast("string"), F.lit(" critical issue(s) found"))),
        F.when(F.col("high") > 0, F.concat(F.col("high").cast("string"), F.lit(" high severity issue(s) found"))),
        F.when(F.col("changes") > 1000, F.lit("Large number of changes (>1000 lines)")).when(F.col("changes") > 500, F.lit("Medium-large change size (>500 lines)")),
        F.when(F.col("n_files") > 20, F.lit("Many files changed (>20)")).when(F.col("n_files") > 10, F.lit("Multiple files changed (>10)")),
        F.when(n_sensitive > 0, F.concat(F.lit("Security-sensitive files modified: "), F.array_join(F.transform("sensitive", lambda s: s["filename"]), ", "))),
        F.when(F.col("config") > 0, F.lit("Configuration files modified")),
    ))
    level = F.when(F.col("risk_score") >= 15, "critical").when(F.col("risk_score") >= 8, "high").when(F.col("risk_score") >= 3, "medium").otherwise("low")
    return full.withColumn("risk_score", score.cast("bigint")).select("pr_id", F.col("changes").alias("total_changes"), F.col("n_files").alias("files_changed"), "risk_score", level.alias("risk_level"), factors.alias("risk_factors"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).when(severity == "low", 3).otherwise(4)


def review_suggestions(files: DataFrame) -> DataFrame:
    """Suggestions by line and by file, most severe first (severity_ix)."""
    by_line = rules.review_hits(pr_added_lines(files)).select("pr_id", "file_ix", "filename", F.col("line").cast("bigint").alias("line"), "category", "severity", "title", "description", "suggested_fix")
    is_test = F.col("filename").rlike(r"(?i)\.(test|spec)\.(ts|js|tsx|jsx)$")
    is_source = F.col("filename").rlike(r"(?i)\.(ts|js|tsx|jsx)$") & ~is_test
    added = F.col("additions").cast("string")
    found = F.array_compact(F.array(
        F.when(F.col("additions") > 500, F.struct(F.lit("maintainability").alias("category"), F.lit("medium").alias("severity"), F.lit("Large number of additions").alias("title"),
               F.concat(F.lit("This file has "), added, F.lit(" additions. Consider breaking into smaller, focused changes.")).alias("description"), F.lit("Split into multiple smaller PRs if possible.").alias("suggested_fix"))),
        F.when(is_source & (F.col("additions") > 50), F.struct(F.lit("maintainability").alias("category"), F.lit("low").alias("severity"), F.lit("Consider adding tests").alias("title"),
               F.lit("Significant code changes should include corresponding tests.").alias("description"), F.concat(F.lit("Add test coverage for "), F.col("filename")).alias("suggested_fix"))),
    ))
    by_file = files.select("pr_id", "file_ix", "filename", F.lit(None).cast("bigint").alias("line"), F.explode(found).alias("f")).select("pr_id", "file_ix", "filename", "line", "f.*")
    return by_line.unionByName(by_file).withColumn("severity_ix", severity_rank(F.col("severity")))


def quality(pull_requests: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Per pull request: score 0 to 100, counts by severity, and the recommended action."""
    count = {s: F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")}
    counted = suggestions.groupBy("pr_id").agg(*count.values())
    full = pull_requests.select("pr_id", "additions", "deletions", "changed_files").join(counted, "pr_id", "left").withColumns({s: F.coalesce(s, F.lit(0)) for s in count})
    changes = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    files = F.coalesce("changed_files", F.lit(0))
    score = 100 - F.col("critical") * 15 - F.col("high") * 8 - F.col("medium") * 3 - F.col("low") - F.when(changes > 1000, 10).when(changes > 500, 5).otherwise(0) - F.when(files > 20, 10).when(files > 10, 5).otherwise(0)
    scored = full.withColumn("quality_score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint"))
    action = (
        F.when((F.col("critical") > 0) | (F.col("high") > 2) | (F.col("quality_score") < 50), "REQUEST_CHANGES").when((F.col("high") > 0) | (F.col("quality_score") < 75), "COMMENT").otherwise("APPROVE")
    )
    return scored.select("pr_id", "quality_score", *count, action.alias("action"))


def merged_comments(issue_comments: DataFrame, review_comments: DataFrame) -> DataFrame:
    """Both kinds of comments, in order of their time within a pull request (seq)."""
    both = issue_comments.withColumn("kind", F.lit("issue")).unionByName(review_comments.withColumn("kind", F.lit("review")), allowMissingColumns=True)
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("pr_id").orderBy("created_at", "id")))


def pr_details(pull_requests: DataFrame, files: DataFrame, comments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per pull request: its files by the four usual statuses, comments, and reviews by the three usual states; counts() has every status and state."""
    status = files.groupBy("pr_id").agg(
        F.count(F.lit(1)).alias("n_files"), *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "removed", "renamed")],
    )
    talk = comments.groupBy("pr_id").agg(F.count(F.lit(1)).alias("n_comments"), F.countDistinct("author").alias("commenters"))
    state = reviews.groupBy("pr_id").agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("APPROVED", "CHANGES_REQUESTED", "COMMENTED")])
    full = pull_requests.join(status, "pr_id", "left").join(talk, "pr_id", "left").join(state, "pr_id", "left")
    zero = ["n_files", "added", "modified", "removed", "renamed", "n_comments", "commenters", "approved", "changes_requested", "commented"]
    return full.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def counts(rows: DataFrame, by: str) -> DataFrame:
    """(pr_id, by, n): how often each value occurs, whatever the values are; null is a value."""
    return rows.groupBy("pr_id", by).agg(F.count(F.lit(1)).alias("n"))


def comment_errors(comments: DataFrame) -> DataFrame:
    """comments with an array of what is wrong; any entry keeps a comment from being sent."""
    line, path, start, reply = (F.col(c) for c in ("line", "path", "start_line", "in_reply_to"))
    wrong = F.array_compact(F.array(
        F.when((F.coalesce(path, F.lit("")) != "") & (F.coalesce(line, F.lit(0)) == 0) & (F.coalesce("subject_type", F.lit("line")) != "file"), F.lit("Line number is recommended when providing a file path for inline comments.")),
        F.when(start.isNotNull() & line.isNull(), F.lit("End line (line) must be provided when startLine is specified.")).when(start >= line, F.lit("startLine must be less than line for multi-line comments.")),
        F.when((F.coalesce(reply, F.lit(0)) != 0) & ((F.coalesce(path, F.lit("")) != "") | (F.coalesce(line, F.lit(0)) != 0)), F.lit("When replying to a comment, do not specify path or line.")),
    ))
    return comments.withColumn("errors", wrong)


def comment_outbox(comments: DataFrame, heads: DataFrame) -> DataFrame:
    """What would be posted: replies, general comments and inline comments, with the head commit where none is given. Comments with errors are left out."""
    sound = comment_errors(comments).filter(F.size("errors") == 0).join(heads.select("pr_id", "head_sha"), "pr_id", "left")
    action = F.when(F.col("in_reply_to").isNotNull(), "reply").when(F.col("path").isNull(), "general").otherwise("inline")
    inline = action == "inline"
    return sound.select(
        "pr_id", "id", action.alias("action"), "body", F.when(inline, F.col("path")).alias("path"), F.when(inline, F.col("line")).alias("line"), F.when(inline, F.coalesce("side", F.lit("RIGHT"))).alias("side"),
        F.when(inline, F.coalesce("commit_id", "head_sha")).alias("commit_id"), F.when(action == "reply", F.col("in_reply_to")).alias("in_reply_to"),
    )


def review_outbox(reviews: DataFrame, comments: DataFrame, heads: DataFrame) -> DataFrame:
    """Reviews to submit (pr_id, body, event, commit_id) with their inline comments."""
    inline = comments.groupBy("pr_id").agg(F.sort_array(F.collect_list(F.struct("path", "line", F.coalesce("side", F.lit("RIGHT")).alias("side"), "body"))).alias("comments"))
    known = reviews.filter(F.col("event").isin("APPROVE", "REQUEST_CHANGES", "COMMENT"))
    return known.join(heads.select("pr_id", "head_sha"), "pr_id", "left").join(inline, "pr_id", "left").select("pr_id", "event", "body", F.coalesce("commit_id", "head_sha").alias("commit_id"), "comments")


def suggestion_body(description: Column, code: Column) -> Column:
    return F.concat(description, F.lit("\n\n```suggestion\n"), code, F.lit("\n```"))


def code_block_body(description: Column, code: Column, language: Column) -> Column:
    return F.concat(description, F.lit("\n\n```"), F.coalesce(language, F.lit("")), F.lit("\n"), code, F.lit("\n```"))


# Marks of the severities.
MARKS = {"critical": ":rotating_light:", "high": ":warning:", "medium": ":large_orange_diamond:", "low": ":information_source:", "info": ":bulb:"}


def body_with_metadata(body: Column, severity: Column, category: Column, automated: Column, issue_id: Column, author: str = "") -> Column:
    """The body under a line of severity and category, with a note (that names its author, if one is given) and an issue id where they are wanted."""
    mark = F.lit(":speech_balloon:")
    for name, sign in MARKS.items():
        mark = F.when(F.lower(severity) == name, F.lit(sign)).otherwise(mark)
    head = F.concat(F.coalesce(F.concat(mark, F.lit(" **"), F.upper(severity), F.lit("**")), F.lit("")), F.coalesce(F.concat(F.lit("["), category, F.lit("]")), F.lit("")))
    note = F.when(automated, F.lit("\n\n---\n*This comment was generated automatically" + (f" by {author}" if author else "") + "*")).otherwise(F.lit(""))
    return F.concat(head, F.when(head != "", F.lit("\n\n")).otherwise(F.lit("")), body, note, F.coalesce(F.concat(F.lit("\n<!-- issue-id: "), issue_id, F.lit(" -->")), F.lit("")))
