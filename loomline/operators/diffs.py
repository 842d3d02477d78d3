"""Unified diffs as rows: hunks, lines with their numbers, context and sums.

A patch is split into its lines, and running counts over one patch's lines number hunks and lines; patches are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import language

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _number(line: Column, group: int, default: int) -> Column:
    found = F.regexp_extract(line, HUNK, group)
    return F.when(found == "", F.lit(default)).otherwise(found.cast("int"))


def diff_lines(patches: DataFrame, keys: list[str], skip_markers: bool = False) -> DataFrame:
    """patches(keys, patch) to one row per line in a hunk: hunk, pos, type (add, del, normal), old_line, new_line, content.

    Lines before the first hunk are dropped, and lines that begin with neither sign are normal, also the marker for a
    missing line end; skip_markers leaves that marker and file headers out instead. Null patches have no lines.
    """
    parts = F.split(F.coalesce("patch", F.lit("")), "\n", -1)
    lines = patches.select(*keys, F.posexplode(parts).alias("pos", "line"))
    by = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("line").rlike(HUNK)
    lines = lines.withColumn("hunk", F.sum(F.when(head, 1).otherwise(0)).over(by)).filter("hunk > 0")
    skipped = (F.col("line").startswith("\\") | F.col("line").startswith("+++") | F.col("line").startswith("---")) if skip_markers else F.lit(False)
    plus, minus = F.col("line").startswith("+"), F.col("line").startswith("-")
    in_hunk = Window.partitionBy(*keys, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    old_start = F.max(F.when(head, _number(F.col("line"), 1, 1))).over(in_hunk)
    new_start = F.max(F.when(head, _number(F.col("line"), 3, 1))).over(in_hunk)
    body = ~head & ~skipped
    old_seen = F.sum(F.when(body & ~plus, 1).otherwise(0)).over(in_hunk)
    new_seen = F.sum(F.when(body & ~minus, 1).otherwise(0)).over(in_hunk)
    kind = F.when(plus, "add").when(minus, "del").otherwise("normal")
    text = F.when(plus | minus | F.col("line").startswith(" "), F.expr("substring(line, 2)")).otherwise(F.col("line"))
    numbered = lines.select(
        *keys, F.col("hunk").cast("int").alias("hunk"), "pos", kind.alias("type"),
        F.when(~plus, old_start + old_seen - 1).cast("int").alias("old_line"), F.when(~minus, new_start + new_seen - 1).cast("int").alias("new_line"), text.alias("content"), body.alias("_body"),
    )
    return numbered.filter("_body").drop("_body")


def split_diff(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """diffs(keys, diff) of many files to one row per file: file_ix, filename, language, additions, deletions, patch.

    A file begins with its `diff --git` line. Its name is that of the `+++` line, or else of the `---` line or the header;
    a deleted file is so named /dev/null. Text before the first file is left out; null has no files.
    """
    parts = F.filter(F.split(F.coalesce("diff", F.lit("")), r"(?m)^(?=diff --git )"), lambda p: p.startswith("diff --git "))
    files = diffs.select(*keys, F.posexplode(parts).alias("file_ix", "text"))
    found = lambda form: F.nullif(F.regexp_extract("text", form, 1), F.lit(""))
    name = F.coalesce(found(r"(?m)^\+\+\+ (?:b/)?([^\t\r\n]+)"), found(r"(?m)^--- (?:a/)?([^\t\r\n]+)"), found(r"^diff --git a/.+? b/([^\r\n]+)"), F.lit("unknown"))
    body = F.when(F.col("text").rlike(r"(?m)^@@ "), F.regexp_replace("text", r"(?s)^.*?\n(?=@@ )", "")).otherwise(F.lit(""))
    lines = F.split("patch", "\n")
    count = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign))).cast("bigint")
    return files.select(*keys, F.col("file_ix").cast("int").alias("file_ix"), name.alias("filename"), F.regexp_replace(body, r"\n$", "").alias("patch")).select(
        *keys, "file_ix", "filename", language(F.col("filename")).alias("language"), count("+").alias("additions"), count("-").alias("deletions"), "patch")


def added_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("type = 'add'").drop("old_line", "type").withColumnRenamed("new_line", "line")


def deleted_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("type = 'del'").drop("new_line", "type").withColumnRenamed("old_line", "line")


def line_context(lines: DataFrame, keys: list[str], around: int = 3) -> DataFrame:
    """Each line that is not deleted with up to `around` such lines before and after it in its hunk."""
    kept = lines.filter("type <> 'del'")
    by = Window.partitionBy(*keys, "hunk").orderBy("pos")
    return kept.select(
        *keys, "hunk", F.col("new_line").alias("line"), "content",
        F.collect_list("content").over(by.rowsBetween(-around, -1)).alias("before"), F.collect_list("content").over(by.rowsBetween(1, around)).alias("after"),
    )


def diff_stats(files: DataFrame, lines: DataFrame, key: str = "pr_id") -> DataFrame:
    """Per diff: share of added and deleted lines, churn ratio, mean hunk size, and the file with most changes (first of equals)."""
    totals = files.groupBy(key).agg(
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count(F.lit(1)).alias("files_changed"),
        F.max(F.struct((F.col("additions") + F.col("deletions")).alias("changes"), (-F.col("file_ix")).alias("ix"), "filename"))["filename"].alias("largest_file"),
    )
    hunks = lines.groupBy(key, "filename", "hunk").agg(F.count(F.lit(1)).alias("size")).groupBy(key).agg(F.avg("size").alias("average_hunk_size"))
    both = F.greatest(F.col("additions") + F.col("deletions"), F.lit(1)).cast("double")
    return totals.join(hunks, key, "left").select(
        key, "files_changed", "additions", "deletions", (F.col("additions") / both).alias("added_ratio"), (F.col("deletions") / both).alias("deleted_ratio"),
        (F.least("additions", "deletions") / F.greatest("additions", "deletions", F.lit(1)).cast("double")).alias("churn_ratio"), F.coalesce("average_hunk_size", F.lit(0.0)).alias("average_hunk_size"), "largest_file",
    )
