"""Text that git prints, as rows: logs with numstat, shortstat, stat, blame, show and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_text_logs(spark, path: str) -> DataFrame:
    """Whole files as (repo, log); the repo is the file's name without its ending."""
    found = spark.read.format("text").option("wholetext", "true").load(path)
    name = F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), "/", -1), r"\.[^.]*$", "")
    return found.select(name.alias("repo"), F.col("value").alias("log"))


#: Separator of records in logs that `git log --pretty=format:%x1e%H|%an|%ae|%ad --numstat` writes: such a log of any size is read in parts.
RECORD = "\x1e"


def read_records(spark, path: str) -> DataFrame:
    """(repo, record) of logs whose commits begin with RECORD; the repo is the file's name without its ending."""
    found = spark.read.option("lineSep", RECORD).text(path)
    name = F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), "/", -1), r"\.[^.]*$", "")
    return found.select(name.alias("repo"), F.col("value").alias("record"))


def numstat_records(records: DataFrame, with_email: bool = True) -> tuple[DataFrame, DataFrame]:
    """records(repo, record), each a header line and its numstat rows, to commits and file_changes; nothing is shuffled."""
    fields = 4 if with_email else 3
    lines = F.split(F.regexp_replace("record", r"^\n+", ""), "\n")
    parts = F.split(lines[0], r"\|")
    own = records.select("repo", lines.alias("lines"), parts.alias("p")).filter(lines[0].rlike(r"^[0-9a-f]{40}\|") & (F.size(parts) >= fields))
    commits = own.select(
        "repo", F.get("p", F.lit(0)).alias("hash"), F.get("p", F.lit(1)).alias("author"), (F.get("p", F.lit(2)) if with_email else F.lit(None).cast("string")).alias("author_email"),
        F.try_to_timestamp(F.get("p", F.lit(fields - 1))).alias("ts"),
    )
    stats = numstat(own.select("repo", F.get("p", F.lit(0)).alias("hash"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line")))
    return commits, stats.select("repo", "hash", "path", "insertions", "deletions", "binary")


def numstat_log(logs: DataFrame, with_email: bool = True) -> tuple[DataFrame, DataFrame]:
    """logs(repo, log) of `hash|author|email|date` lines, each followed by numstat rows, to commits and file_changes.

    A text is cut before each header, so that every commit keeps its own rows wherever it stands; nothing is shuffled. A
    log that is too long for a row comes as logs(repo, part, log): parts in order, each of which ends at the end of any line.
    Rows at the head of a part belong to the last commit of the parts before it; these rows alone are shuffled, and a hash of each part.
    """
    head = _head(with_email)
    cut = F.split("log", rf"\n(?={head})")
    commits, changes = numstat_records(logs.select("repo", F.explode(cut).alias("record")), with_email)
    if "part" not in logs.columns:
        return commits, changes
    first, last = F.get(cut, F.lit(0)), F.element_at(cut, -1)
    before = Window.partitionBy("r").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends = logs.select(F.col("repo").alias("r"), F.col("part").alias("at"), F.when(last.rlike(f"^{head}"), F.substring(last, 1, 40)).alias("hash"))
    ends = ends.withColumn("hash", F.last("hash", True).over(before)).filter("hash is not null")
    rest = logs.select("repo", "part", first.alias("rest")).filter(~F.col("rest").rlike(f"^{head}"))
    # null-safe, since a filter against nulls on one side would have the texts computed twice
    more = numstat(rest.join(ends, F.col("repo").eqNullSafe(F.col("r")) & (F.col("part") == F.col("at"))).select("repo", "hash", F.explode(F.split("rest", "\n")).alias("line")))
    return commits, changes.unionByName(more.select("repo", "hash", "path", "insertions", "deletions", "binary"))


def _head(with_email: bool) -> str:
    """What a header line begins with."""
    return r"[0-9a-f]{40}(?:\|[^|\n]*){" + str(3 if with_email else 2) + "}"


def numstat(lines: DataFrame) -> DataFrame:
    """lines(..., line) with path, insertions, deletions, binary; lines of another form are left out. Renames keep git's form."""
    parts = F.split("line", "\t", 3)
    rows = lines.filter(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.")).withColumn("p", parts)
    binary = (F.col("p")[0] == "-") | (F.col("p")[1] == "-")
    return rows.withColumns({
        "path": F.col("p")[2], "binary": binary, "insertions": F.when(binary, 0).otherwise(F.expr("try_cast(p[0] as bigint)")), "deletions": F.when(binary, 0).otherwise(F.expr("try_cast(p[1] as bigint)")),
    }).drop("p")


def parse_log_line(line: Column) -> Column:
    """`hash|author|email|date|message|body...`; null with fewer than five parts. The rest is joined again."""
    p = F.split(line, r"\|")
    return F.when(F.size(p) >= 5, F.struct(
        p[0].alias("hash"), p[1].alias("author"), p[2].alias("email"), p[3].alias("date"), p[4].alias("message"), F.array_join(F.slice(p, F.lit(6), F.greatest(F.size(p) - 5, F.lit(0))), "|").alias("body")))


def shortstat(line: Column) -> Column:
    number = lambda what: F.coalesce(F.when(line.rlike(what), F.regexp_extract(line, what, 1).cast("bigint")), F.lit(0).cast("bigint"))
    return F.struct(number(r"(\d+) files? changed").alias("files"), number(r"(\d+) insertions?\(\+\)").alias("insertions"), number(r"(\d+) deletions?\(-\)").alias("deletions"))


def stat_line(line: Column) -> Column:
    """A row of --stat: path, and its total dealt out by the signs shown; binary rows have none."""
    binary = line.rlike(r"\|\s+Bin ")
    total = F.when(line.rlike(r"\|\s+\d+"), F.regexp_extract(line, r"\|\s+(\d+)", 1).cast("double"))
    plus, minus = F.length(F.regexp_extract(line, r"(\+*)(-*)\s*$", 1)), F.length(F.regexp_extract(line, r"(\+*)(-*)\s*$", 2))
    signs = F.greatest(plus + minus, F.lit(1))
    return F.when(binary | total.isNotNull(), F.struct(
        F.trim(F.regexp_extract(line, r"^\s*(.*?)\s+\|", 1)).alias("path"), F.coalesce(F.floor(total * plus / signs + 0.5), F.lit(0)).alias("insertions"),
        F.coalesce(F.floor(total * minus / signs + 0.5), F.lit(0)).alias("deletions"), binary.alias("binary")))


def stat_rows(output: Column) -> Column:
    """All rows of a --stat output: path, insertions, deletions, binary. A row whose text also says Bin or Binary gives a second, binary entry."""
    form = r"^\s*(.+?)\s*\|\s*(\d+)\s*([+-]*)\s*$"
    zero = F.lit(0).cast("bigint")

    def rows(line: Column) -> Column:
        signs = F.regexp_extract(line, form, 3)
        plus, minus = F.length(F.replace(signs, F.lit("-"), F.lit(""))), F.length(F.replace(signs, F.lit("+"), F.lit("")))
        ratio = F.when(plus + minus > 0, F.regexp_extract(line, form, 2).cast("double") / (plus + minus)).otherwise(0.0)
        entry = lambda path, a, b, binary: F.struct(path.alias("path"), a.alias("insertions"), b.alias("deletions"), F.lit(binary).alias("binary"))
        counted = F.when(line.rlike(form), entry(F.trim(F.regexp_extract(line, form, 1)), F.floor(plus * ratio + 0.5), F.floor(minus * ratio + 0.5), False))
        head = r"^\s*(.+?)\s*\|"
        second = F.when((line.contains("Bin ") | line.contains("Binary")) & line.rlike(head), entry(F.trim(F.regexp_extract(line, head, 1)), zero, zero, True))
        return F.array_compact(F.array(counted, second))

    return F.flatten(F.transform(F.split(F.regexp_replace(output, r"^\s+|\s+$", ""), "\n"), rows))


def blame_line(line: Column) -> Column:
    form = r"^\^?([0-9a-f]+)\s+(?:\S+\s+)?\((.+?)\s+(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} [+-]\d{4})\s+(\d+)\)\s?(.*)$"
    part = lambda k: F.regexp_extract(line, form, k)
    return F.when(line.rlike(form), F.struct(part(1).alias("hash"), part(2).alias("author"), part(3).alias("date"), part(4).cast("int").alias("line"), part(5).alias("content")))


def commit_show(text: Column) -> Column:
    part = lambda form: F.regexp_extract(text, form, 1)
    message = F.regexp_replace(F.regexp_replace(part(r"(?s)\n\n((?:    [^\n]*\n?|\n)+)"), r"(?m)^    ", ""), r"^\s+|\s+$", "")
    return F.when(text.rlike(r"(?m)^commit [0-9a-f]+"), F.struct(
        part(r"(?m)^commit ([0-9a-f]+)").alias("hash"), part(r"(?m)^Author:\s+(.+?)\s+<").alias("author"), part(r"(?m)^Author:.*<(.+?)>").alias("email"), part(r"(?m)^Date:\s+(.+)$").alias("date"), message.alias("message")))


def diff_files(diff: Column) -> Column:
    """Distinct paths that a diff names, in order of their names."""
    heads = F.concat(F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git a/(.+?) b/"), F.lit(1)), F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git a/.+? b/(.+)$"), F.lit(1)), F.regexp_extract_all(diff, F.lit(r"(?m)^(?:\+\+\+|---) [ab]/(.+)$"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(heads, lambda p: F.regexp_replace(p, r"\r$", ""))))


def flexible_date(text: Column, as_of: Column) -> Column:
    """A timestamp in a known form, or so many days, weeks, months or years before as_of; else null."""
    form = r"(?i)^\s*(\d+)\s+(day|week|month|year)s?\s+ago\s*$"
    n = F.when(text.rlike(form), F.regexp_extract(text, form, 1).cast("int"))
    unit = F.lower(F.regexp_extract(text, form, 2))
    day = lambda k: as_of - F.make_interval(days=k)
    back = F.when(unit == "day", day(n)).when(unit == "week", day(n * 7)).when(unit == "month", as_of - F.make_interval(months=n)).when(unit == "year", as_of - F.make_interval(years=n))
    return F.coalesce(safe_date(text), back)


def safe_date(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
