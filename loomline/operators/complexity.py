"""Complexity of functions and files, maintainability, hotspots and buckets."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsmath import half_up
from ..sources.code import strip_js

_WORDS = re.compile(r"\b(if|for|while|catch|case)\b|&&|\|\||\?\?(?!=)|\?(?![.?:])|(?P<default>\bdefault\s*:)")


def js_points(source: str, default_too: bool = False) -> int:
    """Decision points of source without comments and strings. A question mark of an optional member or parameter is none."""
    return sum(1 for m in _WORDS.finditer(source) if not m["default"] or default_too)


_HEAD = re.compile(
    r"\bfunction\b\s*\*?\s*(?P<f>[\w$]+)?\s*(?:<[^>(]*>)?\(|(?P<v>[\w$]+)\s*(?::[^=;(){}]+)?[=:]\s*(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*\s*)?(?:<[^>(]*>)?\((?=[^;]*?\)\s*(?::[^={;]+)?(?:=>|\{))|(?P<m>[\w$]+)\s*(?:<[^>(]*>)?\((?=[^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?::[^{;=]+)?\{)"
)


def _pairs(s: str) -> dict[int, int]:
    """Where each round and curly bracket is closed; those left open end with the text."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {"(": [], "{": []}
    for m in re.finditer(r"[(){}]", s):
        if m[0] in open_:
            open_[m[0]].append(m.start())
        elif stack := open_["(" if m[0] == ")" else "{"]:
            out[stack.pop()] = m.start()
    return out | {k: len(s) - 1 for stack in open_.values() for k in stack}


def js_functions(text: str) -> list[dict]:
    """Named functions with their lines, decision points (those of functions inside count too), parameters and deepest nesting."""
    _, s = strip_js(text)
    out, closes = [], _pairs(s)
    line_of = [0, *(m.end() for m in re.finditer("\n", s))]
    for m in _HEAD.finditer(s):
        name = m["f"] or m["v"] or m["m"]
        if not name or name in {"if", "for", "while", "switch", "catch", "return", "function"}:
            continue
        opened = m.end() - 1
        closed = closes[opened]
        brace = re.compile(r"\s*(?::[^={;]+?)?\s*(?:=>\s*)?\{").match(s, closed + 1)
        if brace:
            end = closes[brace.end() - 1]
            body = s[brace.end() : end]
        else:
            arrow = re.compile(r"\s*(?::[^={;]+?)?\s*=>").match(s, closed + 1)
            if not arrow:
                continue
            end = next((k for k in range(arrow.end(), len(s)) if s[k] in ";\n"), len(s))
            body = s[arrow.end() : end]
        depth = deepest = 0
        for w in re.finditer(r"\b(?:if|for|while|do|switch|try)\b[^{};]*\{|\{|\}", body):
            if w[0] == "}":
                depth = max(0, depth - 1)
            else:
                depth += 1
                deepest = max(deepest, depth) if w[0] != "{" else deepest
        inside = s[opened + 1 : closed]
        flat, more = inside, 1
        while more:  # brackets from the innermost out; what stands in them counts as one
            flat, more = re.subn(r"\([^()]*\)|\{[^{}]*\}|\[[^\[\]]*\]|<[^<>]*>", "_", flat)
        out.append({"name": name, "start_line": bisect_right(line_of, m.start()), "end_line": bisect_right(line_of, end), "complexity": 1 + js_points(body), "parameter_count": len([p for p in flat.split(",") if p.strip()]) if inside.strip() else 0, "max_nesting": deepest})
    return out


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _numbered(files: DataFrame) -> DataFrame:
    """(project, path, pos from 0, line, t: the line trimmed, indent) of every line."""
    rows = files.select("project", "path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("pos", "line"))
    return rows.withColumns({"t": _trimmed(F.col("line")), "indent": F.length("line") - F.length(F.regexp_replace("line", r"^\s+", ""))})


def _fits(form: str) -> Column:
    return F.when(F.col("t").rlike(form), 1).otherwise(0)


def python_functions(files: DataFrame) -> DataFrame:
    """Functions of Python files whose `def` and parameters stand on one line, by windows over the numbered lines.

    A line belongs to the last `def` above it. The function ends before its first line of code that is indented no deeper,
    or else with its lines; what follows an inner function is so not counted for the outer one.
    """
    form = r"^def\s+(\w+)\s*\(([^)]*)\)"
    part = lambda k: F.regexp_extract("t", form, k)
    named = F.filter(F.transform(F.split(part(2), ","), _trimmed), lambda p: (p != "") & ~p.startswith("self"))
    lines = _numbered(files).withColumn("def", F.when(F.col("t").rlike(form), F.struct("pos", "indent", part(1).alias("name"), F.size(named).alias("params"))))
    above = Window.partitionBy("project", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = lines.withColumn("of", F.last("def", ignorenulls=True).over(above)).filter("of is not null")
    beyond = F.col("def").isNull() & (F.col("t") != "") & ~F.col("t").startswith("#") & (F.col("indent") <= F.col("of.indent"))
    within = Window.partitionBy("project", "path", "of.pos")
    ended = owned.withColumn("stop", F.min(F.when(beyond, F.col("pos"))).over(within))
    inside = F.col("def").isNull() & (F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
    points = _fits(r"^(if|elif|while|for)\s") + _fits(r"^except(\s|:)") + F.regexp_count("t", F.lit(r"\s(and|or)\s"))
    per = ended.groupBy("project", "path", "of").agg(F.coalesce(F.min("stop"), F.max("pos") + 1).alias("end_line"), (1 + F.sum(F.when(inside, points).otherwise(0))).alias("complexity"))
    whole = lambda c: F.col(c).cast("int")
    return per.select("project", "path", "of.name", (whole("of.pos") + 1).alias("start_line"), whole("end_line").alias("end_line"), whole("complexity").alias("complexity"), whole("of.params").alias("parameter_count"), F.lit(0).alias("max_nesting"))


FUNCTION = "project string, path string, name string, start_line int, end_line int, complexity int, parameter_count int, max_nesting int"


def functions(files: DataFrame, language: str) -> DataFrame:
    """(project, path, name, lines, complexity, parameters, nesting) of every function. Null content has none."""
    if language == "python":
        return python_functions(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FUNCTION.split(", ")]
        for b in batches:
            yield pd.DataFrame([f | {"project": p, "path": q} for p, q, t in zip(b["project"], b["path"], b["content"], strict=True) for f in js_functions(t or "")], columns=names)

    return files.select("project", "path", "content").mapInPandas(run, FUNCTION)


def python_files(files: DataFrame) -> DataFrame:
    """Per Python file: complexity, functions and classes, from its lines alone."""
    used = (F.col("t") != "") & ~F.col("t").startswith("#")
    points = _fits(r"^(if|elif|while|for)\s") + _fits(r"^except(\s|:)") + F.regexp_count("t", F.lit(r"\s(and|or)\s")) + _fits(r"\sif\s.+\selse\s")
    return _numbered(files).groupBy("project", "path").agg(
        (1 + F.sum(F.when(used, points).otherwise(0))).alias("complexity"), F.sum(F.when(used, _fits(r"^def\s+\w+")).otherwise(0)).alias("functions"), F.sum(F.when(used, _fits(r"^class\s+\w+")).otherwise(0)).alias("classes"), F.count_if(used).alias("loc"),
    )


def js_file_complexity(files: DataFrame) -> DataFrame:
    """Per JavaScript file one count over all its code, default branches included."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"project": b["project"], "path": b["path"], "complexity": [1 + js_points(strip_js(t or "")[1], True) for t in b["content"]]})

    return files.select("project", "path", "content").mapInPandas(run, "project string, path string, complexity int")


def code_lines(files: DataFrame, language: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    t = F.regexp_replace("line", r"^\s+|\s+$", "")
    comment = t.startswith("#") if language == "python" else t.startswith("//") | t.startswith("/*") | t.startswith("*")
    lines = files.select("project", "path", F.explode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("line"))
    return lines.groupBy("project", "path").agg(F.count_if((t != "") & ~comment).alias("loc"))


def maintainability(average: Column, loc: Column) -> Column:
    raw = 171 - F.lit(5.2) * F.log(average + 1) - F.lit(0.23) * average - F.lit(16.2) * F.log(loc + 1)
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("int")


def file_complexity(funcs: DataFrame, loc: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per file: complexity (the functions' sum, at least 1, unless totals(project, path, complexity) are given), functions, lines of code, maintainability."""
    per = funcs.groupBy("project", "path").agg(F.sum("complexity").alias("sum"), F.count(F.lit(1)).alias("functions"), F.max("complexity").alias("max_complexity"))
    full = loc.select("project", "path", "loc").join(per, ["project", "path"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sum", "functions", "max_complexity")})
    average = F.when(F.col("functions") > 0, F.col("sum") / F.col("functions").cast("double")).otherwise(F.lit(1.0))
    full = full.withColumns({"average": average, "cyclomatic": F.greatest(F.col("sum"), F.lit(1))})
    if totals is not None:
        full = full.join(totals.select("project", "path", F.col("complexity").alias("t")), ["project", "path"], "left").withColumn("cyclomatic", F.coalesce("t", "cyclomatic")).drop("t")
    return full.withColumn("maintainability", maintainability(F.col("average"), F.col("loc"))).drop("sum")


def ranked_files(files: DataFrame) -> DataFrame:
    """file_complexity with rank: the most complex file of a project first, ties by path."""
    return files.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.col("cyclomatic").desc(), "path")))


def complexity_summary(files: DataFrame, threshold: int = 10) -> DataFrame:
    """Per project: files, functions, total and mean complexity, and files below 1, 2 and 4 thresholds and above."""
    c = F.col("cyclomatic")
    return files.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"), F.sum("functions").alias("functions"), F.sum(c).alias("total_complexity"), F.avg(c).alias("average_complexity"), F.count_if(c < threshold).alias("low"),
        F.count_if((c >= threshold) & (c < 2 * threshold)).alias("medium"), F.count_if((c >= 2 * threshold) & (c < 4 * threshold)).alias("high"), F.count_if(c >= 4 * threshold).alias("very_high"),
    )


def complexity_hotspots(files: DataFrame, funcs: DataFrame, threshold: int = 10) -> DataFrame:
    """Files of high complexity, functions over the threshold, files hard to maintain; seq orders them by priority. A file may have several."""
    c, f, m = F.col("cyclomatic"), F.col("complexity"), F.col("maintainability")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    whole = files.filter(c >= 2 * threshold).select("project", "path", F.lit(None).cast("string").alias("function"), F.lit(1).alias("line"), c.cast("bigint").alias("complexity"), F.lit(2 * threshold).alias("threshold"),
        text("File has very high total complexity (", c, ")").alias("reason"), F.when(c >= 4 * threshold, "critical").otherwise("high").alias("priority"), F.lit(0).alias("kind"))
    parts = funcs.filter(f >= threshold).select("project", "path", F.col("name").alias("function"), F.col("start_line").alias("line"), f.cast("bigint").alias("complexity"), F.lit(threshold).alias("threshold"),
        text("Function '", F.col("name"), "' has complexity ", f, f" (threshold: {threshold})").alias("reason"),
        F.when(f >= 3 * threshold, "critical").when(f >= 2 * threshold, "high").when(f >= 1.5 * threshold, "medium").otherwise("low").alias("priority"), F.lit(1).alias("kind"))
    hard = files.filter(m < 20).select("project", "path", F.lit(None).cast("string").alias("function"), F.lit(1).alias("line"), c.cast("bigint").alias("complexity"), F.lit(20).alias("threshold"),
        text("Low maintainability index (", m, "/100)").alias("reason"), F.when(m < 10, "critical").otherwise("high").alias("priority"), F.lit(2).alias("kind"))
    rank = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    every = whole.unionByName(parts).unionByName(hard)
    return every.withColumn("seq", F.row_number().over(Window.partitionBy("project").orderBy(rank, "path", "kind", "line", "function"))).drop("kind")
