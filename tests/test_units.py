"""Formulas, parsers and renderers on hand-made cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import jsmath, paths
from loomline.operators import bugs, churn, complexity, contributors, diffs, graph, health, modules, review, rules, search
from loomline.plans import fixtures, render
from loomline.sources import code, gitlog
from loomline.streaming.timeline import streaming_timeline


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rounding_and_days(spark):
    assert [one(spark, jsmath.half_up(F.lit(x))) for x in (2.5, -2.5, 2.4)] == [3.0, -2.0, 2.0]
    assert one(spark, jsmath.two_places(F.lit(0.285))) == 0.28
    assert one(spark, jsmath.week_start(F.lit("2024-01-03").cast("date"))) == dt.date(2023, 12, 31)
    stamp = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, jsmath.full_days(stamp("2024-01-03 00:00:00"), stamp("2024-01-01 12:00:00"))) == 1
    assert one(spark, jsmath.divided(F.lit(1), F.lit(0))) == 0.0


HIT = {
    "security": ['password = "x"', 'api-key = "x"', "secret = 'x'", "eval(x)", "exec(x)", "a.innerHTML = b", "dangerouslySetInnerHTML", "document.write(x)", "SELECT a FROM b WHERE c = + d", "${a} SELECT", "crypto.createCipher('x')", "Math.random()", "http://example.org", "ssl: false"],
    "performance": ["a.forEach(b => c.forEach(d))", "for (a) for (b)", "JSON.parse(JSON.stringify(a))", "new RegExp('a')", "document.querySelector('x') // loop", "a.map(f).filter(g)", "a.filter(g).map(f)", "for (a of b) await c", "console.log(1)", "debugger;"],
    "style": ["// FIXME: x", "  // eslint-disable", "/* eslint-disable */", "// @ts-ignore", "// @ts-nocheck", "x: any;", "function f(" + "a" * 100 + ")", " " * 200 + "x"],
    "bug": ["a == null", "=== undefined || === null", "typeof a === 'undefined'", "new Array(3)", "parseInt(a)", "[...] = null", "catch (e) {}", None, "await x"],
}


def test_rules_fit_their_lines_only(spark):
    lines, wanted = [(0, "const total = one + two")], set()
    for c, texts in HIT.items():
        for k, t in enumerate(texts):
            if t is not None:
                lines.append((len(lines), t))
                wanted.add((len(lines) - 1, c, k))
    found = {(r["i"], r["category"], r["rule_ix"]) for r in rules.issues(spark.createDataFrame(lines, "i int, content string")).collect()}
    assert wanted <= found and not any(i == 0 for i, _, _ in found) and not any(c == "bug" and k == 7 for _, c, k in found)
    quiet = ["http://localhost:1", "a == null | b", "await x.then(y)", "parseInt(a, 10)"]
    assert not rules.issues(spark.createDataFrame([(t,) for t in quiet], "content string"), ["bugs"]).filter("title <> 'x'").collect()
    assert one(spark, rules.fits(F.lit("x: any b"), rules.ISSUE_RULES["style"][5]))
    with pytest.raises(ValueError):
        rules.focus_categories(["taste"])


def test_first_review_rule_of_a_category_counts(spark):
    rows = rules.review_hits(spark.createDataFrame([('password = "a"; eval(b); TODO: c',)], "content string")).collect()
    assert [(r["category"], r["title"]) for r in rows] == [("security", "Hardcoded password detected"), ("maintainability", "TODO/FIXME comment")]


PATCH = "junk before the first hunk is ignored\n@@ -1,3 +1,4 @@ f\n a\n+b\n-c\n d\n@@ -10 +11,2 @@\n-x\n+y\n\\ No newline\n+z"


def test_hunks(spark):
    df = spark.createDataFrame([(1, PATCH), (2, None), (3, ""), (4, "@@ -5 +7 @@")], "k int, patch string")
    lines = diffs.diff_lines(df, ["k"])
    assert [(r["line"], r["content"]) for r in diffs.added_lines(lines).orderBy("pos").collect()] == [(2, "b"), (11, "y"), (13, "z")]
    assert [(r["line"], r["content"]) for r in diffs.deleted_lines(lines).orderBy("pos").collect()] == [(2, "c"), (10, "x")]
    skipped = diffs.diff_lines(df, ["k"], skip_markers=True)
    assert [r["line"] for r in diffs.added_lines(skipped).orderBy("pos").collect()] == [2, 11, 12]
    context = {r["content"]: (r["before"], r["after"]) for r in diffs.line_context(lines, ["k"]).collect()}
    assert context["b"] == (["a"], ["d"])


@pytest.mark.parametrize("metric", list(health.BANDS))
def test_bands(spark, metric):
    b = health.BANDS[metric]
    score = lambda v: one(spark, health.band_score(F.lit(float(v)), b))
    assert [score(v) for v in (b.excellent, b.good, b.fair, b.poor)] == [90, 70, 50, 25]
    assert 0 <= score(b.poor * 1000) <= 100 and one(spark, health.band_status(F.lit(float(b.good)), b)) == "good"


def test_streaks(spark):
    days = [("a", d) for d in ("2024-01-01", "2024-01-02", "2024-01-05", "2024-01-09", "2024-01-10")] + [("b", "2024-01-08"), ("c", "2024-01-09")]
    df = spark.createDataFrame([("r", a, dt.date.fromisoformat(d)) for a, d in days], "repo string, author string, day date")
    rows = {r["author"]: (r["current_streak"], r["longest_streak"]) for r in contributors.streaks(df, F.lit("2024-01-10 12:00:00").cast("timestamp")).collect()}
    assert rows == {"a": (2, 2), "b": (0, 1), "c": (1, 1)}


def edges(spark, *pairs):
    return spark.createDataFrame([("p", a, b, 1) for a, b in pairs], "project string, src string, dst string, weight long")


def test_graph(spark):
    g = edges(spark, ("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "c"), ("s", "s"), ("a", "b"), ("e", "z"))
    found = {r["component"]: (r["members"], r["affected"], r["severity"]) for r in graph.cycles(g).collect()}
    assert found == {"a": (["a", "b"], 0, "low"), "c": (["c", "d", "e"], 1, "medium")}
    assert not graph.is_acyclic(g).first()["is_dag"] and graph.cycles(edges(spark, ("a", "b"))).count() == 0
    dag = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"))
    assert {(r["node"], r["level"]) for r in graph.topological_levels(dag).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r["path"]) for r in graph.all_paths(dag, "a", "c").collect()} == {("a", "c"), ("a", "b", "c")}
    assert graph.all_paths(dag, "a", "a").first()["path"] == ["a"]
    start = spark.createDataFrame([("p", "a")], "project string, node string")
    assert {(r["node"], r["depth"]) for r in graph.transitive_dependencies(dag, start).collect()} == {("b", 1), ("c", 1)}
    stats = graph.graph_stats(dag, spark.createDataFrame([("p", "lone")], "project string, path string")).first()
    assert (stats["nodes"], stats["edges"], stats["entry_points"], stats["leaf_nodes"]) == (4, 3, 2, 2)
    link = graph.weakest_links(graph.cycles(g), g).filter("component = 'a'").first()
    assert (link["src"], link["dst"], link["weight"]) == ("a", "b", 1)
    text = render.mermaid(["src/a.ts", "b"], [("src/a.ts", "b", 2)], 3, [["src/a.ts", "b"]])
    assert text.splitlines() == ["graph TB", "  n0[a_ts]:::cycle", "  n1[b]:::cycle", "  n0 -.-> n1", "  classDef cycle fill:#ff6b6b,stroke:#c92a2a,stroke-width:2px", "  note[Showing 2 of 3 nodes]"]
    assert render.dot([], []).startswith("digraph G {\n  empty") and '"source": "a"' in render.graph_json(["a", "b"], [("a", "b", 1)])


def plain_components(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            for b in out[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    far = {a: reached(a) for a in out}
    return {(a, min(x for x in far[a] if a in far[x])) for a in out if any(a in far[x] for x in far[a] - {a})}


@pytest.mark.parametrize("seed", range(2))
def test_strong_components_of_odd_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range((45, 80)[seed])}
    chain = [f"c{k:02d}" for k in range(20)]
    pairs |= {("n98", "n99"), ("n99", "n98"), ("s", "s"), *zip(chain, chain[1:], strict=False), ("n01", "c00"), ("c19", "n02")}
    pairs |= {(f"r{k}", f"r{(k + 1) % 9}") for k in range(9)} | {("h", "h1"), ("h1", "h2"), ("h2", "h"), ("h", "i1"), ("i1", "i2"), ("i2", "h")}
    assert {(r["node"], r["component"]) for r in graph.strong_components(edges(spark, *pairs)).collect()} == plain_components(pairs)


def test_long_chains_and_rings_take_few_rounds(spark):
    n = 100_000
    step = lambda name, m: spark.range(m).select(F.lit("p").alias("project"), F.format_string(name + "%06d", "id").alias("src"), F.format_string(name + "%06d", (F.col("id") + 1) % n).alias("dst"), F.lit(1).cast("bigint").alias("weight"))
    found = graph.strong_components(step("ring", n).unionByName(step("chain", n - 1)))
    assert found.groupBy("component").count().collect() == [("ring000000", n)]


def test_levels_and_paths_without_limits(spark, monkeypatch):
    monkeypatch.setattr(graph, "FRONTS", 3)
    n = 9
    chain = [(f"a{k:02d}", f"a{k + 1:02d}") for k in range(n)]
    g = edges(spark, *chain, ("a00", f"a{n:02d}"), ("x", f"a{n - 1:02d}"), ("b", "c"), ("c", "b"), ("c", "d"))
    levels = {r["node"]: r["level"] for r in graph.topological_levels(g).collect()}
    assert levels == {**{f"a{k:02d}": k for k in range(n + 1)}, "x": 0}
    assert sorted(len(r["path"]) for r in graph.all_paths(g, "a00", f"a{n:02d}").collect()) == [2, n + 1]
    grid = edges(spark, *[(f"{i}{j}", f"{i + a}{j + 1 - a}") for i in range(4) for j in range(4) for a in (0, 1)])
    assert graph.all_paths(grid, "00", "33").count() == 10 and graph.all_paths(grid, "33", "00").count() == 0


TS = """import fs from 'fs';
import { a, b } from "./util.js"; // import x from 'no'
export * from './other';
const c = require('lodash/get'); const d = await import('@scope/pkg/sub');
export default function main(x: number, y = f(1, 2)) { if (x && y) { for (;;) { while (x) {} } } return x ? 1 : 2; }
export const helper = (a, b) => a ?? b;
export class Thing { run(p) { switch (p) { case 1: break; default: } try {} catch (e) {} } }
export interface Hidden { q?: string }
"""
PY = "import os, numpy.linalg as la\nfrom . import x\nfrom ..pkg.mod import (a,\n  b)\nfrom app.core \\\n  import z\n__all__ = ['run', \"stop\"]\nLIMIT = 3\nclass Open:\n    def method(self, a, b=1):\n        if a and b or c:\n            pass\n    def other(self):\n        for i in x: pass\ndef _hidden(): pass\nasync def later(): pass\n"


def test_source_parsers(spark):
    assert code.parse_js(TS, False) == (["fs", "./util.js", "./other", "lodash/get", "@scope/pkg/sub"], ["default", "helper", "Thing"])
    assert code.parse_js("module.exports = f; exports.g = 1; const {h} = require('m')", True) == (["m"], ["default", "g"])
    assert code.parse_python(PY) == (["os", "numpy", ".", "..pkg.mod", "app"], ["run", "stop", "LIMIT", "Open", "method", "other"])
    names = {f["name"]: (f["complexity"], f["parameter_count"]) for f in complexity.js_functions(TS)}
    assert names["main"] == (6, 2) and names["helper"] == (2, 2) and names["run"] == (3, 1)
    assert code.parse_python("x = 1 # \\\nfrom a.b \\\n  import c\nimport d.e as f, g\nfrom h import (i, # j)\n k)\nfrom .. import z\nprint('import', (\n1)\n)") == (["d", "g", "h", ".."], [])
    assert list(code.logical_lines("# no\n\nimport (a,\n b\n")) == ["import (a, b "]
    df = spark.createDataFrame([("p", "m.py", PY), ("p", "none.py", None)], "project string, path string, content string")
    rows = complexity.functions(df, "python").orderBy("start_line").collect()
    assert [(f["name"], f["complexity"], f["parameter_count"], f["start_line"]) for f in rows] == [("method", 4, 2, 10), ("other", 2, 0, 13), ("_hidden", 1, 0, 15)]
    assert [f["parameter_count"] for f in complexity.js_functions("function f(a, {b, c: [d]}, g = h(1, 2)) {}\nconst k = ({a, b}) => { return (1")] == [3, 1]


def test_many_functions_in_one_file_take_linear_time(spark):
    text = "".join(f"function f{k}(a) {{ if (a) {{ return {k}; }} }}\n" for k in range(20_000))
    found = complexity.js_functions(text)
    assert len(found) == 20_000 and found[-1]["start_line"] == 20_000 and found[-1]["complexity"] == 2


def test_dependencies(spark):
    files = spark.createDataFrame([("p", "src/main.ts", TS), ("p", "src/util.ts", ""), ("p", "src/other/index.ts", None), ("p", "node_modules/x.ts", ""), ("p", "a/b/m.py", PY)], "project string, path string, content string")
    kept = code.included(files, "typescript")
    assert kept.count() == 3
    deps = code.dependencies(code.modules(kept, "typescript"), kept, "typescript")
    rows = {r["specifier"]: (r["type"], r["target"], r["package"]) for r in deps.collect()}
    assert rows["fs"][0] == "builtin" and rows["./util.js"][:2] == ("internal", "src/util.ts") and rows["./other"][1] == "src/other/index.ts"
    assert rows["@scope/pkg/sub"] == ("external", "@scope/pkg/sub", "@scope/pkg") and rows["lodash/get"][2] == "lodash"
    assert code.import_edges(deps).count() == 2
    py = code.included(files, "python").unionByName(spark.createDataFrame([("p", "a/pkg/mod.py", ""), ("p", "src/app.py", "")], files.schema))
    found = {r["specifier"]: (r["type"], r["target"]) for r in code.dependencies(code.modules(py, "python"), py, "python").collect()}
    assert found["os"][0] == "builtin" and found["..pkg.mod"] == ("internal", "a/pkg/mod.py") and found["app"] == ("internal", "src/app.py") and found["numpy"][0] == "external"
    assert modules.external_dependencies(deps).filter("package = 'lodash'").first()["category"] == "utility"
    assert code.detect_language(files).first()["language"] == "javascript"


def test_complexity_of_files(spark):
    files = spark.createDataFrame([("p", "m.py", PY), ("p", "e.py", None)], "project string, path string, content string")
    per = {r["path"]: (r["complexity"], r["functions"], r["classes"]) for r in complexity.python_files(files).collect()}
    assert per == {"m.py": (5, 3, 1), "e.py": (1, 0, 0)}
    funcs = complexity.functions(files, "python")
    rated = complexity.file_complexity(funcs, complexity.code_lines(files, "python"), complexity.python_files(files))
    assert all(0 <= r["maintainability"] <= 100 for r in rated.collect())
    assert complexity.complexity_summary(rated, 3).first()["medium"] == 1
    spots = complexity.complexity_hotspots(rated, funcs, 2).orderBy("seq").collect()
    assert spots[0]["priority"] in ("critical", "high") and {s["function"] for s in spots} >= {"method", "other"}


def test_packages(spark):
    files = spark.createDataFrame([("p", x) for x in ("a/package.json", "a/b/c.ts", "d/e.ts", "f.ts")], "project string, path string")
    assert {r["path"]: r["group"] for r in modules.grouped(files, "package").collect()} == {"a/package.json": "a", "a/b/c.ts": "a", "d/e.ts": "root", "f.ts": "root"}
    assert {r["path"]: r["group"] for r in modules.grouped(files, "directory", 1).collect()}["f.ts"] == "."


def test_git_text(spark):
    log = "\n".join(["1" * 40 + "|Ann|a@x|2024-01-02 03:04:05", "3\t1\tsrc/a.ts", "-\t-\tb.png", "", "2" * 40 + "|Bob|b@x|2024-01-03", "5\t0\ta => b"])
    commits, changes = gitlog.numstat_log(spark.createDataFrame([("r", log)], "repo string, log string"))
    assert [r["author"] for r in commits.orderBy("hash").collect()] == ["Ann", "Bob"]
    assert {(r["path"], r["insertions"], r["binary"]) for r in changes.collect()} == {("src/a.ts", 3, False), ("b.png", 0, True), ("a => b", 5, False)}
    assert tuple(one(spark, gitlog.shortstat(F.lit(" 2 files changed, 7 insertions(+)")))) == (2, 7, 0)
    assert one(spark, gitlog.parse_log_line(F.lit("h|a|e|d|m|x|y")))["body"] == "x|y" and one(spark, gitlog.parse_log_line(F.lit("h|a"))) is None
    assert tuple(one(spark, gitlog.stat_line(F.lit(" src/a.ts | 10 ++++-")))) == ("src/a.ts", 8, 2, False)
    assert one(spark, gitlog.blame_line(F.lit("^abc123 (Ann Lee 2024-01-02 03:04:05 +0000 7) let x")))["line"] == 7
    show = one(spark, gitlog.commit_show(F.lit("commit abc\nAuthor: Ann <a@x>\nDate:   now\n\n    first\n    second\n")))
    assert (show["hash"], show["email"], show["message"]) == ("abc", "a@x", "first\nsecond")
    assert one(spark, gitlog.diff_files(F.lit("diff --git a/x b/y\n--- a/x\n+++ b/y\n"))) == ["x", "y"]
    at = F.lit("2024-03-31 00:00:00").cast("timestamp")
    assert one(spark, gitlog.flexible_date(F.lit("2 weeks ago"), at)) == dt.datetime(2024, 3, 17) and one(spark, gitlog.flexible_date(F.lit("1 month ago"), at)) == dt.datetime(2024, 2, 29)
    assert one(spark, gitlog.flexible_date(F.lit("soon"), at)) is None


def test_small_functions(spark):
    assert [one(spark, paths.format_bytes(F.lit(n))) for n in (0, 512, 1536, 5 << 30)] == ["0 B", "512 B", "1.5 KB", "5 GB"]
    assert [one(spark, paths.language(F.lit(n))) for n in ("a.TSX", "Dockerfile", "x/Makefile", "noext", "a.rs")] == ["typescript", "dockerfile", "unknown", "unknown", "rust"]
    assert one(spark, bugs.suspicion_score(F.lit("urgent hotfix"), F.lit(4), F.lit(120))) == 95
    body = one(spark, review.body_with_metadata(F.lit("text"), F.lit("high"), F.lit("bug"), F.lit(True), F.lit("i1")))
    assert body.startswith(":warning: **HIGH**[bug]\n\ntext") and body.endswith("<!-- issue-id: i1 -->")
    assert one(spark, review.suggestion_body(F.lit("d"), F.lit("c"))) == "d\n\n```suggestion\nc\n```"
    assert one(spark, review.code_block_body(F.lit("d"), F.lit("c"), F.lit("ts"))) == "d\n\n```ts\nc\n```" and one(spark, review.code_block_body(F.lit("d"), F.lit("c"), F.lit(None).cast("string"))) == "d\n\n```\nc\n```"
    assert one(spark, review.body_with_metadata(F.lit("t"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(True), F.lit(None).cast("string"), "the bot")) == "t\n\n---\n*This comment was generated automatically by the bot*"
    assert "- Critical: 1" in render.suggestion_report([{"severity": "critical", "category": "bug"}], 85)


def test_landed_tables_and_results_as_json(spark, tmp_path):
    from loomline.sources import landing

    rows = [(1, k, f"f{k}.ts", "added", 1, 0, "@@") for k in range(5)] + [(2, 0, "g.ts", "changed", 2, 1, None)]
    landing.write_json(spark.createDataFrame(rows, landing.SCHEMAS["pr_files"]), str(tmp_path / "files"))
    assert sorted(map(tuple, landing.read_landed(spark, str(tmp_path / "files"), "pr_files").collect())) == sorted(rows)
    cut = landing.read_landed(spark, str(tmp_path / "files"), "pr_files", rows_per_pr=2)
    assert sorted((r["pr_id"], r["file_ix"]) for r in cut.collect()) == [(1, 0), (1, 1), (2, 0)]


def test_scan_of_a_tree(spark, tmp_path):
    for name, text in (("src/a.ts", "x"), ("src/node_modules/b.ts", ""), ("c.js", "y"), ("src/deep/er/d.tsx", "z"), ("e.py", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = code.scan(spark, str(tmp_path), "p", "typescript")
    assert sorted((r["path"], r["content"], r["size"]) for r in found.collect()) == [("src/a.ts", "x", 1), ("src/deep/er/d.tsx", "z", 1)]
    assert [r["path"] for r in code.scan(spark, str(tmp_path), "p", "typescript", exclude=("deep",), max_depth=1).collect()] == ["src/a.ts"]


def test_logs_by_records(spark, tmp_path):
    head = lambda c, name, day: f"{gitlog.RECORD}{c * 40}|{name}|{name}@x|2024-01-0{day}\n"
    (tmp_path / "repo1.log").write_text(head("1", "Ann", 2) + "\n3\t1\tsrc/a.ts\n-\t-\tb.png\n\n" + head("2", "Bob", 3) + head("3", "Cy", 4) + "\n5\t0\ta => b\n")
    commits, changes = gitlog.numstat_records(gitlog.read_records(spark, str(tmp_path)))
    assert [(r["repo"], r["author"], r["author_email"]) for r in commits.orderBy("hash").collect()] == [("repo1", "Ann", "Ann@x"), ("repo1", "Bob", "Bob@x"), ("repo1", "Cy", "Cy@x")]
    assert {(r["hash"][0], r["path"], r["insertions"], r["binary"]) for r in changes.collect()} == {("1", "src/a.ts", 3, False), ("1", "b.png", 0, True), ("3", "a => b", 5, False)}


def test_limits_of_inputs(spark):
    commits, changes = fixtures.commits(spark, "/root/testdata/sf0.001"), fixtures.file_changes(spark, "/root/testdata/sf0.001")
    for days, least in ((0, 3), (366, 3), (30, 0)):
        with pytest.raises(ValueError):
            churn.file_churn(commits, changes, F.current_timestamp(), days, least)
    with pytest.raises(ValueError):
        graph.top_cycles(graph.cycles(edges(spark, ("a", "b"))), 0)
    for limit in (0, 501):
        with pytest.raises(ValueError):
            search.search_commits(commits, changes, "change", limit=limit)
    every = search.search_commits(commits, changes, "change", limit=500)
    few = search.search_commits(commits, changes, "change", limit=500, max_scan=7)
    assert few.count() == 7 < every.count()


def test_percentile_and_focus(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 1, 2, 3, 9)] + [("b", 4), ("c", None)], "g string, v int")
    assert {tuple(r) for r in jsmath.nearest_rank(df, "g", "v", 40).collect()} == {("a", 1), ("b", 4)}
    assert {tuple(r) for r in jsmath.nearest_rank(df, "g", "v", 41).collect()} == {("a", 2), ("b", 4)}
    assert {tuple(r) for r in jsmath.nearest_rank(df, "g", "v", 100).collect()} == {("a", 9), ("b", 4)}
    lines = spark.createDataFrame([("eval(x); console.log(y)",)], "content string")
    assert {r["category"] for r in rules.issues(lines, ["security"]).collect()} == {"security"}
    assert {r["category"] for r in rules.issues(lines, ["performance"]).collect()} == {"performance"}


def test_diff_of_many_files(spark):
    text = "diff --git a/x b/x\nold mode 1\nnew mode 2\ndiff --git a/b.py b/c.py\nrename from b.py\n--- a/b.py\n+++ b/c.py\n@@ -1 +1 @@\n-a\n+b\n"
    rows = diffs.split_diff(spark.createDataFrame([(1, text), (2, None), (3, "no diff")], "k int, diff string"), ["k"]).orderBy("file_ix").collect()
    assert [(r["filename"], r["language"], r["additions"], r["deletions"], r["patch"]) for r in rows] == [("x", "unknown", 0, 0, ""), ("c.py", "python", 1, 1, "@@ -1 +1 @@\n-a\n+b")]


def test_streaming_timeline_equals_the_batch(spark, tmp_path):
    rows = fixtures.activity(spark, "/root/testdata/sf0.001").select("repo", "author", "ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streaming_timeline(stream).writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    batch = streaming_timeline(rows)
    assert sorted(map(tuple, spark.table("weekly").collect())) == sorted(map(tuple, batch.collect()))
