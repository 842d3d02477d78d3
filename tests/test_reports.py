"""Reports of small results."""

from loomline.plans import render, reports


def test_graph_report():
    stats = {"nodes": 12, "edges": 3, "average_degree": 0.25, "max_degree": 2}
    text = reports.graph_report(stats, 12, [f"src/f{k}.ts" for k in range(12)], [], ["src/f1.ts"], 0, "dot", "digraph G {}")
    assert "- **Average Dependencies**: 0.25" in text and "- **Has Cycles**: No" in text and "- ... and 2 more" in text and text.endswith("```dot\ndigraph G {}\n```")


def test_cycle_report():
    cycles = [{"component": "a", "members": ["x/a.ts", "x/b.ts"], "length": 2, "severity": "low"}]
    summary = {"total_cycles": 3, "critical": 0, "high": 0, "medium": 0, "low": 3, "affected_files": 6}
    text = reports.cycle_report(summary, cycles, {"a": {"src": "x/a.ts", "dst": "x/b.ts"}}, ["do it"])
    assert "`a.ts -> b.ts -> a.ts`" in text and "from 'a.ts' to 'b.ts'" in text and "2 more cycles not shown" in text and "  n0 -.-> n1" in text
    assert "**No circular dependencies detected!**" in reports.cycle_report(None, [], {}, [])


def test_module_report():
    groups = [{"group": "src/a", "size": 11, "cohesion": 0.05, "coupling": 0.4}, {"group": "lib", "size": 1, "cohesion": 1.0, "coupling": 0.0}]
    coupled = [{"path": "src/a/x.ts", "ca": 7, "ce": 1, "instability": 0.125}]
    text = reports.module_report(12, 30, 0.13, groups, {"src/a": [f"src/a/{k}.ts" for k in range(11)], "lib": ["lib/y.ts"]}, coupled, [{"from_group": "src/a", "to_group": "lib"}])
    for part in ("- **Overall Cohesion Score**: 13.0%", "`4.ts`...", "  - `lib/y.ts`", "| x.ts | 7 | 1 | 0.12 |", "1 group(s) have low cohesion", "1 group(s) have high external coupling", "  g0[src_a<br/>11 modules]", "  g0 --> g1"):
        assert part in text


def test_complexity_report():
    summary = {"files": 2, "total_complexity": 50, "average_complexity": 25.0, "low": 1, "medium": 0, "high": 0, "very_high": 1}
    spots = [{"path": "a.ts", "line": 3, "function": "f", "reason": "why", "priority": "critical"}, {"path": "a.ts", "line": 1, "function": None, "reason": "big", "priority": "high"}]
    files = [{"path": "d/" * 30 + "a.ts", "cyclomatic": 45, "functions": 2, "loc": 90, "maintainability": 15}]
    text = reports.complexity_report(summary, spots, files)
    for part in ("- **a.ts:3** - `f`", "#### HIGH Priority (1)", "- **URGENT**: 1 file(s)", "- 1 critical hotspot(s)", "| 45 | 2 | 90 | 15/100 |", "| ..."):
        assert part in text


def test_overview_report():
    layers = {"Presentation": ["api/a.ts"], "Business Logic": [f"core/{k}.ts" for k in range(7)], "Utilities": ["lib/u.ts"], "Other": ["z.ts"]}
    text = reports.overview_report("MVC-like Architecture", 10, layers, ["src/index.ts"], [{"package": "@scope/a-long-package", "category": "library", "usage_count": 4}])
    for part in ("- ... and 4 more", "  layer0 --> layer1", "  layer3 -.-> layer2", "  class layer3 utility", "((_scope_a_long_p))", "- `src/index.ts`", "| @scope/a-long-package | library | 4 |"):
        assert part in text


def test_pull_request_reports():
    risk = {"files_changed": 1, "total_changes": 3, "risk_level": "high", "risk_factors": ["1 critical issue(s) found"]}
    issue = {"severity": "critical", "title": "Hardcoded password", "filename": "a.ts", "line": 3, "suggestion": "no"}
    assert "### Critical (1)\n- **Hardcoded password** in `a.ts`:3" in render.diff_report(risk, 2, 1, [issue])
    assert render.diff_report(risk | {"risk_factors": []}, 0, 0, []).endswith("No issues found in the analyzed areas.")
    pr = {"pr_id": 7, "title": "t", "author": "a", "state": "open", "draft": True, "head": "x", "base": "main", "changed_files": 1, "additions": 2, "deletions": 0}
    text = render.pr_report(pr, {"added": 1}, 3, ["APPROVED", "COMMENTED"], ["bug"])
    assert "**State:** open (draft)" in text and "- **Approvals:** 1" in text and text.endswith("## Labels\n- bug")
    assert render.table_report("T", [{"a": 1.5, "b": ["x", "y"]}], ["a", "b"]).endswith("| 1.50 | x, y |") and "Nothing found." in render.table_report("T", [], ["a"])
