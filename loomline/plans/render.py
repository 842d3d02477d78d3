"""Diagrams and reports of small results as text. Inputs are rows that the operators have ranked and cut; nothing here scales with a corpus."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Edge = tuple[str, str, int]


def project_graph(edges: DataFrame, nodes: DataFrame, project: str, most: int = 100) -> tuple[list[str], list[Edge], int]:
    """The first nodes by name, the edges among them, and how many nodes there are, of one project."""
    own = nodes.filter(F.col("project") == project)
    total = own.count()
    first = own.orderBy("node").limit(most)
    names = [r["node"] for r in first.collect()]
    kept = first.select("project", "node")
    inner = edges.join(kept.withColumnRenamed("node", "src"), ["project", "src"], "left_semi").join(kept.withColumnRenamed("node", "dst"), ["project", "dst"], "left_semi")
    return names, [(r["src"], r["dst"], r["weight"]) for r in inner.orderBy("src", "dst").collect()], total


def _short(path: str) -> str:
    return path.rpartition("/")[2]


def mermaid(nodes: Sequence[str], edges: Iterable[Edge], total: int | None = None, cycles: Sequence[Sequence[str]] = (), direction: str = "TB", weights: bool = False) -> str:
    if not nodes:
        return f"graph {direction}\n  empty[No dependencies found]"
    ids = {n: f"n{k}" for k, n in enumerate(nodes)}
    on_cycle = {n for c in cycles for n in c}
    steps = {(a, b) for c in cycles for a, b in zip(c, [*c[1:], c[0]], strict=True)}
    out = [f"graph {direction}"]
    out += [f"  {i}[{re.sub(r'[^a-zA-Z0-9]', '_', _short(n))}]" + ":::cycle" * (n in on_cycle) for n, i in ids.items()]
    for a, b, w in edges:
        if a in ids and b in ids:
            arrow = f"-->|{w}|" if weights and w else "-.->" if (a, b) in steps else "-->"
            out.append(f"  {ids[a]} {arrow} {ids[b]}")
    if on_cycle:
        out.append("  classDef cycle fill:#ff6b6b,stroke:#c92a2a,stroke-width:2px")
    if total is not None and total > len(nodes):
        out.append(f"  note[Showing {len(nodes)} of {total} nodes]")
    return "\n".join(out)


def dot(nodes: Sequence[str], edges: Iterable[Edge], cycles: Sequence[Sequence[str]] = (), direction: str = "TB") -> str:
    if not nodes:
        return 'digraph G {\n  empty [label="No dependencies found"]\n}'
    ids = {n: f"n{k}" for k, n in enumerate(nodes)}
    on_cycle = {n for c in cycles for n in c}
    label = lambda n: _short(n).replace('"', '\\"')
    out = ["digraph G {", f"  rankdir={direction};", "  node [shape=box, style=rounded];"]
    out += [f'  {i} [label="{label(n)}"' + ", color=red, penwidth=2" * (n in on_cycle) + "];" for n, i in ids.items()]
    out += [f"  {ids[a]} -> {ids[b]};" for a, b, _ in edges if a in ids and b in ids]
    return "\n".join([*out, "}"])


def graph_json(nodes: Sequence[str], edges: Iterable[Edge]) -> str:
    return json.dumps({"nodes": [{"id": n, "label": _short(n)} for n in nodes], "edges": [{"source": a, "target": b, "data": {"weight": w}} for a, b, w in edges]}, indent=2)


def diff_report(risk: Mapping, additions: int, deletions: int, issues: Sequence[Mapping]) -> str:
    """risk is a row of pr_risk; issues are rows of pr_issues of the same pull request."""
    out = [
        "# Diff Analysis Report", "", "## Summary", f"- **Files changed:** {risk['files_changed']}", f"- **Lines added:** +{additions}", f"- **Lines deleted:** -{deletions}", f"- **Total changes:** {risk['total_changes']}", "",
        f"## Risk Assessment: {risk['risk_level'].upper()}",
    ]
    if risk["risk_factors"]:
        out += ["", "### Risk Factors:", *(f"- {x}" for x in risk["risk_factors"])]
    if not issues:
        return "\n".join([*out, "", "No issues found in the analyzed areas."])
    out += ["", "## Issues Found", ""]
    for severity in ("critical", "high", "medium", "low", "info"):
        own = [i for i in issues if i["severity"] == severity]
        if own:
            out.append(f"### {severity.capitalize()} ({len(own)})")
            for i in own:
                out += [f"- **{i['title']}** in `{i['filename']}`" + (f":{i['line']}" if i["line"] else ""), f"  *Suggestion:* {i['suggestion']}"]
            out.append("")
    return "\n".join(out)


def suggestion_report(suggestions: Sequence[Mapping], score: int) -> str:
    word = next(w for least, w in ((90, "Excellent code quality."), (75, "Good code quality with minor improvements needed."), (50, "Code quality needs improvement."), (-1, "Significant issues found that should be addressed.")) if score >= least)
    out = [f"## Code Quality Score: {score}/100", "", f"Overall: {word}", "", "### Issues by Severity:"]
    out += [f"- {s.capitalize()}: {n}" for s in ("critical", "high", "medium", "low") if (n := sum(x["severity"] == s for x in suggestions))]
    if not suggestions:
        return "\n".join([*out, "- No issues found!"])
    categories = dict.fromkeys(x["category"] for x in suggestions)
    return "\n".join([*out, "", "### Issues by Category:", *(f"- {c}: {sum(x['category'] == c for x in suggestions)}" for c in categories)])


def pr_report(pr: Mapping, statuses: Mapping[str, int], comments: int, reviews: Sequence[str], labels: Sequence[str] = ()) -> str:
    out = [
        f"# PR #{pr['pr_id']}: {pr['title']}", "", f"**Author:** {pr['author']}", f"**State:** {pr['state']}" + " (draft)" * bool(pr.get("draft")) + " (merged)" * bool(pr.get("merged")), f"**Branch:** {pr['head']} -> {pr['base']}", "",
        "## Changes", f"- **Files changed:** {pr['changed_files']}", f"- **Additions:** +{pr['additions']}", f"- **Deletions:** -{pr['deletions']}", "", "### File breakdown:", *(f"- {s}: {n}" for s, n in statuses.items()), "",
        "## Review Status", f"- **Comments:** {comments}", f"- **Reviews:** {len(reviews)}", f"- **Approvals:** {sum(r == 'APPROVED' for r in reviews)}", f"- **Changes requested:** {sum(r == 'CHANGES_REQUESTED' for r in reviews)}",
    ]
    return "\n".join([*out, *(["", "## Labels", *(f"- {x}" for x in labels)] if labels else [])])


def table_report(title: str, rows: Sequence[Mapping], columns: Sequence[str]) -> str:
    """Any ranked result as a Markdown table under a title."""
    cell = lambda v: ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else f"{v:.2f}" if isinstance(v, float) else str(v)
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*head, *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)] if rows else [f"# {title}", "", "Nothing found."])
