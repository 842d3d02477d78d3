"""Markdown reports of the architecture operators. Inputs are rows (mappings) of one project, ranked and cut by the operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

Row = Mapping

# Tips that end each report, the layers' kinds and descriptions, and the diagrams' styles.
CYCLE_FIXES = (
    "Extract shared code into a separate module that both can depend on.",
    "Use dependency injection to invert the dependency direction.",
    "Consider using interfaces/protocols to break the direct dependency.",
    "Evaluate if the circular dependency indicates a design issue that needs refactoring.",
)
COMPLEXITY_TIPS = ("- Consider using:", "  - Strategy pattern to reduce conditional complexity", "  - Extract Method refactoring for long functions", "  - Guard clauses to flatten nested conditions")
LAYERS = {
    "Presentation": ("presentation", "Handles HTTP requests and responses"),
    "Business Logic": ("business", "Contains core business logic and rules"),
    "Data Access": ("data", "Manages data persistence and retrieval"),
    "Infrastructure": ("infrastructure", "External service integrations and infrastructure concerns"),
    "Utilities": ("utility", "Shared utilities and helper functions"),
    "Other": ("unknown", "Files not matching standard layer patterns"),
}
CHAIN = ("Presentation", "Business Logic", "Data Access", "Infrastructure")
STYLES = (
    "classDef presentation fill:#a8e6cf,stroke:#2d6a4f", "classDef business fill:#ffd3b6,stroke:#f4a261", "classDef data fill:#dcedc1,stroke:#52796f",
    "classDef infrastructure fill:#ffaaa5,stroke:#e07a5f", "classDef utility fill:#d4a5a5,stroke:#9b5de5",
)


def short(path: str) -> str:
    return path.rpartition("/")[2]


def plain_id(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9]", "_", name)


def _some(items: Sequence[str], most: int, mark: str = "") -> list[str]:
    """Up to `most` bullets, and how many more there are."""
    rest = [f"- ... and {len(items) - most} more"] if len(items) > most else []
    return [f"- {mark}{x}{mark}" for x in items[:most]] + rest


def _block(kind: str, text: str) -> list[str]:
    return [f"```{kind}", text, "```"]


def _table(columns: Sequence[str], rows: Iterable[Sequence]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "|".join("-" * (len(c) + 2) for c in columns) + "|", *("| " + " | ".join(map(str, r)) + " |" for r in rows)]


# The headings, labels and sentences in the reports below, in the order in which they stand.


def graph_report(stats: Row, files: int, entries: Sequence[str], leaves: Sequence[str], top: Sequence[str], cycle_count: int, form: str, drawing: str) -> str:
    """stats is a row of graph_stats; form is mermaid, dot or json."""
    facts = {
        "Files Analyzed": files, "Total Nodes": stats["nodes"], "Total Edges": stats["edges"], "Average Dependencies": f"{stats['average_degree']:.2f}", "Max Dependencies": stats["max_degree"],
        "Has Cycles": f"Yes ({cycle_count} found)" if cycle_count else "No",
    }
    out = ["## Dependency Graph Analysis\n", "### Statistics", *(f"- **{k}**: {v}" for k, v in facts.items())]
    for title, nodes in (("Entry Points", entries), ("Leaf Nodes", leaves)):
        if nodes:
            out += [f"\n### {title} ({len(nodes)})", *_some([short(n) for n in nodes], 10)]
    if top:
        out += ["\n### Most Connected", *(f"- {short(n)}" for n in top[:5])]
    return "\n".join([*out, f"\n### {form.upper()} Graph\n", *_block(form, drawing)])


def cycle_report(summary: Row | None, cycles: Sequence[Row], weakest: Mapping[str, Row], recommendations: Sequence[str]) -> str:
    """summary is a row of cycle_summary, cycles are rows of top_cycles, weakest maps a component to its row of weakest_links."""
    out = ["## Circular Dependency Analysis\n", "### Summary"]
    if summary is None or not summary["total_cycles"]:
        out.append("**No circular dependencies detected!**")
    else:
        out += [f"- **Total Cycles Found**: {summary['total_cycles']}", *(f"  - {s.capitalize()}: {summary[s]}" for s in ("critical", "high", "medium", "low")), f"- **Affected Files**: {summary['affected_files']}"]
    if cycles:
        out.append("\n### Detected Cycles\n")
        for k, c in enumerate(cycles, 1):
            names = [short(n) for n in c["members"]]
            weak = weakest.get(c["component"])
            tips = [f"Consider breaking the dependency from '{short(weak['src'])}' to '{short(weak['dst'])}' as it appears to be the weakest link."] if weak else []
            out += [f"#### Cycle {k} [{c['severity'].upper()}]", f"**Modules involved ({c['length']}):**", "`" + " -> ".join([*names, names[0]]) + "`", "\n**Suggestions:**", *(f"- {t}" for t in [*tips, *CYCLE_FIXES][:3]), ""]
        hidden = summary["total_cycles"] - len(cycles) if summary else 0
        if hidden > 0:
            out.append(f"\n*... and {hidden} more cycles not shown*\n")
        affected = list(dict.fromkeys(n for c in cycles for n in c["members"]))
        out += ["\n### Affected Files", *_some([short(n) for n in affected], 20, "`")]
    out += ["\n### Recommendations", *(f"- {r}" for r in recommendations)]
    if 0 < len(cycles) <= 5:
        drawn, ids = ["graph LR"], {}
        for c in cycles[:3]:
            for n in c["members"]:
                if n not in ids:
                    ids[n] = f"n{len(ids)}"
                    drawn.append(f"  {ids[n]}[{short(n)}]:::cycle")
            drawn += [f"  {ids[a]} -.-> {ids[b]}" for a, b in zip(c["members"], [*c["members"][1:], c["members"][0]], strict=True)]
        out += ["\n### Visualization\n", *_block("mermaid", "\n".join([*drawn, "  classDef cycle fill:#ff6b6b,stroke:#c92a2a"]))]
    return "\n".join(out)


def module_report(n_modules: int, n_links: int, cohesion: float, groups: Sequence[Row], files: Mapping[str, Sequence[str]], coupled: Sequence[Row], links: Sequence[Row]) -> str:
    """groups are rows of group_metrics, files the paths of each group, coupled rows of high_coupling, links rows of group_links."""
    share = lambda x: f"{x * 100:.1f}%"
    out = ["## Module Relationship Analysis\n", "### Summary", f"- **Total Modules**: {n_modules}", f"- **Total Relationships**: {n_links}", f"- **Overall Cohesion Score**: {share(cohesion)}", f"- **Groups**: {len(groups)}", "\n### Module Groups\n"]
    for g in sorted(groups, key=lambda g: -g["size"]):
        own = list(files.get(g["group"], ()))
        named = ["- Files:", *(f"  - `{p}`" for p in own)] if g["size"] <= 10 else ["- Files: " + ", ".join(f"`{short(p)}`" for p in own[:5]) + "..."]
        out += [f"#### {g['group']}", f"- Modules: {g['size']}", f"- Cohesion: {share(g['cohesion'])}", f"- External Coupling: {share(g['coupling'])}", *named, ""]
    busy = [c for c in coupled if c["ca"] > 5 or c["ce"] > 5][:10]
    if busy:
        out += ["### High Coupling Modules\n", *_table(("Module", "Incoming", "Outgoing", "Instability"), ((short(c["path"]), c["ca"], c["ce"], f"{c['instability']:.2f}") for c in busy)), ""]
    out.append("### Recommendations\n")
    loose = [g for g in groups if g["cohesion"] < 0.1 and g["size"] > 2]
    tied = [g for g in groups if g["coupling"] > 0.3]
    if loose:
        out += [f"- {len(loose)} group(s) have low cohesion. Consider reorganizing:", *(f"  - **{g['group']}**: cohesion {share(g['cohesion'])}" for g in loose[:3])]
    if tied:
        out += [f"- {len(tied)} group(s) have high external coupling. Consider:", "  - Extracting shared interfaces", "  - Using dependency injection"]
    if cohesion > 0.7:
        out.append("- Overall architecture shows good cohesion!")
    elif cohesion < 0.3:
        out.append("- Consider refactoring to improve module organization")
    if 1 < len(groups) <= 15:
        ids = {g["group"]: f"g{k}" for k, g in enumerate(groups)}
        drawn = ["graph TB", *(f"  {ids[g['group']]}[{plain_id(g['group'])}<br/>{g['size']} modules]" for g in groups)]
        drawn += [f"  {ids[x['from_group']]} --> {ids[x['to_group']]}" for x in links if x["from_group"] in ids and x["to_group"] in ids]
        out += ["\n### Group Dependencies\n", *_block("mermaid", "\n".join(drawn))]
    return "\n".join(out)


def complexity_report(summary: Row, hotspots: Sequence[Row], files: Sequence[Row]) -> str:
    """summary is a row of complexity_summary, hotspots are rows of complexity_hotspots in order, files rows of file_complexity, most complex first."""
    out = ["## Complexity Analysis\n", "### Summary", f"- **Files Analyzed**: {summary['files']}", f"- **Total Complexity**: {summary['total_complexity']}", f"- **Average Complexity**: {summary['average_complexity']:.2f}", "", "**Distribution:**"]
    out += [f"- {name} complexity: {summary[key]} files" for name, key in (("Low", "low"), ("Medium", "medium"), ("High", "high"), ("Very high", "very_high"))]
    if hotspots:
        out.append("\n### Complexity Hotspots\n")
    by = {p: [h for h in hotspots if h["priority"] == p] for p in ("critical", "high", "medium", "low")}
    for p, own in by.items():
        if own:
            out.append(f"#### {p.upper()} Priority ({len(own)})\n")
            for h in own[:10]:
                out += [f"- **{h['path']}:{h['line']}** - `{h['function']}`" if h["function"] else f"- **{h['path']}**", f"  - {h['reason']}"]
            out += [f"  - ... and {len(own) - 10} more"] * (len(own) > 10) + [""]
    cut = lambda p: p if len(p) <= 40 else "..." + p[-37:]
    out += ["### Most Complex Files\n", *_table(("File", "Complexity", "Functions", "Lines", "Maintainability"), ((cut(f["path"]), f["cyclomatic"], f["functions"], f["loc"], f"{f['maintainability']}/100") for f in files[:15])), "\n### Recommendations\n"]
    if summary["very_high"]:
        out.append(f"- **URGENT**: {summary['very_high']} file(s) have very high complexity and should be refactored immediately.")
    if summary["high"]:
        out.append(f"- {summary['high']} file(s) have high complexity. Consider breaking them into smaller modules.")
    if by["critical"]:
        out.append(f"- {len(by['critical'])} critical hotspot(s) need immediate attention.")
    return "\n".join([*out, *COMPLEXITY_TIPS])


def architecture_diagram(layers: Mapping[str, int], packages: Sequence[str]) -> str:
    """layers maps each layer found, in order, to its modules; packages are external ones, most used first."""
    ids = {name: f"layer{k}" for k, name in enumerate(layers)}
    out = ["graph TB"]
    for name, i in ids.items():
        kind = LAYERS[name][0]
        out += [f"  {i}[{plain_id(name)}<br/>{layers[name]} modules]", f"  class {i} {'utility' if kind == 'unknown' else kind}"]
    if packages:
        out += ["  subgraph External", *(f"    ext{len(ids) + k}(({plain_id(p)[:15]}))" for k, p in enumerate(packages[:5])), "  end"]
    out += [f"  {ids[a]} --> {ids[b]}" for a, b in zip(CHAIN, CHAIN[1:], strict=False) if a in ids and b in ids]
    if "Utilities" in ids:
        out += [f"  {i} -.-> {ids['Utilities']}" for name, i in ids.items() if name != "Utilities"]
    return "\n".join([*out, *(f"  {s}" for s in STYLES)])


def overview_report(style: str, total_files: int, layers: Mapping[str, Sequence[str]], entries: Sequence[str], packages: Sequence[Row]) -> str:
    """layers maps each layer found to its paths; packages are rows of external_dependencies, most used first."""
    out = ["## Architecture Overview\n", "### Summary", f"- **Architecture Style**: {style}", f"- **Total Files**: {total_files}", f"- **Layers**: {len(layers)}", f"- **External Dependencies**: {len(packages)}"]
    if entries:
        out += ["\n### Entry Points", *(f"- `{e}`" for e in entries)]
    out.append("\n### Architecture Layers\n")
    for name, own in layers.items():
        kind, text = LAYERS[name]
        shown = own if len(own) <= 5 else own[:3]
        out += [f"#### {name}", f"*{text}*\n", f"- Type: {kind}", f"- Modules: {len(own)}", *(f"  - `{p}`" for p in shown), *([f"  - ... and {len(own) - 3} more"] if len(own) > 5 else []), ""]
    if packages:
        out += ["### External Dependencies\n", *_table(("Package", "Category", "Usage Count"), ((p["package"], p["category"], p["usage_count"]) for p in packages[:15]))]
        out += [f"\n*... and {len(packages) - 15} more dependencies*"] * (len(packages) > 15)
    drawing = architecture_diagram({k: len(v) for k, v in layers.items()}, [p["package"] for p in packages])
    return "\n".join([*out, "\n### Architecture Diagram\n", *_block("mermaid", drawing)])
