"""Review rules: the patterns, and their evaluation over lines.

All patterns are constants tested in one pass over a line, so a scan of the lines is the whole cost.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    pattern: str
    title: str
    severity: str
    #: Advice of the review rules; the issue rules have it in ADVICE.
    description: str = ""
    fix: str = ""


# Patterns (case-insensitive), titles and severities of the issue rules, in the order in which they count.
ISSUE_RULES: dict[str, list[Rule]] = {
    "security": [
        Rule(r"""password\s*=\s*["'][^"']+["']""", "Hardcoded password", "critical"),
        Rule(r"""api[_-]?key\s*=\s*["'][^"']+["']""", "Hardcoded API key", "critical"),
        Rule(r"""secret\s*=\s*["'][^"']+["']""", "Hardcoded secret", "critical"),
        Rule(r"eval\s*\(", "Use of eval()", "high"),
        Rule(r"exec\s*\(", "Use of exec()", "high"),
        Rule(r"innerHTML\s*=", "Direct innerHTML assignment", "medium"),
        Rule(r"dangerouslySetInnerHTML", "dangerouslySetInnerHTML usage", "medium"),
        Rule(r"document\.write\s*\(", "document.write usage", "medium"),
        Rule(r"SELECT\s+.*\s+FROM\s+.*\s+WHERE\s+.*\+", "Potential SQL injection", "critical"),
        Rule(r"\$\{.*\}.*SELECT|SELECT.*\$\{", "SQL query with template literal", "high"),
        Rule(r"crypto\.createCipher\s*\(", "Deprecated crypto.createCipher", "medium"),
        Rule(r"Math\.random\s*\(", "Math.random for security purposes", "low"),
        Rule(r"http:\/\/(?!localhost|127\.0\.0\.1)", "Non-HTTPS URL", "medium"),
        Rule(r"disable.*ssl|ssl.*false|verify.*false", "SSL verification disabled", "high"),
    ],
    "performance": [
        Rule(r"\.forEach\s*\(.*\.forEach", "Nested forEach loops", "medium"),
        Rule(r"for\s*\(.*for\s*\(", "Nested for loops", "low"),
        Rule(r"JSON\.parse\s*\(\s*JSON\.stringify", "Deep clone using JSON", "low"),
        Rule(r"new RegExp\s*\(", "RegExp in loop", "low"),
        Rule(r"document\.querySelector.*loop|loop.*document\.querySelector", "DOM query in loop", "medium"),
        Rule(r"\.\s*map\s*\([^)]*\)\s*\.\s*filter", "map().filter() could be optimized", "low"),
        Rule(r"\.\s*filter\s*\([^)]*\)\s*\.\s*map", "filter().map() in sequence", "info"),
        Rule(r"async\s+function.*await.*for\s*\(|for\s*\(.*await", "Sequential awaits in loop", "medium"),
        Rule(r"console\.(log|debug|info|warn|error)", "Console statement", "info"),
        Rule(r"debugger;", "Debugger statement", "medium"),
    ],
    "style": [
        Rule(r"TODO:|FIXME:|HACK:|XXX:", "TODO/FIXME comment", "info"),
        Rule(r"^\s*\/\/\s*eslint-disable", "ESLint disable comment", "low"),
        Rule(r"^\s*\/\*\s*eslint-disable", "ESLint disable block", "low"),
        Rule(r"@ts-ignore", "TypeScript @ts-ignore", "low"),
        Rule(r"@ts-nocheck", "TypeScript @ts-nocheck", "medium"),
        Rule(r"any(?:\s|[;,)\]}])", "TypeScript any type", "low"),
        Rule(r"function\s+\w+\s*\([^)]{100,}\)", "Function with many parameters", "low"),
        Rule(r"^\s{200,}", "Deep nesting", "low"),
    ],
    "bug": [
        Rule(r"==\s*null(?!\s*\|)|null\s*==", "Loose null comparison", "low"),
        Rule(r"===\s*undefined\s*\|\|\s*===\s*null|===\s*null\s*\|\|\s*===\s*undefined", "Nullable check pattern", "info"),
        Rule(r"""typeof\s+\w+\s*===?\s*["']undefined["']""", "typeof undefined check", "info"),
        Rule(r"new\s+Array\s*\(\s*\d+\s*\)", "Array constructor with single number", "low"),
        Rule(r"parseInt\s*\([^,)]+\)", "parseInt without radix", "low"),
        Rule(r"\[\s*\.\.\.\s*\]\s*=\s*undefined|\[\s*\.\.\.\s*\]\s*=\s*null", "Destructuring null/undefined", "medium"),
        Rule(r"catch\s*\(\s*\w+\s*\)\s*\{\s*\}", "Empty catch block", "medium"),
        Rule(r"return\s*;?\s*\n\s*[^}]", "Unreachable code after return", "medium"),
        Rule(r"\bawait\b(?!.*\b(async|Promise|then)\b)", "await without async context", "medium"),
    ],
}

# Advice by category and title; every other issue gets DEFAULT_ADVICE.
ADVICE: dict[str, dict[str, str]] = {
    "security": {
        "Hardcoded password": "Use environment variables or a secrets manager for credentials.",
        "Hardcoded API key": "Store API keys in environment variables or a secure vault.",
        "Hardcoded secret": "Move secrets to environment variables or a secrets manager.",
        "Use of eval()": "Avoid eval(). Use safer alternatives like JSON.parse() or Function constructor with caution.",
        "Use of exec()": "Sanitize input thoroughly or use safer alternatives.",
        "Direct innerHTML assignment": "Use textContent for text or sanitize HTML before assignment.",
        "dangerouslySetInnerHTML usage": "Ensure content is sanitized. Consider using a sanitization library.",
        "Potential SQL injection": "Use parameterized queries or prepared statements.",
        "SQL query with template literal": "Use parameterized queries instead of string interpolation.",
        "Non-HTTPS URL": "Use HTTPS for all external resources.",
    },
    "performance": {
        "Nested forEach loops": "Consider using a Map or Set for O(1) lookup instead of nested iteration.",
        "Nested for loops": "Consider restructuring to reduce algorithmic complexity.",
        "Deep clone using JSON": "Use structuredClone() or a library like lodash.cloneDeep for better performance.",
        "Console statement": "Remove console statements before production or use a proper logging library.",
        "Debugger statement": "Remove debugger statements before merging.",
        "Sequential awaits in loop": "Consider Promise.all() for parallel execution if order does not matter.",
    },
    "style": {
        "TODO/FIXME comment": "Create a tracking issue for this TODO item.",
        "ESLint disable comment": "Address the underlying issue rather than disabling the rule.",
        "TypeScript @ts-ignore": "Fix the type error rather than ignoring it.",
        "TypeScript @ts-nocheck": "Enable type checking and fix type errors.",
        "TypeScript any type": "Use a more specific type instead of any.",
    },
    "bug": {
        "Loose null comparison": "Use strict equality (===) for null checks.",
        "parseInt without radix": "Always provide a radix to parseInt (e.g., parseInt(str, 10)).",
        "Empty catch block": "Handle or log the error rather than silently catching it.",
        "Unreachable code after return": "Remove or fix unreachable code.",
    },
}
DEFAULT_ADVICE = "Review this code for potential issues."

# The review rules, of which the first that fits a line counts in its category.
REVIEW_RULES: dict[str, list[Rule]] = {
    "security": [
        Rule(r"""password\s*=\s*["'][^"']+["']""", "Hardcoded password detected", "critical", "Credentials should not be hardcoded. Use environment variables or a secrets manager.", "Replace with process.env.PASSWORD or similar secure method."),
        Rule(r"""api[_-]?key\s*=\s*["'][^"']+["']""", "Hardcoded API key detected", "critical", "API keys should be stored securely, not in source code.", "Use environment variables or a secrets manager."),
        Rule(r"eval\s*\(", "Use of eval() detected", "high", "eval() can execute arbitrary code and poses a security risk.", "Replace eval() with safer alternatives like JSON.parse() for data parsing."),
        Rule(r"innerHTML\s*=", "Direct innerHTML assignment", "medium", "Direct innerHTML can lead to XSS vulnerabilities if user input is included.", "Use textContent for text or sanitize HTML before assignment."),
    ],
    "performance": [
        Rule(r"\.forEach\s*\(.*\.forEach", "Nested forEach detected", "medium", "Nested iterations can lead to O(n^2) complexity.", "Consider using a Map or Set for O(1) lookups."),
        Rule(r"JSON\.parse\s*\(\s*JSON\.stringify", "JSON deep clone pattern", "low", "Using JSON.parse(JSON.stringify()) for cloning is slow and has limitations.", "Use structuredClone() or a library like lodash.cloneDeep()."),
        Rule(r"await.*for\s*\(|for\s*\(.*await", "Sequential awaits in loop", "medium", "Sequential awaits in loops can be slow. Consider parallel execution.", "Use Promise.all() if operations are independent."),
    ],
    "maintainability": [
        Rule(r"TODO:|FIXME:|HACK:|XXX:", "TODO/FIXME comment", "low", "This code has a TODO marker that should be tracked.", "Create a tracking issue for this TODO item."),
        Rule(r"@ts-ignore|@ts-nocheck", "TypeScript check disabled", "medium", "Type checking is disabled for this line/file.", "Fix the underlying type error instead of disabling the check."),
        Rule(r"eslint-disable", "ESLint rule disabled", "low", "Linting rules are disabled. This may hide issues.", "Address the underlying lint error rather than disabling the rule."),
    ],
    "bug": [
        Rule(r"catch\s*\(\s*\w+\s*\)\s*\{\s*\}", "Empty catch block", "medium", "Empty catch blocks silently swallow errors.", "Log the error or handle it appropriately."),
        Rule(r"parseInt\s*\([^,)]+\)(?!\s*,)", "parseInt without radix", "low", "parseInt without a radix can produce unexpected results.", "Always specify the radix: parseInt(str, 10)"),
        Rule(r"==\s*null|null\s*==", "Loose null comparison", "low", "Using == instead of === for null comparison.", "Use strict equality (===) for null checks."),
    ],
}

#: White space in the sense of the rules, which is wider than Java's.
_SPACE = r"[\s   -     　﻿]"


def java_pattern(pattern: str) -> str:
    """The pattern with white space as the rules mean it."""
    inside, out, at = False, [], 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(_SPACE[1:-1] if inside else _SPACE)
            at += 2
            continue
        if pattern[at] == "\\":
            out.append(two)
            at += 2
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    return "(?i)" + "".join(out)


def fits(content: Column, rule: Rule) -> Column:
    return content.rlike(java_pattern(rule.pattern))


def focus_categories(focus: list[str] | None) -> list[str]:
    """The categories of the focus areas (all, security, performance, style, bugs)."""
    names = {"security": "security", "performance": "performance", "style": "style", "bugs": "bug"}
    wanted = ["all"] if not focus else focus
    unknown = set(wanted) - {*names, "all"}
    if unknown:
        raise ValueError(f"unknown focus areas: {sorted(unknown)}")
    return [c for a, c in names.items() if "all" in wanted or a in wanted]


def issues(lines: DataFrame, focus: list[str] | None = None) -> DataFrame:
    """lines(..., content) to one row for every rule that fits: category, category_ix, rule_ix, title, severity, suggestion."""
    hits = []
    for c in focus_categories(focus):
        for k, rule in enumerate(ISSUE_RULES[c]):
            row = F.struct(
                F.lit(c).alias("category"), F.lit(list(ISSUE_RULES).index(c)).alias("category_ix"), F.lit(k).alias("rule_ix"), F.lit(rule.title).alias("title"), F.lit(rule.severity).alias("severity"),
                F.lit(ADVICE[c].get(rule.title, DEFAULT_ADVICE)).alias("suggestion"),
            )
            hits.append(F.when(fits(F.col("content"), rule), row))
    return lines.select("*", F.explode(F.array_compact(F.array(*hits))).alias("_hit")).select(*lines.columns, "_hit.*")


def review_hits(lines: DataFrame) -> DataFrame:
    """lines(..., content) to one row for each category with a fitting review rule: the first of the category."""
    hits = []
    for c, rules in REVIEW_RULES.items():
        chosen = None
        for rule in rules:
            row = F.struct(F.lit(c).alias("category"), F.lit(rule.severity).alias("severity"), F.lit(rule.title).alias("title"), F.lit(rule.description).alias("description"), F.lit(rule.fix).alias("suggested_fix"))
            chosen = F.when(fits(F.col("content"), rule), row) if chosen is None else chosen.when(fits(F.col("content"), rule), row)
        hits.append(chosen)
    return lines.select("*", F.explode(F.array_compact(F.array(*hits))).alias("_hit")).select(*lines.columns, "_hit.*")
