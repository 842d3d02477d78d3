"""Source trees for the queries: every document number is a file of three snippets, and what is in each snippet is known.

The DataFrame has the text; the SQL has what a reader of the snippets finds in them, so that the two meet only in the result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import read


class Snippet(NamedTuple):
    code: str
    imports: tuple[str, ...]
    exports: tuple[str, ...]
    #: (name, first line, last line, complexity, parameters, nesting)
    functions: tuple[tuple[str, int, int, int, int, int], ...]
    #: Decision points of the whole snippet as the file-wide counts have them, and lines of code.
    points: int
    loc: int
    classes: int = 0
    #: Top-level and inner `def` lines.
    defs: int = 0


TYPESCRIPT = (
    Snippet(
        "import fs from 'fs';\nimport { get } from \"lodash/get\"; // import x from 'no'\nexport function plain(a: number, b = 2) {\n  if (a && b) {\n    return a > b ? 1 : 2;\n  }\n  return 0;\n}",
        ("fs", "lodash/get"), ("plain",), (("plain", 3, 8, 4, 2, 1),), 3, 8,
    ),
    Snippet(
        "export const pick = (list) => list.map(x => x || 1);\nconst hidden = async function (p, q, r) {\n  for (const i of p) {\n    while (q) {\n      q--;\n    }\n  }\n};",
        (), ("pick",), (("pick", 1, 1, 2, 1, 0), ("hidden", 2, 8, 3, 3, 2)), 3, 8,
    ),
    Snippet(
        "export default class Thing {\n  run(p) {\n    switch (p) {\n      case 1:\n        break;\n      default:\n    }\n    try {\n      go(p);\n    } catch (e) {\n      stop();\n    }\n  }\n}\nexport { plain as other } from './sibling';",
        ("./sibling",), ("default", "other"), (("run", 2, 13, 3, 1, 1),), 3, 15,
    ),
    Snippet(
        "/* a comment\n * import y from 'z'\n */\nimport { T } from '@scope/pkg/sub';\nimport('./lazy');\n\nconst text = \"if (a && b) { function no() {} }\";\nexport async function later() { return await Promise.all([]) ?? null; }",
        ("@scope/pkg/sub", "./lazy"), ("later",), (("later", 8, 8, 2, 0, 0),), 1, 4,
    ),
    Snippet(
        "const x = require('../m1/f1');\nconst { readFile } = require(\"fs/promises\");\n// only a comment\n\nfunction nest(a, { b, c }, [d, e]) {\n  do {\n    if (a) { try { b(); } catch { c(); } }\n  } while (d);\n  return a ? b : c;\n}",
        ("../m1/f1", "fs/promises"), (), (("nest", 5, 10, 5, 3, 3),), 4, 8,
    ),
    Snippet("import react from 'react';\nimport '@types/dev';\nexport * from '../m2/f2.js';", ("react", "@types/dev", "../m2/f2.js"), (), (), 0, 3),
)
JAVASCRIPT = (*TYPESCRIPT[:5], Snippet("const u = require('node:util');\nmodule.exports = plain;\nexports.more = u;", ("node:util",), ("default", "more"), (), 0, 3))
PYTHON = (
    Snippet("import os, numpy.linalg as la\ndef run(self, a, b=1):\n    if a and b or c:\n        pass\n    elif a:\n        return 1 if b else 2", ("os", "numpy"), ("run",), (("run", 2, 6, 5, 2, 0),), 5, 6, 0, 1),
    Snippet(
        "from . import x\nfrom ..pkg.mod import (a,\n    b)\nclass Open:\n    def method(self):\n        for i in x:\n            pass\n\n    # note\n    @property\n    def _other(self, *args, **kw):\n        try:\n            pass\n        except ValueError:\n            pass\nLIMIT = 3",
        (".", "..pkg.mod"), ("Open", "method", "LIMIT"), (("method", 5, 9, 2, 0, 0), ("_other", 11, 15, 2, 2, 0)), 2, 14, 1, 2,
    ),
    Snippet(
        "__all__ = ['run', \"stop\"]\nfrom app.core \\\n    import z\nasync def later(): pass\ndef outer(a):\n    def inner(b):\n        while b and a:\n            b -= 1\n    return inner",
        ("app",), ("run", "stop", "outer", "inner"), (("outer", 5, 5, 1, 1, 0), ("inner", 6, 8, 3, 1, 0)), 2, 9, 0, 2,
    ),
    Snippet("x = 1\n# import nothing\nfrom src.util import helper\nimport json as j, dayjs", ("src", "json", "dayjs"), (), (), 0, 3),
    Snippet("from ..m1.f1 import (\n    thing,\n    other\n)\nimport django.db, os.path", ("..m1.f1", "django", "os"), (), (), 0, 5),
)
SNIPPETS = {"typescript": TYPESCRIPT, "javascript": JAVASCRIPT, "python": PYTHON}
ENDINGS = {"typescript": "ts", "javascript": "js", "python": "py"}
#: What a specifier is: its type, its package, its target (a pattern of the file's folder number), and the one project and file in which the target exists.
SPECIFIERS = {
    "typescript": {
        "fs": ("builtin", "fs", "fs", None), "lodash/get": ("external", "lodash", "lodash/get", None), "./sibling": ("internal", None, "src/m{}/sibling", None), "@scope/pkg/sub": ("external", "@scope/pkg", "@scope/pkg/sub", None),
        "./lazy": ("internal", None, "src/m{}/lazy", None), "../m1/f1": ("internal", None, "src/m1/f1", ("p1", "src/m1/f1.ts")), "fs/promises": ("builtin", "fs/promises", "fs/promises", None), "react": ("external", "react", "react", None),
        "@types/dev": ("external", "@types/dev", "@types/dev", None), "../m2/f2.js": ("internal", None, "src/m2/f2.js", ("p2", "src/m2/f2.ts")),
    },
    "python": {
        "os": ("builtin", "os", "os", None), "numpy": ("external", "numpy", "numpy", None), ".": ("internal", None, "src/m{}", None), "..pkg.mod": ("internal", None, "src/pkg/mod", None), "app": ("external", "app", "app", None),
        "src": ("external", "src", "src", None), "json": ("builtin", "json", "json", None), "dayjs": ("external", "dayjs", "dayjs", None), "..m1.f1": ("internal", None, "src/m1/f1", ("p1", "src/m1/f1.py")), "django": ("external", "django", "django", None),
    },
}


def source_files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(project, path, content) of a file for each document."""
    k, codes = F.col("doc_id"), F.array(*[F.lit(s.code) for s in SNIPPETS[language]])
    n = len(SNIPPETS[language])
    parts = [F.get(codes, ((k * m + a) % n).cast("int")) for m, a in ((1, 0), (5, 1), (7, 3))]
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("p"), (k % 5).cast("string")).alias("project"), F.concat(F.lit("src/m"), (k % 40).cast("string"), F.lit("/f"), k.cast("string"), F.lit("." + ENDINGS[language])).alias("path"), F.array_join(F.array(*parts), "\n").alias("content"))


def _text(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]::varchar[]"


def sql(language: str, query: str) -> str:
    """The query over own(project, path, k, part, off, and the fields of the snippet), off being the lines before the part."""
    fields = "{{'name': {0}, 's': {1}, 'e': {2}, 'c': {3}, 'p': {4}, 'm': {5}}}"
    rows = [
        f"({ix}, {_text(s.code)}, {s.code.count(chr(10)) + 1}, {_list(s.imports)}, {_list(s.exports)}, [{', '.join(fields.format(_text(f[0]), *f[1:]) for f in s.functions)}]::struct(name varchar, s int, e int, c int, p int, m int)[], {s.points}, {s.loc}, {s.classes}, {s.defs})"
        for ix, s in enumerate(SNIPPETS[language])
    ]
    n = len(rows)
    return (
        f"with snips as (select * from (values {', '.join(rows)}) t(ix, code, n_lines, imports, exports, functions, points, loc, classes, defs)), "
        f"parts as (select 'p' || (doc_id % 5)::varchar as project, 'src/m' || (doc_id % 40)::varchar || '/f' || doc_id::varchar || '.{ENDINGS[language]}' as path, doc_id as k, part, case part when 0 then doc_id % {n} when 1 then (doc_id * 5 + 1) % {n} else (doc_id * 7 + 3) % {n} end as ix from documents, range(3) r(part)), "
        "own as (select *, coalesce(sum(n_lines) over (partition by project, path order by part rows between unbounded preceding and 1 preceding), 0) as off from parts join snips using (ix)), "
        "functions as (select project, path, f.name, (off + f.s)::int as start_line, (off + f.e)::int as end_line, f.c as complexity, f.p as parameter_count, f.m as max_nesting from (select project, path, off, unnest(functions) as f from own))"
        + (", " + query.removeprefix("with ") if query.startswith("with ") else " " + query)
    )


def specifiers_sql(language: str) -> str:
    """specifiers(spec, type, package, target, in_project, hit) as a relation."""
    rows = [f"({_text(s)}, {_text(t)}, {_text(p)}, {_text(to)}, {_text(hit[0] if hit else None)}, {_text(hit[1] if hit else None)})" for s, (t, p, to, hit) in SPECIFIERS[language].items()]
    return f"specifiers as (select * from (values {', '.join(rows)}) t(spec, type, package, target, in_project, hit))"


#: (project, path, specifier) once a file, and dependencies as the operators have them, after specifiers_sql.
USES = "uses as (select distinct project, path, k, unnest(imports) as spec from own)"
DEPENDENCIES = (
    "deps as (select project, path as src, spec as specifier, type, case when in_project = project then hit else replace(target, '{}', (k % 40)::varchar) end as target, package from uses join specifiers using (spec))"
)
