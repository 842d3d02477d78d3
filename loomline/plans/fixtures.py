"""The driver's tables as repositories, pull requests and graphs: DataFrames and the same relations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import LANGUAGES

AS_OF = "2001-08-01 00:00:00"
FOLDERS = ("src/api", "src/services", "src/models", "src/utils", "lib", "docs", "tests", "config")
EXTENSIONS = (".ts", ".js", ".py", ".md", ".json")
SNIPPETS = (
    'const password = "hunter2"', 'apiKey = "abc"', "let secret='x'", "eval (input)", "exec(cmd)", "el.innerHTML = html", "<p dangerouslySetInnerHTML={x}/>", "document.write (x)", 'q = "SELECT a FROM t WHERE b=" + id',
    "`SELECT ${x}`", "crypto.createCipher('des')", "Math.random()", 'get("http://example.org")', 'get("http://localhost:1")', "verify = false", "a.forEach(x => b.forEach(y => y))", "for (a) { for (b) {} }",
    "JSON.parse( JSON.stringify(o))", "new RegExp (s)", "loop(() => document.querySelector(q))", "xs.map(f).filter(g)", "xs.filter(g).map(f)", "for (x of xs) await f(x)", "console.log(x)", "debugger;", "// TODO: later",
    "// eslint-disable-next-line", "/* eslint-disable */", "// @ts-ignore", "// @ts-nocheck", "let v: any;", "if (v == null) return", "if (v == null || w) return", "x === null || === undefined", "typeof v === 'undefined'",
    "new Array(3)", "parseInt(s)", "parseInt(s, 10)", "catch (e) { }", "await thing", "await thing.then(f)", "const total = 1 + 2", "return total", "function plain(a, b) {",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    author = F.concat(F.lit("a"), F.col("o_custkey").cast("string"))
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), (key % 3).cast("string")).alias("repo"), key.cast("string").alias("hash"), author.alias("author"), F.concat(author, F.lit("@mail.example")).alias("author_email"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat(F.col("o_orderpriority"), F.lit(" change")).alias("message"), F.lit(None).cast("string").alias("body"), (F.col("o_orderstatus") == "P").alias("is_merge"),
    )


def _path(key):
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), (key % 8 + 1).cast("int")), F.lit("/m"), (key % 40).cast("string"), F.lit("/f"), key.cast("string"), F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (key % 5 + 1).cast("int")))


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("r"), (F.col("l_orderkey") % 3).cast("string")).alias("repo"), F.col("l_orderkey").cast("string").alias("hash"), _path(F.col("l_partkey")).alias("path"),
        F.col("l_quantity").cast("bigint").alias("insertions"), F.col("l_linenumber").cast("bigint").alias("deletions"), (F.col("l_returnflag") == "R").alias("binary"),
    )


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp").alias("ts")).select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 3).cast("string")).alias("repo"), F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("name"), "ts")


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string")).alias("repo"), _path(F.col("p_partkey")).alias("path"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as commits without files."""
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("repo"), F.col("event_id").cast("string").alias("hash"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), F.lit(None).cast("string").alias("author_email"),
        F.col("ts").cast("timestamp").alias("ts"), F.lit("").alias("message"), F.lit(None).cast("string").alias("body"), F.lit(False).alias("is_merge"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as commits: the first line is the message, the rest the body."""
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select(
        F.col("lang").alias("repo"), F.col("doc_id").cast("string").alias("hash"), F.col("source").alias("author"), F.concat("source", F.lit("@mail.example")).alias("author_email"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(days=(F.col("doc_id") % 300).cast("int"))).alias("ts"), F.substring_index(text, "\n", 1).alias("message"),
        F.when(F.instr(text, "\n") > 0, F.expr("substring(coalesce(text, ''), instr(coalesce(text, ''), '\n') + 1)")).otherwise(F.lit("")).alias("body"), F.lit(False).alias("is_merge"),
    )


def message_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files changed by each of messages()."""
    d = F.col("doc_id")
    own = read(spark, sf_dir, "documents").select(F.col("lang").alias("repo"), "doc_id", F.explode(F.array(F.lit(0), F.lit(3))).alias("k"))
    return own.select("repo", d.cast("string").alias("hash"), _path(d + F.col("k")).alias("path"), (d % 50 + F.col("k")).alias("insertions"), (d % 7).alias("deletions"), ((d + F.col("k")) % 11 == 0).alias("binary"))


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path) with every known ending, and names without one, by turns."""
    endings = [*LANGUAGES, ".TSX", ".unknown", "", ".Dockerfile"]
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("repo"), F.concat(F.lit("dir/f"), d.cast("string"), F.element_at(F.array(*[F.lit(e) for e in endings]), (d % len(endings) + 1).cast("int"))).alias("path"))


#: Folders and names of a small tree with package markers and entry points, by document number.
TREE_NAMES = ("src/api/package.json", "src/api/v1/users.ts", "src/index.ts", "lib/__init__.py", "lib/deep/er/x.py", "docs/a.md", "main.py", "setup.py", "app/server.js", "app/pages/home.js")


def marked_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path): ten projects of one root each, with package markers in some folders."""
    d = F.col("doc_id")
    name = F.element_at(F.array(*[F.lit(x) for x in TREE_NAMES]), (F.floor(d / 10) % len(TREE_NAMES) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("t"), (d % 10).cast("string")).alias("project"), F.when(d < 100, name).otherwise(F.concat(F.regexp_replace(name, r"[^/]*$", ""), F.lit("f"), d.cast("string"), F.lit(".ts"))).alias("path"))


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, number, record): orders as commits of a git log with numstat rows, as text."""
    key = lambda c: F.sha1(F.col(c).cast("string").cast("binary"))
    sign = lambda c: F.when(F.col("l_returnflag") == "R", F.lit("-")).otherwise(F.col(c).cast("int").cast("string"))
    row = F.concat_ws("\t", sign("l_quantity"), sign("l_linenumber"), F.concat(_path(F.col("l_partkey")), F.lit("."), F.col("l_linenumber").cast("string")))
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    author = F.concat(F.lit("a"), F.col("o_custkey").cast("string"))
    head = F.concat_ws("|", key("o_orderkey"), author, F.concat(author, F.lit("@mail.example")), F.date_format(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ss"))
    return read(spark, sf_dir, "orders").join(rows, "o_orderkey", "left").select(F.concat(F.lit("r"), (F.col("o_orderkey") % 3).cast("string")).alias("repo"), F.col("o_orderkey").alias("number"), F.concat_ws("\n", head, "rows").alias("record"))


#: Numbers of commits whose records are joined at once.
STRETCH = 3000


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, part, log): all of those records as one text for each repository, by number, in parts of bounded size.

    Each stretch of numbers is cut at the line in its middle, as a reader of so many bytes would: mostly within a commit.
    """
    stretch = F.floor(F.col("number") / STRETCH).alias("stretch")
    joined = log_records(spark, sf_dir).groupBy("repo", stretch).agg(F.array_sort(F.collect_list(F.struct("number", "record"))).alias("r"))
    lines = joined.select("repo", "stretch", F.split(F.concat(F.array_join(F.transform("r", lambda r: r["record"]), "\n\n"), F.lit("\n")), "\n").alias("l"))
    half = F.floor(F.size("l") / 2).cast("int")
    halves = F.array(F.slice("l", F.lit(1), half), F.slice("l", half + 1, F.size("l")))
    return lines.select("repo", "stretch", F.posexplode(halves).alias("half", "l")).select("repo", (F.col("stretch") * 2 + F.col("half")).alias("part"), F.array_join("l", "\n").alias("log"))


def whole_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pr_id, diff): a diff of three files for each document, one new, one changed, one deleted."""
    d = F.col("doc_id")
    plus = lambda n: F.array_join(F.array_repeat(F.lit("+x"), n.cast("int")), "\n")
    head = lambda e: F.concat(F.lit("diff --git a/src/f"), d.cast("string"), F.lit(f"{e} b/src/f"), d.cast("string"), F.lit(f"{e}\n"))
    old, new = (lambda e: F.concat(F.lit("--- a/src/f"), d.cast("string"), F.lit(f"{e}\n"))), (lambda e: F.concat(F.lit("+++ b/src/f"), d.cast("string"), F.lit(f"{e}\n")))
    return read(spark, sf_dir, "documents").select(d.alias("pr_id"), F.concat(
        F.lit("From here\n"), head(".ts"), F.lit("new file mode 100644\n--- /dev/null\n"), new(".ts"), F.lit("@@ -0,0 +1 @@\n"), plus(d % 5 + 1), F.lit("\n"), head(".py"), old(".py"), new(".py"),
        F.lit("@@ -1,2 +1,9 @@ f\n a\n-b\n"), plus(d % 7 + 1), F.lit("\n@@ -20 +30 @@\n-c\n"), head(".md"), F.lit("deleted file mode 100644\n"), old(".md"), F.lit("+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n")).alias("diff"))


def _snippet(k):
    return F.element_at(F.array(*[F.lit(x) for x in SNIPPETS]), (F.pmod(k, F.lit(len(SNIPPETS))) + 1).cast("int"))


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of 40 pull requests, each with a patch of two hunks."""
    d = F.col("doc_id")
    s = lambda n: _snippet(d * 3 + n)
    patch = F.concat(
        F.lit("noise before\n@@ -"), (d % 7 + 1).cast("string"), F.lit(",3 +"), (d % 11 + 1).cast("string"), F.lit(",4 @@ head\n same\n+"), s(0), F.lit("\n-old line\n+"), s(1), F.lit("\n\\ No newline at end of file\n+"), s(2),
        F.lit("\n@@ -90 +"), (d % 13 + 100).cast("string"), F.lit(" @@\n-gone\n+"), s(3), F.lit("\n  kept\n-"), s(4),
    )
    return read(spark, sf_dir, "documents").select(
        (d % 40).alias("pr_id"), F.floor(d / 40).cast("bigint").alias("file_ix"), _path(d).alias("filename"), F.element_at(F.array(*[F.lit(x) for x in ("added", "modified", "removed", "renamed")]), (d % 4 + 1).cast("int")).alias("status"),
        (d % 97 * 7).alias("additions"), (d % 31).alias("deletions"), patch.alias("patch"),
    )


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr_files(spark, sf_dir).groupBy("pr_id").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count(F.lit(1)).alias("changed_files"), F.concat(F.lit("sha"), F.col("pr_id").cast("string")).alias("head_sha"))


def pr_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as comments on the pull requests."""
    c = read(spark, sf_dir, "conversations")
    seq = F.col("conv_id") * 100 + F.col("turn")
    return c.select(
        (F.col("conv_id") % 40).alias("pr_id"), seq.alias("id"), F.col("role").alias("author"), F.col("text").alias("body"), (F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_interval(secs=(seq % 9973).cast("double"))).alias("created_at"),
        F.when(F.col("turn") % 3 == 1, F.lit("src/a.ts")).alias("path"), F.when(F.col("turn") % 3 == 1, F.when(seq % 5 == 0, None).otherwise((seq % 50 + 1).cast("int"))).alias("line"), F.lit(None).cast("string").alias("side"),
        F.when(F.col("turn") % 3 == 2, seq - 1).alias("in_reply_to"), F.when(seq % 7 == 0, (seq % 60 + 1).cast("int")).alias("start_line"), F.lit(None).cast("string").alias("commit_id"), F.lit(None).cast("string").alias("subject_type"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with cycles over the parts."""
    part = read(spark, sf_dir, "part")
    n = part.agg(F.count(F.lit(1)).alias("n"))
    k = F.col("p_partkey")
    return part.crossJoin(F.broadcast(n)).select(F.lit("main").alias("project"), k.cast("string").alias("src"), ((k * 7 + 3) % F.col("n")).cast("string").alias("dst"), F.lit(1).cast("bigint").alias("weight"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path) of the parts as files."""
    return read(spark, sf_dir, "part").select(F.lit("main").alias("project"), _path(F.col("p_partkey")).alias("path"))


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports between those files, not deduplicated."""
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    n = part.agg(F.count(F.lit(1)).alias("n"))
    own = part.crossJoin(F.broadcast(n))
    to = lambda m, a: ((k * m + a) % F.col("n")).cast("bigint") + 1
    ends = own.select("p_partkey", F.explode(F.array(to(7, 3), to(3, 8), to(1, 40))).alias("t"))
    return ends.select(F.lit("main").alias("project"), _path(F.col("p_partkey")).alias("src"), _path(F.col("t")).alias("dst"), F.lit(1).cast("bigint").alias("weight"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages: an acyclic graph."""
    return read(spark, sf_dir, "pages").select(F.lit("web").alias("project"), F.col("url").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("dst"), F.lit(1).cast("bigint").alias("weight"))


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _sql_path(k: str) -> str:
    return f"{_sql_list(FOLDERS)}[({k} % 8 + 1)::int] || '/m' || ({k} % 40)::varchar || '/f' || ({k})::varchar || {_sql_list(EXTENSIONS)}[({k} % 5 + 1)::int]"


def _sql_snippet(n: int) -> str:
    return f"(select l from snips)[((doc_id * 3 + {n}) % {len(SNIPPETS)} + 1)::int]"


SQL = {
    "commits": "select 'r' || (o_orderkey % 3)::varchar as repo, o_orderkey::varchar as hash, 'a' || o_custkey::varchar as author, 'a' || o_custkey::varchar || '@mail.example' as author_email, o_orderdate::timestamp as ts, o_orderpriority || ' change' as message, null::varchar as body, o_orderstatus = 'P' as is_merge from orders",
    "file_changes": f"select 'r' || (l_orderkey % 3)::varchar as repo, l_orderkey::varchar as hash, {_sql_path('l_partkey')} as path, l_quantity::bigint as insertions, l_linenumber::bigint as deletions, l_returnflag = 'R' as \"binary\" from lineitem",
    "branches": "select 'r' || (o_custkey % 3)::varchar as repo, 'b' || o_custkey::varchar as name, max(o_orderdate)::timestamp as ts from orders group by o_custkey",
    "repo_files": f"select 'r' || (p_partkey % 3)::varchar as repo, {_sql_path('p_partkey')} as path from part",
    "activity": "select event_type as repo, event_id::varchar as hash, 'u' || user_id::varchar as author, ts::timestamp as ts from events",
    "messages": "select lang as repo, doc_id::varchar as hash, source as author, timestamp '2024-01-01' + to_days((doc_id % 300)::int) as ts, split_part(coalesce(text, ''), chr(10), 1) as message, case when strpos(coalesce(text, ''), chr(10)) > 0 then substr(text, strpos(text, chr(10)) + 1) else '' end as body from documents",
    "snips": f"select {_sql_list(SNIPPETS)} as l",
    "pr_files": f"select doc_id % 40 as pr_id, doc_id // 40 as file_ix, {_sql_path('doc_id')} as filename, ['added', 'modified', 'removed', 'renamed'][(doc_id % 4 + 1)::int] as status, doc_id % 97 * 7 as additions, doc_id % 31 as deletions, "
    f"'noise before' || chr(10) || '@@ -' || (doc_id % 7 + 1)::varchar || ',3 +' || (doc_id % 11 + 1)::varchar || ',4 @@ head' || chr(10) || ' same' || chr(10) || '+' || {_sql_snippet(0)} || chr(10) || '-old line' || chr(10) || '+' || {_sql_snippet(1)} || chr(10) || '\\ No newline at end of file' || chr(10) || '+' || {_sql_snippet(2)} "
    f"|| chr(10) || '@@ -90 +' || (doc_id % 13 + 100)::varchar || ' @@' || chr(10) || '-gone' || chr(10) || '+' || {_sql_snippet(3)} || chr(10) || '  kept' || chr(10) || '-' || {_sql_snippet(4)} as patch from documents",
    "edges": "select 'main' as project, p_partkey::varchar as src, ((p_partkey * 7 + 3) % (select count(*) from part))::varchar as dst, 1 as weight from part",
    "tree": f"select 'main' as project, {_sql_path('p_partkey')} as path from part",
    "tree_edges": f"select 'main' as project, {_sql_path('k')} as src, {_sql_path('t')} as dst from (select p_partkey as k, unnest([(p_partkey * 7 + 3) % n + 1, (p_partkey * 3 + 8) % n + 1, (p_partkey + 40) % n + 1]) as t from part, (select count(*) as n from part))",
    "links": "select 'web' as project, url as src, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) as dst from pages",
}
SQL["message_changes"] = f"select lang as repo, doc_id::varchar as hash, {_sql_path('(doc_id + k)')} as path, doc_id % 50 + k as insertions, doc_id % 7 as deletions, (doc_id + k) % 11 = 0 as \"binary\" from (select *, unnest([0, 3]) as k from documents)"
SQL["marked_tree"] = (
    f"select 't' || (doc_id % 10)::varchar as project, case when doc_id < 100 then name else regexp_replace(name, '[^/]*$', '') || 'f' || doc_id::varchar || '.ts' end as path from (select *, {_sql_list(TREE_NAMES)}[((doc_id // 10) % {len(TREE_NAMES)} + 1)::int] as name from documents)"
)
SQL["diff_raw"] = "select pr_id, file_ix, filename, generate_subscripts(l, 1) - 1 as pos, unnest(l) as line from (select *, string_split(patch, chr(10)) as l from pr_files)"
SQL["diff_hunks"] = "select *, sum((line ~ '^@@ -[0-9]+(,[0-9]+)? \\+[0-9]+(,[0-9]+)? @@.*')::int) over (partition by pr_id, file_ix order by pos) as hunk from diff_raw"
SQL["diff_heads"] = "select *, first_value(line) over (partition by pr_id, file_ix, hunk order by pos) as h, line[1] = '+' as plus, line[1] = '-' as minus, row_number() over (partition by pr_id, file_ix, hunk order by pos) > 1 as body from diff_hunks where hunk > 0"
SQL["diff_lines"] = (
    "select pr_id, file_ix, filename, hunk, pos, plus, minus, body, case when plus then 'add' when minus then 'del' else 'normal' end as type, "
    "regexp_extract(h, '^@@ -([0-9]+)', 1)::int + sum((body and not plus)::int) over w - 1 as o, regexp_extract(h, '\\+([0-9]+)', 1)::int + sum((body and not minus)::int) over w - 1 as n, "
    "case when line[1] in ('+', '-', ' ') then substr(line, 2) else line end as content from diff_heads window w as (partition by pr_id, file_ix, hunk order by pos)"
)
NEEDS = {"pr_files": ("snips",), "diff_raw": ("pr_files",), "diff_hunks": ("diff_raw",), "diff_heads": ("diff_hunks",), "diff_lines": ("diff_heads",)}


def with_sql(names: str, query: str, recursive: bool = False) -> str:
    """The query with the named relations in front."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    head = "with recursive " if recursive else "with "
    rest = query.removeprefix("with ")
    return head + ", ".join(f"{n} as ({SQL[n]})" for n in wanted) + (", " if rest != query else " ") + rest
