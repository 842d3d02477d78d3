"""Line dedup by content-defined chunks.

A text is its lines. A rolling hash over the hashes of the last WINDOW lines proposes a boundary after a line; of proposals
in a row only the first counts, so a chunk that a boundary ends has two lines at least. Boundaries depend on the lines next
to them alone: lines put in or taken out shift no boundary further on. Chunks with two lines or more that are not blank are
counted by digest over all texts; the bytes of those that occur twice are compared, and every copy but the first goes.

Digests travel first, without texts. Bytes are compared by the least and the greatest text of each digest, which tasks
combine before the shuffle, so a hot chunk is sent once a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound, bound_batches, free, placed, small, spread_join, stage

#: Lines under the rolling hash, and one in how many values of it proposes a boundary.
WINDOW, DIVISOR = 2, 2
#: Fixed values of the rolling hash: base and modulus.
BASE, MODULUS = 131, (1 << 31) - 1


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    """32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _proposals(held: Column, window: int, divisor: int) -> Column:
    """Whether the rolling hash up to each line proposes a boundary after it; lines before the first count as 0."""

    def rolled(x: Column, i: Column) -> Column:
        total = x
        for k in range(1, window):
            total = total + F.coalesce(F.get(held, i - k), F.lit(0)) * pow(BASE, k, MODULUS) % MODULUS
        return total % MODULUS % divisor == 0

    return F.transform(held, rolled)


def chunks(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """The chunks with two lines or more that are not blank: array of (pos, n_lines, chunk), pos from 0."""

    def of(all_lines: Column, proposed: Column) -> Column:
        n = F.size(all_lines)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ((i > 1) & F.get(proposed, i - 1) & ~F.get(proposed, i - 2)))

        def cut(s: Column) -> Column:
            size = lambda i, k: F.coalesce(F.get(s, k + 1), n) - i
            own = F.transform(s, lambda i, k: F.struct(i.alias("pos"), size(i, k).alias("n_lines"), F.slice(all_lines, i + 1, size(i, k)).alias("own")))
            full = F.filter(own, lambda c: F.size(F.filter(c["own"], lambda x: F.regexp_like(x, F.lit(WORD)))) > 1)
            return F.transform(full, lambda c: F.struct(c["pos"].alias("pos"), c["n_lines"].alias("n_lines"), F.array_join(c["own"], "\n").alias("chunk")))

        return bound(starts, cut)

    return bound(lines(text), lambda every: bound(F.transform(every, line_hash), lambda held: bound(_proposals(held, window, divisor), lambda proposed: of(every, proposed))))


def md5(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _removed(rows: DataFrame, known: DataFrame, digest: Callable[[Column], Column], window: int, divisor: int) -> DataFrame:
    """(_file, _row, pos, n_lines) of the chunks that go. rows: doc_id, text, _file, _row; known: their chunks' places and digests."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row", "pos")
    at = F.struct("_file", "_row", "pos")
    keeper = F.struct("first._file", "first._row", "first.pos")
    twice = stage(known.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1"), "twice")
    # hot digests never meet in one task here either: the tasks combine their rows first
    texts = rows.select("doc_id", "_file", "_row", F.explode(chunks(F.col("text"), window, divisor)).alias("c")).select("doc_id", "_file", "_row", "c.*").withColumn("digest", digest(F.col("chunk")))
    texts = texts.join(small(twice.select("digest"), 64), "digest", "left_semi")
    ends = texts.groupBy("digest").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    odd = stage(ends.filter("a <> b").select("digest"), "odd")
    members = spread_join(known, twice, ["digest"], "n")
    if odd.isEmpty():
        return members.filter(at != keeper).select("_file", "_row", "pos", "n_lines")
    # texts that only share a digest form groups by their bytes
    unlike = texts.join(small(odd, 64), "digest", "left_semi")
    own = unlike.groupBy("digest", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    again = spread_join(unlike, stage(own, "unlike"), ["digest", "chunk"], "n")
    even = members.join(small(odd, 64), "digest", "left_anti")
    return even.unionByName(again.select(*even.columns)).filter(at != keeper).select("_file", "_row", "pos", "n_lines")


def _left(every: Column, removed: Column) -> Column:
    """The lines outside the removed runs (pos, n_lines), which are in order."""
    after = lambda i: F.coalesce(F.get(removed, i - 1)["pos"] + F.get(removed, i - 1)["n_lines"], F.lit(0))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), lambda i: F.slice(every, after(i) + 1, F.coalesce(F.get(removed, i)["pos"], F.size(every)) - after(i))))


def _decide(docs: DataFrame, digest: Callable[[Column], Column], window: int, divisor: int) -> tuple[DataFrame, DataFrame]:
    """(_file, _row, removed: the runs in order) of the texts that lose lines, and (_file, _row, n_chunks) of those with chunks."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    short = F.transform(chunks(F.col("text"), window, divisor), lambda c: F.struct(c["pos"].alias("pos"), c["n_lines"].alias("n_lines"), digest(c["chunk"]).alias("digest")))
    known = stage(rows.select("doc_id", "_file", "_row", F.explode(short).alias("c")).select("doc_id", "_file", "_row", "c.*"), "chunks")
    gone = _removed(rows, known, digest, window, divisor).groupBy("_file", "_row").agg(F.array_sort(F.collect_list(F.struct("pos", "n_lines"))).alias("removed"))
    return stage(gone, "removed"), known.groupBy("_file", "_row").agg(F.count(F.lit(1)).alias("n_chunks"))


def without_repeated_lines(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, digest: Callable[[Column], Column] = md5) -> DataFrame:
    """docs' own columns, text without the repeated chunks of lines, and what went: n_lines, n_removed_chunks, n_removed_lines.

    Of equal chunks the one in the text with the smallest id stays, the first one there; texts without an id come last, and
    repeated ids go by where their rows lie. A text that loses all its lines is empty. Null text has one empty line and
    comes back empty. Lines end at line feeds and are compared to the byte. A chunk with fewer than two lines that are not
    blank never goes, so a text of one line loses nothing. The lines of a shared passage before its first and after its
    last common boundary stay. No rows give no rows. Columns of any name are carried along; where the three names are
    taken, they get underscores.
    """
    docs = docs if placed(docs) else stage(docs, "docs")
    gone, _ = _decide(docs, digest, window, divisor)
    names = [free(c, docs.columns) for c in ("_file", "_row", "_removed", "n_lines", "n_removed_chunks", "n_removed_lines")]
    file, row, removed, *counts = names
    rows = docs.select("*", F.xxhash64(F.col("_metadata.file_path")).alias(file), F.col("_metadata.row_index").alias(row))
    held = rows.join(small(gone.toDF(file, row, removed), 256), [file, row], "left")
    runs = F.coalesce(F.col(removed), F.array().cast(gone.schema["removed"].dataType))
    text = F.when(F.col(removed).isNull(), F.coalesce("text", F.lit(""))).otherwise(bound(lines(F.col("text")), lambda every: F.array_join(_left(every, F.col(removed)), "\n")))
    how_many = F.aggregate(runs, F.lit(0).cast("bigint"), lambda total, r: total + r["n_lines"])
    own = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return held.select(*own, F.size(lines(F.col("text"))).cast("bigint").alias(counts[0]), F.size(runs).cast("bigint").alias(counts[1]), how_many.alias(counts[2]))


def repeated_lines(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_lines, n_removed_chunks, n_removed_lines, kept_sha256 (of the lines that stay, lower-case hex).

    Rules as in without_repeated_lines; other columns are not read.
    """
    left = without_repeated_lines(docs.select("doc_id", "text") if placed(docs) else stage(docs.select("doc_id", "text"), "rows"), window, divisor)
    return left.select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
with every as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
flat as (select doc_id, len(l) as n, unnest(l) as line, generate_subscripts(l, 1) - 1 as pos from every),
hashed as (select *, ('0x' || substr(md5(line), 1, 8))::bigint as h from flat),
rolled as (select *, ((h + coalesce(lag(h) over w, 0) * {BASE} % {MODULUS}) % {MODULUS}) % {DIVISOR} = 0 as p from hashed window w as (partition by doc_id order by pos)),
starts as (select *, (pos = 0 or (pos > 1 and lag(p, 1) over w and not lag(p, 2) over w))::int as s from rolled window w as (partition by doc_id order by pos)),
numbered as (select *, sum(s) over (partition by doc_id order by pos) as k from starts),
chunks as (
  select doc_id, min(pos) as pos, count(*) as n_lines, string_agg(line, chr(10) order by pos) as chunk, count(*) filter (regexp_matches(line, '{WORD}')) as full_lines
  from numbered group by doc_id, k),
ranked as (select doc_id, pos, n_lines, row_number() over (partition by chunk order by doc_id, pos) > 1 as gone from chunks where full_lines > 1),
lost as (select doc_id, pos, n_lines from ranked where gone),
kept as (
  select f.doc_id, string_agg(line, chr(10) order by f.pos) as text from flat f
  where not exists (select 1 from lost x where x.doc_id = f.doc_id and f.pos >= x.pos and f.pos < x.pos + x.n_lines) group by f.doc_id)
select e.doc_id, len(l)::bigint as n_lines, coalesce(n, 0) as n_removed_chunks, coalesce(m, 0)::bigint as n_removed_lines, sha256(coalesce(text, '')) as kept_sha256
from every e left join (select doc_id, count(*) as n, sum(n_lines) as m from lost group by doc_id) using (doc_id) left join kept using (doc_id)
"""
