"""Benchmark decontamination (native): MinHash containment search in partitions by size, then exact containment.

An item is contained in a document when the document holds at least `percent` of the item's distinct word shingles. Of an
item with n shingles at most n - need can be absent, so of its n - need + 1 smallest hashes (its bottom-k MinHash sketch,
k fixed by its size) a document that contains it holds at least one: looking the sketches' hashes up in the documents
loses nothing, however long the document is. Items are partitioned by size (powers of two of what they need). Sketches
are the smallest fifth of an item's hashes, so the largest hash of a partition's sketches lies low where items are long. A
document is looked up only in the partitions that it is long enough for, and only with its hashes up to the largest there:
the others are dropped before they become rows. Pairs found are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bound, bound_batches, free, placed, small, stage

WIDTH, PERCENT = 5, 80


def word_array(text: Column) -> Column:
    """Lower-case words of a text; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def _places(words: Column, width: int) -> Column:
    """0-based first words of the shingles of this width."""
    n = F.size(words)
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def hashed_shingles(words: Column, width: int) -> Column:
    return bound(words, lambda w: F.array_distinct(F.transform(_places(w, width), lambda i: F.xxhash64(F.lit(width), *[F.get(w, i + k) for k in range(width)]))))


def text_shingles(words: Column, width: int) -> Column:
    return bound(words, lambda w: F.array_distinct(F.transform(_places(w, width), lambda i: F.array_join(F.slice(w, i + 1, width), " "))))


def _needed(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("int")


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")


def sketches(items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(item_id, width, shingles, n, need, size_class, sketch) of items(item_id, text). Items with fewer words than the width are one shingle; empty ones are left out."""
    words = items.select("item_id", word_array(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    words = words.withColumn("width", F.least(F.size("words"), F.lit(width)))
    by_width = [
        words.filter(F.col("width") == w).select("item_id", "width", text_shingles(F.col("words"), w).alias("shingles"), F.array_sort(hashed_shingles(F.col("words"), w)).alias("hashes"))
        for w in range(1, width + 1)
    ]
    found = by_width[0]
    for other in by_width[1:]:
        found = found.unionByName(other)
    n = F.size("shingles")
    found = found.withColumns({"n": n, "need": _needed(n, percent)}).withColumn("size_class", _size_class(F.col("need")))
    return stage(found.select("item_id", "width", "shingles", "n", "need", "size_class", F.slice("hashes", F.lit(1), F.col("n") - F.col("need") + 1).alias("sketch")), "sketches")


def _largest(held: Column, parts: list) -> Column:
    """The largest sketch hash in the size partitions that a text with so many shingles is long enough for."""
    open_ = [F.when(held >= p["need"], F.lit(p["largest"])) for p in parts]
    return F.greatest(*open_, F.lit(None).cast("bigint")) if len(open_) == 1 else F.greatest(*open_)


def _found(docs: DataFrame, items: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, _file, _row, item_id, n, n_shared) of the pairs that pass. docs lie in Parquet files."""
    bound_batches(docs.sparkSession)
    known = sketches(items, width, percent)
    index = known.select("item_id", "width", "need", F.explode("sketch").alias("hash"))
    index = small(index, 64)
    # a row for each width and size class: 160 at most
    parts = known.groupBy("width", "size_class").agg(F.min("need").alias("need"), F.max(F.array_max("sketch")).alias("largest")).collect()
    widths = sorted({p["width"] for p in parts})
    file_id = F.xxhash64(F.col("_metadata.file_path")).alias("_file")
    rows = docs.select("doc_id", file_id, F.col("_metadata.row_index").alias("_row"), "text")
    pairs = None
    for w in widths:
        # the size, and the hashes that any partition the text is long enough for can hold
        probe = lambda h: F.struct(F.size(h).alias("held"), F.filter(h, lambda x: x <= _largest(F.size(h), [p for p in parts if p["width"] == w])).alias("hashes"))  # noqa: B023, E731
        hashed = rows.select("_file", "_row", bound(hashed_shingles(word_array(F.col("text")), w), probe).alias("p"))
        # the outer form spares a filter that would compute the hashes twice; its null row meets nothing in the join
        probes = hashed.select("_file", "_row", "p.held", F.explode_outer("p.hashes").alias("hash"))
        hits = probes.join(index.filter(F.col("width") == w), "hash").filter("need <= held").select("_file", "_row", "item_id", "width")
        pairs = hits if pairs is None else pairs.unionByName(hits)
    if pairs is None:
        return rows.select("doc_id", "_file", "_row", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("n"), F.lit(0).alias("n_shared")).limit(0)
    pairs = stage(pairs.distinct(), "candidates")
    of_item = small(known.select(F.col("item_id").alias("known_id"), F.col("width").alias("known_width"), "shingles", "n", "need"), 8192)
    held = rows.join(small(pairs, 64), ["_file", "_row"]).join(of_item, F.col("item_id").eqNullSafe(F.col("known_id")) & (F.col("width") == F.col("known_width")))
    shared = F.lit(0)
    for w in widths:
        shared = F.when(F.col("width") == w, F.size(F.array_intersect(text_shingles(word_array(F.col("text")), w), F.col("shingles")))).otherwise(shared)
    return held.withColumn("n_shared", shared).filter("n_shared >= need").select("doc_id", "_file", "_row", "item_id", "n", "n_shared")


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): one row for each row of docs(doc_id, text) and item of items(item_id, text) that it contains.

    Null and empty texts contain nothing and are contained nowhere. An item with fewer words than `width` is contained where
    its words stand in a row. Items repeated with id and words alike count once; repeated documents are rows of their own.
    Null ids are carried along. Without rows on either side nothing is found. Other columns are not read.
    """
    docs = docs if placed(docs) else stage(docs.select("doc_id", "text"), "rows")
    found = _found(docs, items, width, percent)
    return found.select("doc_id", "item_id", F.col("n").cast("bigint").alias("n_item_shingles"), F.col("n_shared").cast("bigint").alias("n_shared"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs' own columns, without the rows that contain an item.

    Null and empty texts and rows with null ids contain what contaminated() says: nothing, or what their text holds. Repeated
    rows stay or go together; without items all rows stay, and an empty table stays empty. Columns of any name are carried along.
    """
    docs = docs if placed(docs) else stage(docs, "docs")
    gone = stage(_found(docs, items, width, percent).select("_file", "_row").distinct(), "gone")
    file, row = free("_file", docs.columns), free("_row", docs.columns)
    place = docs.select("*", F.xxhash64(F.col("_metadata.file_path")).alias(file), F.col("_metadata.row_index").alias(row))
    return place.join(small(gone.toDF(file, row), 64), [file, row], "left_anti").select(*docs.columns)


ORACLE = r"""
with doc_words as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
item_words as (
  select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
item_places as (select item_id, w, least(len(w), 5) as width, unnest(range(1, greatest(len(w) - least(len(w), 5), 0) + 2)) as i from item_words where len(w) > 0),
item_shingles as (select distinct item_id, width, array_to_string(w[i:i + width - 1], ' ') as shingle from item_places),
doc_places as (
  select doc_id, w, width, unnest(range(1, len(w) - width + 2)) as i
  from doc_words, (select distinct width from item_shingles) where len(w) >= width),
doc_shingles as (select distinct doc_id, width, array_to_string(w[i:i + width - 1], ' ') as shingle from doc_places),
shared as (
  select doc_id, item_id, count(*) as n_shared from doc_shingles join item_shingles using (width, shingle) group by doc_id, item_id)
select doc_id, item_id, n as n_item_shingles, n_shared
from shared join (select item_id, count(*) as n from item_shingles group by item_id) using (item_id)
where 100 * n_shared >= 80 * n
"""
