"""Exact deduplication as a stateful stream (native).

Digests of the normalised texts are written to a log, and a stream reads the log into keyed state that lies on disk
(RocksDB) and never expires. For each digest the state holds the smallest id of the first batch that had it, where that row
lies (file and row), and the number of rows. Wherever a digest was seen more than once, the full texts are compared before
rows count as equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, bound_batches, free, located, new_path, placed, small, spread_join, stage

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store is closed once its task has committed, not kept open
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many stores reserves 4 MB
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _into_state(spark: SparkSession, at: str, schema) -> DataFrame:
    """Streams what is new in the log into the state; what the state then holds of digests seen twice: (digest, n, keeper)."""
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    try:
        for k, v in _STATE_CONF.items():
            spark.conf.set(k, v)
        log = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/log")
        seen = log.groupBy("digest").agg(F.min("place").alias("keeper"), F.count(F.lit(1)).alias("n"))
        query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(f"{at}/state")
        keeper, n = (F.col("value")[f.name] for f in state.schema["value"].dataType.fields)
        return stage(state.select(F.col("key")["digest"].alias("digest"), n.alias("n"), keeper.alias("keeper")).filter("n > 1"), "groups")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _names(spark: SparkSession, path: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _earlier(spark: SparkSession, wanted: DataFrame) -> DataFrame | None:
    """(digest, norm) at the places wanted(digest, _file, _row) of earlier batches, read from where they lie."""
    files = [r[0] for r in wanted.select("_file").distinct().collect()]
    if not files:
        return None
    rows = located(spark.read.parquet(*files), F.col("text"))
    return rows.join(small(wanted, 256), ["_file", "_row"]).select("digest", "_file", "_row", normalised(F.col("text")).alias("norm"))


def _decide(docs: DataFrame, digest: Callable[[Column], Column], state_path: str | None) -> DataFrame:
    """Per row of docs: doc_id, _file, _row, sha (binary), keep_id, group_size, kept."""
    spark = docs.sparkSession
    bound_batches(spark)
    at = state_path or new_path(spark, "exact")
    batch = len(_names(spark, f"{at}/log"))
    if state_path and not placed(docs):  # later batches look the texts up here
        docs.select("doc_id", "text").write.parquet(f"{at}/rows/{batch:06d}")
        docs = spark.read.parquet(f"{at}/rows/{batch:06d}")
    rows = located(docs, F.col("doc_id"), F.col("text")).withColumn("norm", normalised(F.col("text"))).drop("text")
    place = F.struct(F.lit(batch).cast("bigint").alias("batch"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row").alias("place")
    own = f"{at}/log/{batch:06d}"
    rows.select(place, digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("sha")).write.parquet(own)
    log = spark.read.parquet(own)
    if log.isEmpty():
        return log.select("place.doc_id", "place._file", "place._row", "sha", F.lit(None).cast("bigint").alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(False).alias("kept"))
    groups = _into_state(spark, at, log.schema)
    if batch:
        groups = stage(groups.join(log.select("digest"), "digest", "left_semi"), "groups")
    # the bytes of every hit: the tasks combine a group's texts before they are shuffled
    held = rows.withColumn("digest", digest(F.col("norm"))).join(small(groups.select("digest"), 64), "digest", "left_semi")
    texts = held.select("digest", "norm")
    before = _earlier(spark, groups.filter(F.col("keeper.batch") < batch).select("digest", "keeper._file", "keeper._row")) if batch else None
    if before is not None:
        texts = texts.unionByName(before.select("digest", "norm"))
    odd = stage(texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("digest"), "odd")
    flat = log.select("place", "digest", "sha")
    if odd.isEmpty():
        found = spread_join(flat, groups, ["digest"], "n", "left")
    else:
        found = _regrouped(spark, at, batch, flat, groups, held, odd)
    k = F.col("keeper")
    return found.select(
        "place.doc_id", "place._file", "place._row", "sha", F.when(k.isNull(), F.col("place.doc_id")).otherwise(k["doc_id"]).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        F.when(k.isNull(), True).otherwise((k["batch"] == batch) & (k["_file"] == F.col("place._file")) & (k["_row"] == F.col("place._row"))).alias("kept"),
    )


def _regrouped(spark: SparkSession, at: str, batch: int, flat: DataFrame, groups: DataFrame, held: DataFrame, odd: DataFrame) -> DataFrame:
    """place, digest, sha, n, keeper, where rows of texts that only share a digest form groups by their bytes."""
    odd = small(odd, 64)
    names = F.col("place._file").alias("_file"), F.col("place._row").alias("_row")
    logged = spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/log").join(odd, "digest", "left_semi").select("digest", "place", *names)
    norms = held.join(odd, "digest", "left_semi").select("digest", "_file", "_row", "norm")
    before = _earlier(spark, logged.filter(F.col("place.batch") < batch).select("digest", "_file", "_row").distinct()) if batch else None
    if before is not None:
        norms = norms.unionByName(before.select(*norms.columns))
    full = stage(logged.join(norms, ["digest", "_file", "_row"]).select("place", "digest", "norm"), "unequal")
    by_text = stage(full.groupBy("digest", "norm").agg(F.min("place").alias("keeper"), F.count(F.lit(1)).alias("n")), "by-text")
    moved = spread_join(full.filter(F.col("place.batch") == batch), by_text, ["digest", "norm"], "n").select("place", "n", "keeper")
    left = flat.join(odd, "digest", "left_semi").join(stage(moved, "moved"), "place")
    even = spread_join(stage(flat.join(odd, "digest", "left_anti"), "even"), stage(groups.join(odd, "digest", "left_anti"), "even-groups"), ["digest"], "n", "left")
    return even.unionByName(left.select(*even.columns))


def exact_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state_path: str | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the smallest id stays; rows without an id stay only if no row of their group
    has one. Of repeated rows (same id, same text) the first by file and row stays. No rows give no rows. Other columns,
    whatever their names, are not read.

    With a state_path (on storage that all executors see) the state outlives the call, and the next call with it is the next
    batch: its rows meet the texts of all earlier batches, whose keepers stay; sizes count the rows so far. The files of
    earlier batches must still lie where they lay. A call that failed half way leaves a state that has to be built anew.
    """
    return _decide(docs, digest, state_path).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, state_path: str | None = None) -> DataFrame:
    """docs' own columns, without the rows that exact_copies does not keep.

    Rules as there: of each group of equal texts one row stays, null and empty texts being one group, rows without an id and
    repeated rows included. An empty table stays empty. Columns of any name are carried along, and null in them means nothing.
    docs that lie in no Parquet file are staged first.
    """
    if not placed(docs):
        docs = stage(docs, "docs")
    gone = stage(_decide(docs, sha256, state_path).filter("not kept").select("_file", "_row"), "gone")
    file, row = free("_file", docs.columns), free("_row", docs.columns)
    place = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return place.join(small(gone.toDF(file, row), 256), [file, row], "left_anti").select(*docs.columns)


ORACLE = r"""
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
window w as (partition by norm)
"""
