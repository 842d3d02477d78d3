"""What the operators share: the folder all executors see, staged tables, word and size rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A table goes to every executor only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 16 << 20

#: Bytes of rows in an Arrow batch and rows in a batch of the Parquet reader, at most: texts can be long, and both are held in memory whole.
ARROW_BYTES, READER_ROWS = 2 << 20, 512

_left_behind: list[tuple[SparkSession, str]] = []
#: Staged tables with their folders; the tables are held, so that no other gets the id.
_staged: dict[int, tuple[DataFrame, str]] = {}


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's batch sizes, where it has none of its own. They stay, as results are computed after the operators return."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = got.get() if got.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/loomline-{uuid.uuid4().hex}/{tag}"
    if not _left_behind:
        atexit.register(_clean)
    _left_behind.append((spark, path.rpartition("/")[0]))
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _left_behind:
        if spark.sparkContext._jsc is not None:
            try:
                remove(spark, path)
            except Exception as gone:  # the session may have ended before
                print(f"left behind: {path} ({type(gone).__name__})")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _staged[id(out)] = (out, path.rpartition("/")[0])
    return out


def forget(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read again, before the driver's interpreter does at its end."""
    if id(df) in _staged:
        remove(df.sparkSession, _staged.pop(id(df))[1])


def placed(docs: DataFrame) -> bool:
    """Whether Spark can say in which file and row each row of docs lies."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def located(docs: DataFrame, *columns: Column) -> DataFrame:
    """The given columns and, as _file and _row, where each row lies. Rows that lie in no Parquet file are staged first."""
    docs = docs if placed(docs) else stage(docs.select(*columns), "rows")
    return docs.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def free(name: str, columns: list[str]) -> str:
    """The name, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: A key is hot when it holds more rows than a HOT_KEYS-th of all, and than HOT_ROWS; so there are fewer than HOT_KEYS hot keys at any size.
HOT_KEYS, HOT_ROWS = 1 << 16, 128


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, how: str = "inner", row_bytes: int = 256) -> DataFrame:
    """rows joined with table, which has one row for each key and, in `count`, how many rows hold the key.

    A small table goes to every executor. Of a large one only the rows of hot keys do, fewer than HOT_KEYS, so that rows of
    hot keys stay where they are; the other keys are shuffled. how: "inner" or "left". Both tables should be staged, as both
    are read more than once.
    """
    n, total = table.agg(F.count(F.lit(1)), F.sum(count)).first()
    if n * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on, how)
    hot = table.filter(F.col(count) > max(HOT_ROWS, (total or 0) // HOT_KEYS))
    cold = table.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: as a lambda's argument it isn't copied into the lambdas inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
