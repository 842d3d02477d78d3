"""Pull requests from landed JSON pages: fixed schemas, all pages read, or the first hundred rows as the interactive tool has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "pull_requests": "pr_id bigint, title string, state string, draft boolean, merged boolean, author string, head struct<ref:string,sha:string>, base struct<ref:string,sha:string>, created_at timestamp, additions bigint, deletions bigint, changed_files bigint, labels array<string>",
    "pr_files": "pr_id bigint, file_ix int, filename string, status string, additions bigint, deletions bigint, patch string",
    "pr_comments": "pr_id bigint, id bigint, author string, body string, created_at timestamp, path string, line int, side string, in_reply_to bigint",
    "pr_reviews": "pr_id bigint, id bigint, author string, state string, submitted_at timestamp",
}
_ORDER = {"pr_files": "file_ix", "pr_comments": "id", "pr_reviews": "id"}


def read_landed(spark: SparkSession, path: str, name: str, rows_per_pr: int | None = None) -> DataFrame:
    """JSON lines at path as the named table. rows_per_pr cuts each pull request as a reader without paging would."""
    df = spark.read.schema(SCHEMAS[name]).json(path)
    if rows_per_pr is None or name not in _ORDER:
        return df
    rank = F.row_number().over(Window.partitionBy("pr_id").orderBy(_ORDER[name]))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= rows_per_pr).drop("_rank")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
