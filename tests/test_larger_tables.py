"""Queries on made tables in which results depend on the size, against DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline import catalog
from loomline.operators import graph
from loomline.plans import fixtures
from loomline.sources import gitlog


def sides(spark, folder, name, *tables):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    found = con.sql(catalog.oracle_sql()[name])
    return sorted(map(tuple, catalog.queries()[name](spark, str(folder)).select(*found.columns).collect())), sorted(found.fetchall())


@pytest.mark.parametrize("name", ["transitive_dependencies", "reverse_dependencies"])
def test_ways_longer_than_the_sql_follows(spark, tmp_path, name):
    # 67 parts lie on one ring of 66 and a loop
    spark.range(67).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    ours, wanted = sides(spark, tmp_path, name, "part")
    assert ours == wanted and max(r[2] for r in ours) == 60


def test_steps_of_a_search(spark):
    chain = spark.createDataFrame([("p", str(k), str(k + 1)) for k in range(5)], "project string, src string, dst string")
    start = spark.createDataFrame([("p", "2")], "project string, node string")
    found = lambda f, *steps: sorted((r["node"], r["depth"]) for r in f(chain, start, *steps).collect())
    assert found(graph.transitive_dependencies, 2) == [("3", 1), ("4", 2)] and found(graph.transitive_dependencies, 0) == []
    assert found(graph.reverse_dependencies, 1) == [("1", 1)] and found(graph.reverse_dependencies) == [("0", 2), ("1", 1)]
    assert found(graph.transitive_dependencies) == [("3", 1), ("4", 2), ("5", 3)]


def test_a_log_whose_commits_come_in_another_order_each_time(spark):
    # as texts joined from shuffled rows do
    records = [f"{k:040x}|a{k}|a@x|2024-01-02 03:04:05" + "".join(f"\n1\t2\tf{j}" for j in range(k)) for k in range(30)]

    @F.udf("string")
    def mixed(repo):
        return "\n\n".join(random.sample(records, len(records)))

    spark.conf.set("spark.sql.exchange.reuse", "false")
    logs = spark.createDataFrame([("r",), ("s",)], "repo string").select("repo", mixed.asNondeterministic()("repo").alias("log"))
    commits, changes = gitlog.numstat_log(logs)
    assert {(r["repo"], r["hash"]) for r in commits.collect()} == {(x, f"{k:040x}") for x in "rs" for k in range(30)}
    found = {(r["repo"], int(r["hash"], 16), r["count"]) for r in changes.groupBy("repo", "hash").count().collect()}
    spark.conf.unset("spark.sql.exchange.reuse")
    assert found == {(x, k, k) for x in "rs" for k in range(1, 30)}


def test_lines_like_headers(spark):
    head = lambda c, rest: c * 40 + rest
    log = "\n".join(["1\t1\tbefore any", head("1", "|A|a@x|2024-01-02"), "1\t1\ta|b", head("2", "|B|b@x"), head("3", "|C|c@x|"), "2\t1\tc", "x" + head("4", "|D|d@x|2024-01-02"), "3\t1\td", head("5", "|E|e|f|g|h")])
    logs = spark.createDataFrame([("r", "\n\n" + log), ("e", ""), ("n", None)], "repo string, log string")
    commits, changes = gitlog.numstat_log(logs)
    assert sorted(r["hash"][0] + r["author"] for r in commits.collect()) == ["1A", "3C", "5E"]
    assert sorted((r["hash"][0], r["path"]) for r in changes.collect()) == [("1", "a|b"), ("3", "c"), ("3", "d")]
    commits, changes = gitlog.numstat_log(logs, with_email=False)
    assert sorted(r["hash"][0] for r in commits.collect()) == ["1", "2", "3", "5"] and changes.count() == 3


def test_a_log_in_parts(spark):
    lines = []
    for k in range(12):
        lines += [f"{k:040x}|a{k}|a@x|2024-01-02 03:04:05", *(f"1\t2\tf{j}" for j in range(k % 5)), ""]
    wanted = {(f"{k:040x}", f"f{j}") for k in range(12) for j in range(k % 5)}
    for size in (1, 2, 3, 7, 100):
        parts = [(r, k // size, "\n".join(lines[k : k + size])) for r in ("r", None) for k in range(0, len(lines), size)] + [("t", 0, "1\t2\tof none"), ("t", 1, "1\t2\tof none")]
        commits, changes = gitlog.numstat_log(spark.createDataFrame(parts, "repo string, part long, log string").repartition(5))
        assert sorted((r["repo"] or "", r["hash"]) for r in commits.collect()) == [(r, f"{k:040x}") for r in ("", "r") for k in range(12)]
        assert sorted((r["repo"] or "", r["hash"], r["path"]) for r in changes.collect()) == sorted((r, *w) for r in ("", "r") for w in wanted)


def test_logs_beyond_the_first_commits(spark, tmp_path):
    # keys beyond 900, a commit without files, one key twice, rows of no order
    day = F.lit("2024-01-02").cast("timestamp")
    keys = spark.range(0, 9001, 7).union(spark.createDataFrame([(8400,)], "id long"))
    keys.select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), day.alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    rows = spark.range(12000).filter("id % 14 <> 0").select((F.col("id") % 9100).alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(1.0).alias("l_quantity"), (F.col("id") % 7).cast("int").alias("l_linenumber"), F.lit("N").alias("l_returnflag"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    ours, wanted = sides(spark, tmp_path, "log_as_one_text", "orders", "lineitem")
    assert ours == wanted and len(ours) == 1286 and {r[2] for r in ours} >= {0, 1, 2}
    assert fixtures.log_texts(spark, str(tmp_path)).count() == 3 * 3 * 2  # stretches, repositories, halves
