"""Dependency graphs as edge tables: degrees, ends, strong components, cycles, closures, levels and paths.

edges(project, src, dst, weight). Loops over a graph write their rounds to the folder that the executors share and delete
them when they are no longer read; only counts reach the driver.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsmath import divided, first_in_order


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        got = context._jsc.sc().getCheckpointDir()
        folder = got.get() if got.isDefined() else None
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomline-graph-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_all_rounds: list[Rounds] = []


class Rounds:
    """Tables that a loop writes and reads again. Each is deleted once it is dropped, the rest when the interpreter ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at, self.paths = spark, f"{_shared(spark)}/loomline-{uuid.uuid4().hex}", {}
        if not _all_rounds:
            atexit.register(_clean)
        _all_rounds.append(self)

    def keep(self, df: DataFrame, *old: DataFrame | None) -> DataFrame:
        """df, written and read back; the old tables go."""
        path = f"{self.at}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        for o in old:
            self.drop(o)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and id(df) in self.paths:
            _delete(self.spark, self.paths.pop(id(df))[1])


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for r in _all_rounds:
        if r.spark.sparkContext._jsc is not None:
            try:
                _delete(r.spark, r.at)
            except Exception as gone:  # the session may have ended before
                print(f"left behind: {r.at} ({type(gone).__name__})")


def build(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair; of several the largest weight counts."""
    return edges.groupBy("project", "src", "dst").agg(F.max("weight").alias("weight"))


def nodes(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    found = edges.select("project", F.col("src").alias("node")).union(edges.select("project", F.col("dst").alias("node")))
    return (found if files is None else found.union(files.select("project", F.col("path").alias("node")))).distinct()


def degrees(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    graph = build(edges)
    ends = graph.select("project", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(graph.select("project", F.col("dst").alias("node"), F.lit(0), F.lit(1)))
    if files is not None:
        ends = ends.union(files.select("project", F.col("path").alias("node"), F.lit(0), F.lit(0)))
    return ends.groupBy("project", "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def entry_points(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Nodes that no edge reaches."""
    return nodes(edges, files).join(edges.select("project", F.col("dst").alias("node")).distinct(), ["project", "node"], "left_anti")


def leaf_nodes(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Nodes that no edge leaves."""
    return nodes(edges, files).join(edges.select("project", F.col("src").alias("node")).distinct(), ["project", "node"], "left_anti")


def graph_stats(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per project: nodes, edges, mean degree (half the degree sum by nodes), largest degree, how many nodes have it, entries and leaves."""
    d = degrees(edges, files)
    per = d.groupBy("project").agg(
        F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"), (F.sum("degree").cast("double") / F.count(F.lit(1)) / 2).alias("average_degree"),
        F.max("degree").alias("max_degree"), F.count_if(F.col("in_degree") == 0).alias("entry_points"), F.count_if(F.col("out_degree") == 0).alias("leaf_nodes"),
    )
    top = most_connected(d).groupBy("project").agg(F.count(F.lit(1)).alias("most_connected"))
    return per.join(top, "project")


def most_connected(found: DataFrame) -> DataFrame:
    """Of degrees(), the nodes of each project that have its largest degree."""
    largest = found.groupBy("project").agg(F.max("degree").alias("max_degree"))
    return found.join(largest, "project").filter("degree = max_degree").select("project", "node", "degree")


#: Fronts of a search that are read one by one before they are written as one table.
FRONTS = 16


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _frontier(edges: DataFrame, start: DataFrame, steps: int | None = None) -> DataFrame:
    """(project, node, depth) by breadth: start(project, node) has depth 0. A round writes what it finds, and nothing else but every FRONTS rounds.

    With `steps`, what is more steps away is not asked for.
    """
    rounds = Rounds(edges.sparkSession)
    edge = rounds.keep(edges.select("project", F.col("src").alias("node"), "dst").distinct())
    front = rounds.keep(start.select("project", "node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = [front], 0
    while depth != steps:
        depth += 1
        known = _union([part.select("project", "node") for part in seen])
        new = front.join(edge, ["project", "node"]).select("project", F.col("dst").alias("node")).distinct().join(known, ["project", "node"], "left_anti")
        front = rounds.keep(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen.append(front)
        if len(seen) > FRONTS:
            seen = [rounds.keep(_union(seen), *seen[:-1])]
    return _union(seen)


def transitive_dependencies(edges: DataFrame, start: DataFrame, steps: int | None = None) -> DataFrame:
    """All that the start nodes need (or need within so many steps), themselves left out, with the number of steps."""
    return _frontier(edges, start, steps).filter("depth > 0")


def reverse_dependencies(edges: DataFrame, start: DataFrame, steps: int | None = None) -> DataFrame:
    """All that needs the start nodes, or needs them within so many steps."""
    return _frontier(edges.select("project", F.col("dst").alias("src"), F.col("src").alias("dst")), start, steps).filter("depth > 0")


def node_depths(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Steps from the nearest entry point; nodes that none reaches are left out. (The tool this follows takes the first path that its search finds.)"""
    return _frontier(edges, entry_points(edges, files))


def _without_ends(left: DataFrame) -> DataFrame:
    """Edges whose source has a way in and whose target has a way out; the others are on no cycle."""
    ins, outs = left.select("project", F.col("dst").alias("src")).distinct(), left.select("project", F.col("src").alias("dst")).distinct()
    return left.join(ins, ["project", "src"], "left_semi").join(outs, ["project", "dst"], "left_semi").select("project", "src", "dst")


def _passages(rounds: Rounds, left: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Nodes with one way in and one way out lie on passages: (project, node, before, after, least).

    before and after are the nodes at the passage's ends; a closed ring has none, and least is its smallest node. Ends are
    found by pointer jumping, in as many rounds as the longest passage has bits. The second table is the graph in which each
    passage is one edge. (None, None) if there is no such node.
    """
    into = left.groupBy("project", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("before"))
    out = left.groupBy("project", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("after"))
    inner = rounds.keep(into.join(out, ["project", "node"]).filter("i = 1 and o = 1").select("project", "node", "before", "after", F.col("node").alias("least")))
    n, span = inner.count(), 1
    if not n:
        return None, None
    jumps = inner
    while span <= n:
        ahead = jumps.select("project", F.col("node").alias("after"), F.col("after").alias("after2"), F.col("least").alias("least2"))
        back = jumps.select("project", F.col("node").alias("before"), F.col("before").alias("before2"))
        moved = jumps.join(ahead, ["project", "after"], "left").join(back, ["project", "before"], "left")
        new = moved.select("project", "node", F.coalesce("before2", "before").alias("before"), F.coalesce("after2", "after").alias("after"), F.least("least", "least2").alias("least"), F.col("after2").isNotNull().alias("on"))
        new = rounds.keep(new, None if jumps is inner else jumps)
        span *= 2
        more = not new.filter("on").isEmpty()
        jumps = new
        if not more:
            break
    own = inner.select("project", "node")
    # what still points at a node of a passage goes round in a ring
    ring = jumps.join(own.withColumnRenamed("node", "after"), ["project", "after"], "left_semi").select("project", "node").withColumn("ring", F.lit(True))
    none = F.lit(None).cast("string")
    ends = jumps.join(ring, ["project", "node"], "left")
    ends = rounds.keep(ends.select("project", "node", F.when(F.col("ring"), none).otherwise(F.col("before")).alias("before"), F.when(F.col("ring"), none).otherwise(F.col("after")).alias("after"), "least"), jumps)
    outer = left.join(own.withColumnRenamed("node", "src"), ["project", "src"], "left_anti").join(own.withColumnRenamed("node", "dst"), ["project", "dst"], "left_anti")
    short = ends.filter("before is not null and before <> after").select("project", F.col("before").alias("src"), F.col("after").alias("dst"))
    return ends, rounds.keep(outer.select("project", "src", "dst").union(short).distinct(), inner)


def strong_components(edges: DataFrame) -> DataFrame:
    """(project, node, component) of components with more than one node; the component is its smallest node. Edges to oneself do not count.

    Ends that lie on no cycle are cut off and passages are made one edge, in turn, until nothing changes; what is left is
    coloured. So chains and rings of any length take few rounds, and space is linear in the edges.
    """
    rounds = Rounds(edges.sparkSession)
    left = rounds.keep(edges.filter("src <> dst").select("project", "src", "dst").distinct())
    levels, n = [], left.count()
    while n:
        left = rounds.keep(_without_ends(left), left)
        ends, short = _passages(rounds, left)
        if ends is not None:
            levels.append(ends)
            rounds.drop(left)
            left = short
        now = left.count()
        if now == n:
            break
        n = now
    known = _coloured(rounds, left)
    for ends in reversed(levels):
        of = lambda name, end: known.select("project", F.col("node").alias(end), F.col("component").alias(name))  # noqa: B023, E731
        both = ends.join(of("c1", "before"), ["project", "before"], "left").join(of("c2", "after"), ["project", "after"], "left")
        one, two = F.coalesce("c1", "before"), F.coalesce("c2", "after")
        inside = both.filter(F.col("before").isNull() | (one == two)).select("project", "node", F.coalesce(one, "least").alias("component"), "before")
        # an end that was alone until now belongs to what leads back to it
        alone = inside.filter("before = component").select("project", F.col("before").alias("node"), "component").distinct()
        known = rounds.keep(known.unionByName(inside.drop("before")).unionByName(alone).distinct(), known)
    named = known.groupBy("project", "component").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return known.join(named, ["project", "component"]).select("project", "node", F.col("least").alias("component"))


def _coloured(rounds: Rounds, left: DataFrame) -> DataFrame:
    """Every node takes the smallest node that reaches it as its colour. What reaches a colour's root within the colour is the root's component; it is taken out, and the rest goes on."""
    found = []
    while not left.isEmpty():
        colour = rounds.keep(nodes(left).withColumn("colour", F.col("node")).withColumn("less", F.lit(True)))
        while True:
            # only nodes whose colour has changed offer it on
            offered = left.join(colour.filter("less").select("project", F.col("node").alias("src"), "colour"), ["project", "src"]).groupBy("project", F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
            less = F.coalesce(F.col("offer") < F.col("colour"), F.lit(False))
            moved = colour.join(offered, ["project", "node"], "left").select("project", "node", F.when(less, F.col("offer")).otherwise(F.col("colour")).alias("colour"), less.alias("less"))
            colour = rounds.keep(moved, colour)
            if colour.filter("less").isEmpty():
                break
        of = lambda end, name: colour.select("project", F.col("node").alias(end), F.col("colour").alias(name))  # noqa: B023, E731
        inside = left.join(of("src", "c1"), ["project", "src"]).join(of("dst", "c2"), ["project", "dst"]).filter("c1 = c2")
        roots = colour.filter("node = colour").select("project", "node")
        own = _frontier(inside.select("project", F.col("dst").alias("src"), F.col("src").alias("dst")), roots).select("project", "node")
        members = rounds.keep(own.join(colour, ["project", "node"]).select("project", "node", F.col("colour").alias("component")), colour)
        found.append(members)
        rest = left.join(members.select("project", F.col("node").alias("src")), ["project", "src"], "left_anti").join(members.select("project", F.col("node").alias("dst")), ["project", "dst"], "left_anti")
        left = rounds.keep(_without_ends(rest.select("project", "src", "dst")), left)
    empty = nodes(left).withColumn("component", F.col("node"))
    return rounds.keep(_union(found) if found else empty)


def cycle_severity(length: Column, affected: Column) -> Column:
    return (
        F.when((length >= 5) | (affected >= 10), "critical").when((length >= 4) | (affected >= 5), "high").when((length >= 3) | (affected >= 2), "medium").otherwise("low")
    )


def cycles(edges: DataFrame) -> DataFrame:
    """One row per strong component: members in order, length, edges into it from outside (affected), severity."""
    own = strong_components(edges)
    graph = build(edges)
    dst = own.select("project", F.col("node").alias("dst"), F.col("component").alias("c"))
    src = own.select("project", F.col("node").alias("src"), F.col("component").alias("s"))
    outside = graph.join(dst, ["project", "dst"]).join(src, ["project", "src"], "left").filter(F.col("s").isNull() | (F.col("s") != F.col("c")))
    affected = outside.groupBy("project", F.col("c").alias("component")).agg(F.count(F.lit(1)).alias("affected"))
    members = own.groupBy("project", "component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("length"))
    full = members.join(affected, ["project", "component"], "left").withColumn("affected", F.coalesce("affected", F.lit(0)))
    return full.withColumn("severity", cycle_severity(F.col("length"), F.col("affected")))


def weakest_links(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Per cycle the step between members that follow each other (in order, round to the first) with the least weight; a missing edge weighs 1."""
    steps = found.select("project", "component", "members", F.posexplode("members").alias("pos", "src"))
    steps = steps.withColumn("dst", F.get("members", (F.col("pos") + 1) % F.size("members")))
    weighed = steps.join(build(edges), ["project", "src", "dst"], "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    return weighed.groupBy("project", "component").agg(F.min(F.struct("weight", "pos", "src", "dst")).alias("w")).select("project", "component", "w.src", "w.dst", "w.weight")


def cycle_summary(found: DataFrame) -> DataFrame:
    """Per project: cycles by severity over all of them, and members affected."""
    kinds = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    return found.groupBy("project").agg(F.count(F.lit(1)).alias("total_cycles"), *kinds, F.sum("length").alias("affected_files"))


def top_cycles(found: DataFrame, most: int = 20) -> DataFrame:
    """The most severe cycles of each project, `most` of them (1 at least), numbered by seq."""
    if most < 1:
        raise ValueError("most is 1 at least")
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return first_in_order(found, "project", [rank, F.col("component")], "component", most, "seq")


# What is said of cycles by their severity, number and length, wherever there are any, and where there are none.
CRITICAL_CYCLES = " critical cycle(s) found. These should be addressed immediately as they can cause unpredictable behavior."
HIGH_CYCLES = " high-severity cycle(s) need attention. Consider refactoring these modules."
MANY_CYCLES = "Multiple cycles detected. Consider a broader architectural review to identify design issues."
SHORT_CYCLES = "Two-node cycles often indicate modules that should be merged or have a common dependency extracted."
LONG_CYCLES = "Larger cycles (4+ modules) suggest a need for dependency injection or event-based communication."
CYCLE_TIPS = (
    "General tips for breaking cycles:", "- Extract shared code into a separate utility module", "- Use dependency injection to invert dependencies", "- Implement interfaces/protocols to decouple modules",
    "- Consider using an event bus for cross-module communication", "- Apply the Dependency Inversion Principle",
)
NO_CYCLES = "No circular dependencies detected. Great job maintaining clean architecture!"


def cycle_recommendations(found: DataFrame) -> DataFrame:
    """Per project the advice that its cycles call for, in order."""
    per = found.groupBy("project").agg(
        F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "high").alias("h"), F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"), F.min("length").alias("shortest"))
    number = lambda c: F.col(c).cast("string")
    advice = F.array_compact(F.array(
        F.when(F.col("c") > 0, F.concat(F.lit("URGENT: "), number("c"), F.lit(CRITICAL_CYCLES))),
        F.when(F.col("h") > 0, F.concat(number("h"), F.lit(HIGH_CYCLES))),
        F.when(F.col("n") > 5, F.lit(MANY_CYCLES)),
        F.when(F.col("shortest") == 2, F.lit(SHORT_CYCLES)),
        F.when(F.col("longest") >= 4, F.lit(LONG_CYCLES)), *[F.lit(t) for t in CYCLE_TIPS],
    ))
    return per.select("project", advice.alias("recommendations"))


def topological_levels(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(project, node, level): every edge runs to a higher level. Nodes on a cycle, or behind one, have no level and are left out.

    A round writes the nodes of its level and how many ways into later nodes they open; nothing else is written again.
    """
    rounds = Rounds(edges.sparkSession)
    graph = rounds.keep(edges.select("project", "src", "dst").distinct())
    ways = rounds.keep(graph.groupBy("project", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ways")))
    front = rounds.keep(entry_points(edges, files).select("project", "node").withColumn("level", F.lit(0)))
    levels, opened, level = [front], [], 0
    while not front.isEmpty():
        level += 1
        now = front.join(graph.withColumnRenamed("src", "node"), ["project", "node"]).groupBy("project", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ways"))
        now = rounds.keep(now)
        opened.append(now)
        if len(opened) > FRONTS:
            opened = [rounds.keep(_union(opened).groupBy("project", "node").agg(F.sum("ways").alias("ways")), *opened[:-1])]
        so_far = _union(opened).join(now.select("project", "node"), ["project", "node"], "left_semi").groupBy("project", "node").agg(F.sum("ways").alias("open"))
        front = rounds.keep(so_far.join(ways, ["project", "node"]).filter("open = ways").select("project", "node", F.lit(level).alias("level")))
        levels.append(front)
        if len(levels) > FRONTS:
            levels = [rounds.keep(_union(levels[:-1]), *levels[:-1]), front]
    return _union(levels)


def is_acyclic(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per project whether all nodes have a level."""
    levels = topological_levels(edges, files)
    return nodes(edges, files).join(levels, ["project", "node"], "left").groupBy("project").agg(F.bool_and(F.col("level").isNotNull()).alias("is_dag"))


def all_paths(edges: DataFrame, start: str, end: str, most: int = 10) -> DataFrame:
    """Up to `most` paths without repeated nodes per project, shortest and then smallest first; from a node to itself there is the trivial one.

    Paths grow by a step a round, through nodes that lead to the end only; a project is done once it has enough.
    """
    if start == end:
        return nodes(edges).filter(F.col("node") == start).select("project", F.array("node").alias("path"))
    rounds = Rounds(edges.sparkSession)
    ends = nodes(edges).filter(F.col("node") == end)
    leads = rounds.keep(reverse_dependencies(edges, ends).select("project", F.col("node").alias("dst")).union(ends))
    graph = rounds.keep(build(edges).filter("src <> dst").join(leads, ["project", "dst"], "left_semi").select("project", "src", "dst"))
    front = rounds.keep(nodes(edges).filter(F.col("node") == start).select("project", F.array("node").alias("path")))
    found, order = front.limit(0), F.row_number().over(Window.partitionBy("project").orderBy(F.size("path"), "path"))
    while True:
        grown = front.withColumn("src", F.element_at("path", -1)).join(graph, ["project", "src"]).filter(~F.array_contains("path", F.col("dst")))
        grown = rounds.keep(grown.select("project", F.array_append("path", F.col("dst")).alias("path")), front)
        if grown.isEmpty():
            return found
        done = F.element_at("path", -1) == end
        found = rounds.keep(found.unionByName(grown.filter(done)).withColumn("rank", order).filter(F.col("rank") <= most).drop("rank"), found)
        enough = found.groupBy("project").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).select("project")
        front = rounds.keep(grown.filter(~done).join(enough, "project", "left_anti"), grown)


def instability(ca: Column, ce: Column) -> Column:
    return divided(ce, ca + ce)
