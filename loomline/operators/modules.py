"""Modules in groups: coupling of each module, cohesion and coupling of groups.

files(project, path) with paths within the project; edges(project, src, dst), not deduplicated, as lists of imports are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.jsmath import divided, first_in_order
from .churn import directory_of
from .graph import instability

MARKERS = ("package.json", "__init__.py", "setup.py")


def coupling(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: imports of it (Ca) and by it (Ce), instability, abstractness by name, distance from the main sequence."""
    into = edges.groupBy("project", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("ca"))
    out = edges.groupBy("project", F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("ce"))
    full = files.select("project", "path").join(into, ["project", "path"], "left").join(out, ["project", "path"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ca", "ce")})
    abstract = F.when(F.col("path").rlike(r"(?i)(?<![A-Za-z0-9_])(interface|abstract|types?|contracts?)(?![A-Za-z0-9_])"), 1).otherwise(0)
    rated = full.withColumns({"instability": instability(F.col("ca"), F.col("ce")), "abstractness": abstract})
    return rated.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))


def group_key(path: Column, by: str, depth: int = 2) -> Column:
    """Directory (its first parts; '.' at the top), feature or layer of a path."""
    if by == "directory":
        return F.array_join(F.slice(F.split(directory_of(path), "/"), 1, depth), "/")
    slashed = F.concat(F.lit("/"), path)
    if by == "feature":
        return paths.first_of(slashed, paths.FEATURES, "other")
    if by == "layer":
        return paths.first_of(slashed, paths.GROUP_LAYERS, "unknown")
    raise ValueError("by is directory, package, feature or layer")


def package_of(files: DataFrame, all_files: DataFrame) -> DataFrame:
    """files with group: the nearest directory above that holds a package marker, or root."""
    marked = all_files.filter(paths.short_name(F.col("path")).isin(*MARKERS)).select("project", directory_of(F.col("path")).alias("dir")).distinct()
    parts = F.split(directory_of(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = files.select("project", "path", F.explode(F.array_union(above, F.array(F.lit(".")))).alias("dir")).join(marked, ["project", "dir"])
    nearest = tried.groupBy("project", "path").agg(F.max(F.struct(F.when(F.col("dir") == ".", 0).otherwise(F.length("dir")).alias("n"), "dir"))["dir"].alias("dir"))
    return files.join(nearest, ["project", "path"], "left").withColumn("group", F.when(F.col("dir").isNull() | (F.col("dir") == "."), "root").otherwise(F.col("dir"))).drop("dir")


def grouped(files: DataFrame, by: str = "directory", depth: int = 2) -> DataFrame:
    return package_of(files, files) if by == "package" else files.withColumn("group", group_key(F.col("path"), by, depth))


def group_metrics(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members(project, path, group) to one row per group: size, internal and external imports, cohesion and coupling."""
    of = members.select("project", "path", "group")
    src = of.select("project", F.col("path").alias("src"), F.col("group").alias("g1"))
    dst = of.select("project", F.col("path").alias("dst"), F.col("group").alias("g2"))
    linked = edges.select("project", "src", "dst").join(src, ["project", "src"]).join(dst, ["project", "dst"])
    ends = linked.select("project", F.explode(F.when(F.col("g1") == F.col("g2"), F.array(F.struct(F.col("g1").alias("group"), F.lit(1).alias("i"), F.lit(0).alias("e")))).otherwise(
        F.array(F.struct(F.col("g1").alias("group"), F.lit(0).alias("i"), F.lit(1).alias("e")), F.struct(F.col("g2").alias("group"), F.lit(0).alias("i"), F.lit(1).alias("e"))))).alias("x"))
    counts = ends.groupBy("project", "x.group").agg(F.sum("x.i").alias("internal"), F.sum("x.e").alias("external"))
    sizes = of.groupBy("project", "group").agg(F.count(F.lit(1)).alias("size"))
    total = of.groupBy("project").agg(F.count(F.lit(1)).alias("all"))
    full = sizes.join(total, "project").join(counts, ["project", "group"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("internal", "external")})
    n, others = F.col("size"), F.col("all") - F.col("size")
    cohesion = F.when(n <= 1, F.lit(1.0)).otherwise(divided(F.col("internal"), n * (n - 1)))
    ties = F.when(others == 0, F.lit(0.0)).otherwise(F.col("external").cast("double") / (n * others + 1))
    return full.select("project", "group", "size", "internal", "external", cohesion.alias("cohesion"), ties.alias("coupling"))


def overall_cohesion(groups: DataFrame) -> DataFrame:
    """Per project the mean cohesion, weighed by size."""
    return groups.groupBy("project").agg(F.count(F.lit(1)).alias("groups"), (F.sum(F.col("cohesion") * F.col("size")) / F.sum("size")).alias("cohesion_score"))


def group_links(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports between different groups, counted."""
    of = members.select("project", "path", "group")
    src = of.select("project", F.col("path").alias("src"), F.col("group").alias("from_group"))
    dst = of.select("project", F.col("path").alias("dst"), F.col("group").alias("to_group"))
    return edges.select("project", "src", "dst").join(src, ["project", "src"]).join(dst, ["project", "dst"]).filter("from_group <> to_group").groupBy("project", "from_group", "to_group").agg(F.count(F.lit(1)).alias("imports"))


def high_coupling(rated: DataFrame, most: int = 10) -> DataFrame:
    """Per project the files with most imports in and out, ties by path."""
    total = F.col("ca") + F.col("ce")
    return first_in_order(rated.withColumn("total", total), "project", [F.col("total").desc(), F.col("path")], "path", most)


def overview_layers(files: DataFrame) -> DataFrame:
    """Files by architectural layer; those that fit none are Other."""
    layer = paths.first_of(F.concat(F.lit("/"), F.col("path")), paths.OVERVIEW_LAYERS, "Other")
    return files.groupBy("project", layer.alias("layer")).agg(F.count(F.lit(1)).alias("modules"))


def entry_files(files: DataFrame) -> DataFrame:
    return files.filter(paths.any_of(F.concat(F.lit("/"), F.col("path")), paths.ENTRY_POINTS)).select("project", "path")


def architecture_style(files: DataFrame) -> DataFrame:
    """Per project the first style that its layers and folders fit."""
    p = F.concat(F.lit("/"), F.col("path"))
    has = lambda name: F.bool_or(paths.first_of(p, paths.OVERVIEW_LAYERS, "Other") == name)
    folder = lambda word: F.bool_or(p.rlike(f"(?i)/{word}s?/"))
    seen = files.groupBy("project").agg(
        has("Presentation").alias("presentation"), has("Business Logic").alias("business"), has("Data Access").alias("data"), has("Infrastructure").alias("infrastructure"),
        *[folder(w).alias(w) for w in ("component", "page", "hook", "feature", "module")], F.countDistinct(paths.first_of(p, paths.OVERVIEW_LAYERS, "Other")).alias("layers"),
    )
    style = (
        F.when(F.col("feature") | F.col("module"), "Feature-Sliced / Modular Architecture").when(F.col("component") & F.col("page") & F.col("hook"), "Component-Based Frontend Architecture")
        .when(F.col("presentation") & F.col("business") & F.col("data") & F.col("infrastructure"), "Clean Architecture / Hexagonal").when(F.col("presentation") & F.col("business") & F.col("data"), "Layered Architecture (3-tier)")
        .when(F.col("presentation") & F.col("data"), "MVC-like Architecture").when(F.col("layers") == 1, "Flat / Monolithic Structure").otherwise("Mixed / Custom Architecture")
    )
    return seen.select("project", style.alias("style"))


def external_dependencies(dependencies: DataFrame) -> DataFrame:
    """dependencies(project, src, type, package) to one row per external package: users, uses, category, and rank by uses within the project (ties by name)."""
    own = dependencies.filter("type = 'external'")
    found = own.groupBy("project", "package").agg(F.countDistinct("src").alias("used_by"), F.count(F.lit(1)).alias("usage_count")).withColumn("category", paths.dependency_category(F.col("package")))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.col("usage_count").desc(), "package")))
