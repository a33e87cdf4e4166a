"""Packages of resolved lockfiles: splits, depths, parents, constraints, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import versions as V
from triagelake.functions.names import normalise

from . import version_ranks
from .graph import bfs, checkpointed


def split_forks(entries: DataFrame) -> DataFrame:
    """``fork_ordinal`` of each entry: 0 for the first of its name, which alone has edges."""
    w = Window.partitionBy("project_id", "name").orderBy("ordinal")
    return entries.withColumn("fork_ordinal", F.row_number().over(w) - 1)


def edges(entries: DataFrame) -> DataFrame:
    """``project_id, src, dst`` of the first entry of every name, both ends present."""
    first = split_forks(entries).filter("fork_ordinal = 0")
    out = first.select("project_id", F.col("name").alias("src"), F.explode("dependencies").alias("dst")).distinct()
    there = first.select("project_id", F.col("name").alias("dst"))
    return out.join(there, ["project_id", "dst"], "left_semi").select("project_id", "src", "dst")


def depths(entries: DataFrame, strategy: str = "auto") -> DataFrame:
    """``project_id, name, depth``: hops from the root, -1 out of its reach, 0 for all without a root; ``strategy`` as for ``bfs``."""
    first = split_forks(entries).filter("fork_ordinal = 0")
    roots = entries.filter("is_root").groupBy("project_id").agg(F.min_by("name", "ordinal").alias("root"))
    links = checkpointed(edges(entries)) if strategy == "auto" else edges(entries)
    found = bfs(links, roots.select("project_id", F.col("root").alias("node")), strategy)
    names = first.select("project_id", "name").join(roots, "project_id", "left").join(found.select("project_id", F.col("node").alias("name"), "dist"), ["project_id", "name"], "left")
    depth = F.when(F.col("root").isNull(), 0).otherwise(F.coalesce("dist", F.lit(-1)))
    return names.select("project_id", "name", depth.cast("int").alias("depth"))


def parents(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.groupBy("project_id", F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("parents"))


def one_metadata(metadata: DataFrame) -> DataFrame:
    """One row a (name, version); of several answers the greatest list counts, so order plays no part."""
    return metadata.groupBy("name", "version").agg(F.max("requires").alias("requires"))


def uses(edge_rows: DataFrame, packages: DataFrame) -> DataFrame:
    """``project_id, name, parent, parent_version``: what stands above each package.

    A parent that the lockfile holds at several versions is its first entry,
    which alone has edges.  The root is no parent.
    """
    given = packages if "fork_ordinal" in packages.columns else split_forks(packages)
    of = given.filter("fork_ordinal = 0 and not is_root").select("project_id", F.col("name").alias("src"), F.col("version").alias("parent_version"))
    return edge_rows.join(of, ["project_id", "src"]).select("project_id", F.col("dst").alias("name"), F.col("src").alias("parent"), "parent_version")


def constraints(asked: DataFrame, metadata: DataFrame) -> DataFrame:
    """``asked(name, parent, parent_version)`` with ``constraint``, once for each distinct row.

    What a release asks of a package is the same in every project.  Parents
    without metadata drop out; a constraint that asks for nothing is NULL.
    """
    meta = one_metadata(metadata).filter("requires is not null").select(F.col("name").alias("parent"), F.col("version").alias("parent_version"), "requires")
    rows = asked.select("name", "parent", "parent_version").distinct().join(meta, ["parent", "parent_version"])
    return rows.select("name", "parent", "parent_version", V.requirement_on(F.col("requires"), F.col("name")).alias("constraint"))


def parent_constraints(edge_rows: DataFrame, packages: DataFrame, metadata: DataFrame) -> DataFrame:
    """``project_id, name, parent, constraint``: what each parent's metadata asks of a package."""
    rows = uses(edge_rows, packages)
    return rows.join(constraints(rows, metadata), ["name", "parent", "parent_version"]).select("project_id", "name", "parent", "constraint")


def one_releases(releases: DataFrame) -> DataFrame:
    """One row a name: the releases that any answer lists, NULL if none was had."""
    rows = releases.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("versions")))).alias("versions"), F.count("versions").alias("n"))
    return rows.select("name", F.when(F.col("n") > 0, F.col("versions")).alias("versions"))


def parent_upgrades(blocked: DataFrame, releases: DataFrame, metadata: DataFrame) -> DataFrame:
    """``blocked(…, name, parent, target)`` with ``upgrade_to``: the parent's newest release, if that allows the target.

    A newest release that says nothing readable about the package counts as
    allowing it; unknown releases or metadata give NULL.
    """
    parents = blocked.select(F.col("parent").alias("name")).distinct()
    listed = releases.join(parents, "name", "left_semi").select("name", F.explode("versions").alias("v")).distinct()
    ordered = listed.withColumn("key", V.sort_key(F.col("v"))).filter("key is not null")
    latest = ordered.groupBy(F.col("name").alias("parent")).agg(F.max_by("v", F.struct("key", "v")).alias("latest"))
    of = one_metadata(metadata).select(F.col("name").alias("parent"), F.col("version").alias("latest"), "requires")
    rows = checkpointed(blocked.join(latest, "parent", "left").join(of, ["parent", "latest"], "left").withColumn("constraint", V.requirement_on(F.col("requires"), F.col("name"))))
    said = version_ranks.judged(rows.filter("constraint is not null"))
    fits = F.col("constraint").isNull() | F.coalesce(~F.col("readable") | F.col("allowed"), F.lit(False))
    rows = rows.join(said, ["target", "constraint"], "left")
    return rows.withColumn("upgrade_to", F.when(F.col("requires").isNotNull() & fits, F.col("latest"))).select(*blocked.columns, "upgrade_to")


def drift(locked: DataFrame, installed: DataFrame) -> DataFrame:
    """Locked packages that are missing, or installed at another version (compared as text)."""
    there = installed.select("project_id", normalise(F.col("name")).alias("name"), F.col("version").alias("installed"))
    rows = locked.select("project_id", normalise(F.col("name")).alias("name"), F.col("version").alias("locked")).join(there, ["project_id", "name"], "left")
    kind = F.when(F.col("installed").isNull(), "missing").when(F.col("installed") != F.col("locked"), "mismatch")
    return rows.withColumn("drift", kind).filter("drift is not null")


def import_names(records: DataFrame, top_level: DataFrame | None = None) -> DataFrame:
    """``distribution, import_name`` from RECORD rows, or from top_level.txt where RECORD names none.

    Distributions are normalised, so they join findings; ``project_id`` is kept
    where both tables have it.
    """
    keys = ["project_id", "distribution"] if "project_id" in records.columns else ["distribution"]
    records = records.withColumn("distribution", normalise(F.col("distribution")))
    field = F.regexp_extract("line", r'^"((?:[^"]|"")*)"', 1)  # a quoted field may hold commas and doubled quotes
    path = F.when(F.startswith("line", F.lit('"')), F.regexp_replace(field, '""', '"')).otherwise(F.regexp_extract("line", "^([^,]+)", 1))
    parts = F.split(path, "/")
    head = F.get(parts, F.lit(0))
    name = F.when(F.size(parts) > 1, head).when(path.endswith(".py"), F.regexp_replace(path, r"\.py$", ""))
    good = name.isNotNull() & ~head.rlike(r"\.(dist-info|data)$") & (head != "..") & (name != "")
    found = records.select(*keys, F.when(good, name).alias("import_name")).filter("import_name is not null").distinct()
    if top_level is None:
        return found
    top_level = top_level.withColumn("distribution", normalise(F.col("distribution")))
    spare = top_level.select(*keys, F.explode(F.split("text", r"\s+")).alias("import_name")).filter("import_name <> ''").distinct()
    return found.unionByName(spare.join(found.select(*keys).distinct(), keys, "left_anti"))
