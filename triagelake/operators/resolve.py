"""Import tables, name resolution and call graphs as joins over parsed modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.names import prefixes

from . import pysource
from .graph import Fans, checkpointed

EDGE_RANK = {"calls": 0, "inherits": 1, "alias": 2, "imports": 3}
KEYS = ["project_id", "module"]


def _package(module: Column, level: Column, is_package: Column) -> Column:
    """Package that a relative import starts from; NULL beyond the root."""
    parts = F.split(module, r"\.")
    keep = F.size(parts) - level + F.when(is_package, 1).otherwise(0)
    return F.when(keep > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(1))), "."))


def _imports(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("project_id", "origin", F.col("fqn").alias("module"), "is_package", F.posexplode("imports").alias("pos", "i"))
    rows = rows.select("project_id", "origin", "module", "is_package", "pos", F.col("i.module").alias("src"), "i.name", "i.alias", "i.level")
    package = _package(F.col("module"), F.col("level"), F.col("is_package"))
    prefix = F.when(F.col("level") > 0, F.when(F.col("src").isNull(), package).otherwise(F.concat(package, F.lit("."), F.col("src")))).otherwise(F.coalesce("src", F.lit("")))
    return rows.withColumn("prefix", prefix).filter("prefix is not null")


def import_table(parsed: DataFrame) -> DataFrame:
    """``project_id, origin, module, local, target``; the last binding of a name counts."""
    plain = F.col("src").isNull() & (F.col("level") == 0)
    root = F.substring_index("name", ".", 1)
    local = F.coalesce("alias", F.when(plain, root).otherwise(F.col("name")))
    target = F.when(plain, F.when(F.col("alias").isNotNull(), F.col("name")).otherwise(root)).otherwise(F.concat("prefix", F.when(F.col("prefix") == "", "").otherwise("."), "name"))
    rows = _imports(parsed).filter("name <> '*'").select("project_id", "origin", "module", "pos", local.alias("local"), target.alias("target"))
    return rows.groupBy("project_id", "origin", "module", "local").agg(F.max_by("target", "pos").alias("target"))


def stars(parsed: DataFrame) -> DataFrame:
    """``project_id, origin, module, source, pos`` of star imports."""
    return _imports(parsed).filter("name = '*' and prefix <> ''").select("project_id", "origin", "module", F.col("prefix").alias("source"), "pos")


def owners(targets: DataFrame, modules: DataFrame, column: str = "target") -> DataFrame:
    """Longest module that is a prefix of each distinct target: ``project_id, target, owner``."""
    names = targets.select("project_id", F.col(column).alias("target")).distinct()
    cut = names.select("project_id", "target", F.explode(prefixes(F.col("target"))).alias("owner"))
    found = cut.join(modules.select("project_id", F.col("fqn").alias("owner")).distinct(), ["project_id", "owner"])
    return found.groupBy("project_id", "target").agg(F.max_by("owner", F.length("owner")).alias("owner"))


def exact(sites: DataFrame, imports: DataFrame, defs: DataFrame) -> DataFrame:
    """Sites ``(project_id, origin, module, caller, name)`` with ``exact`` (NULL for none) and ``tail``.

    In order: an imported head, a definition of the module, a definition of
    that very name.
    """
    known = defs.select("project_id", "fqn").distinct()
    head, rest = F.substring_index("name", ".", 1), F.expr("substring(name, length(substring_index(name, '.', 1)) + 1)")
    rows = sites.withColumn("head", head).join(imports.select(*KEYS, F.col("local").alias("head"), F.col("target").alias("imported")), [*KEYS, "head"], "left")
    rows = rows.withColumn("imported", F.concat("imported", rest))
    mine = known.select("project_id", F.col("fqn").alias("here"), F.lit(True).alias("is_here"))
    rows = rows.withColumn("here", F.concat("module", F.lit("."), "name")).join(mine, ["project_id", "here"], "left")
    rows = rows.join(known.select("project_id", F.col("fqn").alias("name"), F.lit(True).alias("is_named")), ["project_id", "name"], "left")
    found = F.coalesce("imported", F.when(F.col("is_here"), F.col("here")), F.when(F.col("is_named"), F.col("name")))
    return rows.withColumn("exact", found).select(*sites.columns, "exact", F.element_at(F.split("name", r"\."), -1).alias("tail"))


def resolve(sites: DataFrame, imports: DataFrame, defs: DataFrame) -> DataFrame:
    """Sites with their targets: the exact one, else every other definition with the same last part (a guess).

    A site without any target keeps a NULL.  The last step makes a row for each
    pair of a site and a definition of its tail; ``build_fans`` keeps the two
    apart, for tails that thousands hold.
    """
    rows = checkpointed(exact(sites, imports, defs))
    tails = defs.select("project_id", "tail", F.col("fqn").alias("guess")).distinct()
    open_rows = rows.filter("exact is null")
    guessed = open_rows.join(tails, ["project_id", "tail"], "left").withColumn("guess", F.when(F.col("guess") != F.col("caller"), F.col("guess")))
    sure = rows.filter("exact is not null").select(*sites.columns, F.col("exact").alias("target"), F.lit(False).alias("speculative"))
    # a caller that is its own only candidate has no target; with others its own row goes
    n = F.count("guess").over(_by(sites.columns))
    guessed = guessed.withColumn("n", n).withColumn("i", F.row_number().over(_by(sites.columns).orderBy("guess"))).filter("guess is not null or (n = 0 and i = 1)")
    return sure.unionAll(guessed.select(*sites.columns, F.col("guess").alias("target"), F.col("guess").isNotNull().alias("speculative")))


def _by(columns: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair: a guess only if all sightings are; the strongest kind."""
    table = F.create_map(*[F.lit(x) for kv in EDGE_RANK.items() for x in kv])
    rank = F.coalesce(F.try_element_at(table, F.col("kind")), F.lit(9))
    return edges.groupBy("project_id", "src", "dst").agg(F.min_by("kind", rank).alias("kind"), F.bool_and("speculative").alias("speculative"))


def _linked(good: DataFrame, defs: DataFrame, imports: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Edges of imports, aliases and starred names, and imported names that no module owns."""
    linked = checkpointed(imports.join(owners(imports, good), ["project_id", "target"], "left"))
    out = [linked.filter("owner is not null and owner <> module").select("project_id", F.col("module").alias("src"), F.col("owner").alias("dst"), F.lit("imports").alias("kind"), F.lit(False).alias("speculative"))]
    alias = F.concat("module", F.lit("."), "local")
    out.append(imports.filter("origin = 'dependency'").filter(alias != F.col("target")).select("project_id", alias.alias("src"), F.col("target").alias("dst"), F.lit("alias").alias("kind"), F.lit(False).alias("speculative")))
    public = defs.filter("kind <> 'module'").select("project_id", F.col("fqn").alias("dst"), "tail", F.expr("substring(fqn, 1, length(fqn) - length(tail) - 1)").alias("source")).filter("not startswith(tail, '_')")
    facade = stars(good).filter("origin = 'dependency'").join(public, ["project_id", "source"]).withColumn("src", F.concat("module", F.lit("."), "tail"))
    out.append(facade.filter("src <> dst").select("project_id", "src", "dst", F.lit("alias").alias("kind"), F.lit(False).alias("speculative")))
    return out, linked.filter("owner is null").select("project_id", F.col("target").alias("fqn"))


def _nodes(defs: DataFrame, edges: DataFrame, lone: DataFrame, blind: DataFrame) -> DataFrame:
    """Defined nodes and those that only edges or imports name; ``blind(project_id, fqn)`` marks callers of a dotted name that leads nowhere."""
    last = F.struct(F.col("origin") == "dependency", "line", "kind")  # a name defined again is what its last definition says
    own = defs.groupBy("project_id", "fqn").agg(F.max_by("kind", last).alias("kind"), F.max_by("origin", last).alias("origin"), F.bool_or("dynamic").alias("dynamic"))
    ends = edges.select("project_id", F.explode(F.array("src", "dst")).alias("fqn")).unionAll(lone).distinct().join(own, ["project_id", "fqn"], "left_anti")
    outer = ends.select("project_id", "fqn", F.lit("external").alias("kind"), F.lit("absent").alias("origin"), F.lit(False).alias("dynamic"))
    marks = blind.select("project_id", "fqn", F.lit(True).alias("unresolved")).distinct()
    nodes = own.unionByName(outer).join(marks, ["project_id", "fqn"], "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(False)))
    return checkpointed(nodes)


def _facts(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed modules, their definitions and import tables, each written once for the many joins that read them."""
    good = checkpointed(parsed.filter("parse_ok"))
    return good, checkpointed(pysource.definitions(good)), checkpointed(import_table(good))


def _sites(good: DataFrame) -> DataFrame:
    """Distinct calls and bases, by ``kind``."""
    calls, bases = pysource.calls(good).drop("line", "pos"), pysource.bases(good)
    return bases.withColumn("kind", F.lit("inherits")).unionByName(calls.withColumn("kind", F.lit("calls"))).distinct()


def _merged(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Merged edges, and definitions, lone names and blind callers for the nodes."""
    good, defs, imports = _facts(parsed)
    out, lone = _linked(good, defs, imports)
    known = defs.select("project_id", F.col("fqn").alias("dst")).distinct()
    found = checkpointed(resolve(_sites(good), imports, defs))  # edges and blind callers read it
    links = found.filter("target is not null").select("project_id", F.col("caller").alias("src"), F.col("target").alias("dst"), "kind", "speculative")
    out += [links.filter("kind = 'inherits'").join(known, ["project_id", "dst"], "left_semi").select(links.columns), links.filter("kind = 'calls'")]
    blind = found.filter("kind = 'calls' and target is null and contains(name, '.') and origin = 'project'").select("project_id", F.col("caller").alias("fqn"))
    return checkpointed(merge_edges(reduce(DataFrame.unionAll, out))), defs, lone, blind


def build(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all modules, project and dependency ones.

    nodes: project_id, fqn, kind, origin, dynamic, unresolved
    edges: project_id, src, dst, kind, speculative
    """
    edges, *rest = _merged(parsed)
    return _nodes(rest[0], edges, *rest[1:]), edges


def build_edges(parsed: DataFrame) -> DataFrame:
    """The edges of ``build``, for walks that need no nodes."""
    return _merged(parsed)[0]


def build_fans(parsed: DataFrame) -> tuple[DataFrame, DataFrame, Fans]:
    """``build`` whose guesses are not multiplied out: nodes, sure edges, and the fans that ``bfs`` walks.

    Callers (project_id, src, tail) and holders (project_id, tail, dst) of the
    tails that calls and bases could not resolve: rows grow with the sum of
    callers and definitions of a tail, not with their product.
    """
    good, defs, imports = _facts(parsed)
    out, lone = _linked(good, defs, imports)
    known = defs.select("project_id", F.col("fqn").alias("dst")).distinct()
    rows = checkpointed(exact(_sites(good), imports, defs))
    sure = rows.filter("exact is not null").select("project_id", F.col("caller").alias("src"), F.col("exact").alias("dst"), "kind", F.lit(False).alias("speculative"))
    out += [sure.filter("kind = 'inherits'").join(known, ["project_id", "dst"], "left_semi").select(sure.columns), sure.filter("kind = 'calls'")]
    tails = defs.select("project_id", "tail", "fqn").distinct()
    size = tails.groupBy("project_id", "tail").agg(F.count(F.lit(1)).alias("n"))
    mine = tails.select("project_id", "tail", F.col("fqn").alias("caller"), F.lit(1).alias("own"))
    loose = rows.filter("exact is null").join(size, ["project_id", "tail"], "left").join(mine, ["project_id", "tail", "caller"], "left").withColumn("others", F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0)))
    callers = checkpointed(loose.filter("others > 0").select("project_id", F.col("caller").alias("src"), "tail").distinct())
    holders = checkpointed(tails.join(callers.select("project_id", "tail").distinct(), ["project_id", "tail"], "left_semi").select("project_id", "tail", F.col("fqn").alias("dst")))
    blind = loose.filter("kind = 'calls' and others = 0 and contains(name, '.') and origin = 'project'").select("project_id", F.col("caller").alias("fqn"))
    edges = checkpointed(merge_edges(reduce(DataFrame.unionAll, out)))
    return _nodes(defs, edges, lone, blind), edges, (callers, holders)


def boundary(nodes: DataFrame) -> DataFrame:
    """``project_id, fqn`` of the nodes that only edges or imports name: where a graph ends."""
    return nodes.filter("kind = 'external'").select("project_id", "fqn")


def definition_index(nodes: DataFrame) -> DataFrame:
    """``project_id, tail, fqn, origin`` of all defined nodes of a finished graph, project and dependency ones."""
    return nodes.filter("kind <> 'external'").select("project_id", F.substring_index("fqn", ".", -1).alias("tail"), "fqn", "origin")


def namesakes(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``asked(project_id, node)`` that the graph doesn't define, with ``tails``: how many definitions of the project have its last name.

    Any module's, of either origin; 0 for none, also for NULL keys.  Equal rows
    count once.  Definitions are counted by tail before they meet the nodes, so
    rows grow with the sum of both and not with their pairs.
    """
    there = definition_index(nodes).select("project_id", "tail", "fqn")
    size = there.distinct().groupBy("project_id", "tail").agg(F.count(F.lit(1)).alias("tails"))
    outside = asked.select("project_id", "node").distinct().join(there.select("project_id", F.col("fqn").alias("node")), ["project_id", "node"], "left_anti")
    rows = outside.withColumn("tail", F.substring_index("node", ".", -1)).join(size, ["project_id", "tail"], "left")
    return rows.select("project_id", "node", F.coalesce("tails", F.lit(0)).cast("long").alias("tails"))


def successors(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """``asked(project_id, node)`` with each ``successor``: one row for each, and one with NULL where there is none.

    Rows, not lists, so a hub of any size is many rows and no large one.  A
    node that the graph doesn't know has no successor; equal rows count once.
    """
    ahead = edges.select("project_id", F.col("src").alias("node"), F.col("dst").alias("successor")).distinct()
    return asked.select("project_id", "node").distinct().join(ahead, ["project_id", "node"], "left")


def dynamic_flags(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``asked(project_id, node)`` with ``dynamic``: whether it holds what can't be followed; false for unknown nodes."""
    marks = nodes.filter("dynamic").select("project_id", F.col("fqn").alias("node"), F.lit(True).alias("dynamic")).distinct()
    return asked.select("project_id", "node").distinct().join(marks, ["project_id", "node"], "left").withColumn("dynamic", F.coalesce("dynamic", F.lit(False)))


def graph_summary(nodes: DataFrame, edges: DataFrame, parsed: DataFrame) -> DataFrame:
    n = nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind") == "external").alias("external"), F.count_if("dynamic").alias("dynamic"))
    e = edges.groupBy("project_id").agg(F.count(F.lit(1)).alias("edges"))
    u = parsed.groupBy("project_id").agg(F.count_if(~F.col("parse_ok")).alias("unparsed"))
    out = u.join(n, "project_id", "left").join(e, "project_id", "left")
    return checkpointed(out.select("project_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("nodes", "edges", "external", "dynamic", "unparsed"))))
