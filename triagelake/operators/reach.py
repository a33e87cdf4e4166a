"""Expansion into dependencies, symbol verification, and reachability verdicts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.names import module_splits

from . import pysource
from .graph import Fans, bfs, checkpointed, evidence
from .parse_store import ParseStore, listed
from .resolve import import_table, owners, resolve, stars

BUDGET = 2000
REEXPORT_DEPTH = 3
VERDICTS = ("reachable", "unknown", "not_reachable")


def leads(parsed: DataFrame) -> DataFrame:
    """``project_id, module, target``: names that a module imports, calls through imports, or re-exports by a star."""
    good = parsed.filter("parse_ok")
    imports = import_table(good)
    sites = pysource.calls(good).drop("line", "pos").unionByName(pysource.bases(good)).distinct()
    through = sites.withColumn("local", F.substring_index("name", ".", 1)).join(imports.drop("origin"), ["project_id", "module", "local"])
    beyond = F.concat("target", F.expr("substring(name, length(local) + 1)"))
    return imports.select("project_id", "module", "target").unionAll(through.select("project_id", "module", beyond)).unionAll(stars(good).select("project_id", "module", "source")).distinct()


def _within(rows: DataFrame, project: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Reached modules (with ``dist`` and ``parse_ok``) that the budget keeps, and a status row for each project."""
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("parse_ok").desc(), "dist", "fqn")))
    kept = rows.filter((F.col("rank") <= budget) | ~F.col("parse_ok"))
    counts = rows.groupBy("project_id").agg(F.count_if("parse_ok").alias("n"), F.count_if(~F.col("parse_ok")).alias("unparsed"))
    n, unparsed = F.coalesce("n", F.lit(0)), F.coalesce("unparsed", F.lit(0))
    status = project.select("project_id").distinct().join(counts, "project_id", "left")
    return kept.drop("dist", "rank"), status.select("project_id", F.least(n, F.lit(budget)).cast("long").alias("modules_parsed"), unparsed.cast("long").alias("unparsed"), ((n <= budget) & (unparsed == 0)).alias("complete"))


def expand(project: DataFrame, installed: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Dependency modules that the project's names lead to, and a status row for each project.

    Both arguments are parsed modules.  A module leads on to the owners of all
    names that it ``leads`` to; the result is the fixpoint, nearest modules
    first while the budget lasts (then by name).  ``status``: modules_parsed,
    unparsed, complete.
    """
    project, installed = checkpointed(project), checkpointed(installed)
    names = leads(project.unionByName(installed))
    owned = owners(names, installed)
    links = checkpointed(names.join(owned, ["project_id", "target"]).select("project_id", F.concat("module").alias("src"), F.col("owner").alias("dst")).filter("src <> dst").distinct())
    starts = project.filter("parse_ok").select("project_id", F.col("fqn").alias("node")).distinct()
    met = bfs(links, starts, "auto").filter("dist > 0").select("project_id", F.col("node").alias("fqn"), "dist")
    return _within(installed.join(met, ["project_id", "fqn"]), project, budget)


def expand_on_demand(project: DataFrame, installed: DataFrame, budget: int = BUDGET, store: ParseStore | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``expand`` from sources: only modules at the frontier are parsed, equal ones once for all projects.

    Both arguments are modules with ``source``.  Each round parses the new
    contents of all frontiers, finds the names that a content leads to once,
    and meets every project's installed modules by joins.  A project whose
    budget is spent goes no further; what it would still have met is neither
    parsed nor counted.  Returns the project's parsed modules, the parsed
    dependency modules, and the status.  Tables may be empty; a project without
    modules has no status; of modules with one name the least digest counts.
    """
    store = store or ParseStore.of(project, installed)
    there = checkpointed(listed(installed))
    content = F.concat_ws(":", "digest", F.col("is_package").cast("string"), "fqn").alias("content")
    front = checkpointed(listed(project).select("*", content, F.lit(0).alias("dist")))
    levels, spent = [], None
    while True:
        distinct = front.select("fqn", "is_package", "digest", "content").distinct()
        facts = checkpointed(store.parsed(distinct).withColumnRenamed("content", "project_id").withColumn("origin", F.lit("")))
        names = checkpointed(leads(facts).select(F.col("project_id").alias("content"), "target"))
        level = checkpointed(front.join(facts.select(F.col("project_id").alias("content"), "parse_ok"), "content"))
        levels.append(level)
        every = reduce(DataFrame.unionAll, levels)
        spent = every.filter("dist > 0 and parse_ok").groupBy("project_id").count().filter(F.col("count") > budget)
        ahead = level.filter("parse_ok").join(spent, "project_id", "left_anti").select("project_id", "content", F.col("fqn").alias("module")).join(names, "content").select("project_id", "module", "target").distinct()
        met = ahead.join(owners(ahead, there), ["project_id", "target"]).filter("owner <> module").select("project_id", F.col("owner").alias("fqn")).distinct()
        fresh = met.join(every.select("project_id", "fqn"), ["project_id", "fqn"], "left_anti").join(there, ["project_id", "fqn"])
        front = checkpointed(fresh.select("project_id", "fqn", "is_package", "digest", content, F.lit(len(levels)).alias("dist")))
        if front.isEmpty():
            break
    rows = reduce(DataFrame.unionAll, levels[1:]) if len(levels) > 1 else levels[0].limit(0)
    kept, status = _within(rows.drop("content"), project, budget)
    parsed = lambda df, origin: store.parsed(df.select("project_id", "fqn", "is_package", "digest")).withColumn("origin", F.lit(origin))
    return parsed(levels[0], "project"), parsed(kept, "dependency"), status


Lookup = Callable[[DataFrame], DataFrame]


def stored_modules(listing: DataFrame, store: ParseStore) -> Lookup:
    """Parsed modules for wanted names, parsed on demand: ``listing(project_id, fqn, is_package, digest)``."""
    return lambda wanted: store.parsed(listing.join(wanted, ["project_id", "fqn"], "left_semi")).withColumn("origin", F.lit("dependency"))


def verify_symbols(symbols: DataFrame, installed: DataFrame | Lookup, depth: int = REEXPORT_DEPTH) -> DataFrame:
    """``symbols(project_id, symbol)`` with ``resolved``: where it is defined, NULL if it isn't.

    A symbol is tried as attribute of every module that its name may hold,
    longest module first: a definition of that name, then what an import or
    (in order) the stars of the module re-export, then the only function or
    method nested there that ends so.  Re-exports are followed ``depth`` times.

    Down, each round joins symbols that no earlier round saw with the modules,
    imports and stars of their project; up, each round joins the re-exports
    with the answers so far.  Work and tables grow with distinct symbols, not
    with paths or modules; a project may be of any size.  ``installed`` is
    parsed modules, or a function that gives those of ``wanted(project_id,
    fqn)``.  A name that a longer path met first at its end is still followed
    from the shorter one.  Empty tables give no row.
    """
    lookup = installed if callable(installed) else lambda wanted: installed.join(wanted, ["project_id", "fqn"], "left_semi")
    new = checkpointed(symbols.select("project_id", "symbol").distinct())
    seen, local, onward = [new], [], []
    rank = lambda kind, pos: F.struct(F.col("i").alias("i"), F.lit(kind).alias("kind"), pos.cast("int").alias("pos"))
    for left in range(depth, -1, -1):
        splits = new.select("project_id", "symbol", F.posexplode(module_splits(F.col("symbol"))).alias("i", "s")).select("project_id", "symbol", "i", "s.module", "s.attribute")
        good = checkpointed(lookup(splits.select("project_id", F.col("module").alias("fqn")).distinct()).filter("parse_ok"))
        live = checkpointed(splits.join(good.select("project_id", F.col("fqn").alias("module")).distinct(), ["project_id", "module"]))
        last = pysource.definitions(good).groupBy("project_id", "module", "fqn", "tail").agg(F.max_by("kind", "line").alias("kind"))
        exact = live.join(last.select("project_id", "module", F.col("fqn").alias("symbol")), ["project_id", "module", "symbol"])
        local.append(exact.select("project_id", "symbol", rank(0, F.lit(0)).alias("rank"), F.col("symbol").alias("value")))
        inner = live.withColumn("tail", F.substring_index("attribute", ".", -1)).join(last.filter("kind in ('method', 'function')"), ["project_id", "module", "tail"]).filter("endswith(fqn, concat('.', attribute))")
        only = inner.groupBy("project_id", "symbol", "i").agg(F.min("fqn").alias("value"), F.count(F.lit(1)).alias("n")).filter("n = 1")
        local.append(only.select("project_id", "symbol", rank(3, F.lit(0)).alias("rank"), "value"))
        if left == 0:
            break
        bound = live.withColumn("local", F.substring_index("attribute", ".", 1)).join(import_table(good).drop("origin"), ["project_id", "module", "local"])
        wide = live.join(stars(good).select("project_id", "module", "source", F.col("pos").alias("at")), ["project_id", "module"])
        steps = bound.select("project_id", "symbol", rank(1, F.lit(0)).alias("rank"), F.concat("target", F.expr("substring(attribute, length(local) + 1)")).alias("child"))
        steps = checkpointed(steps.unionAll(wide.select("project_id", "symbol", rank(2, F.col("at")), F.concat("source", F.lit("."), "attribute"))))
        onward.append(steps)
        ahead = steps.select("project_id", F.col("child").alias("symbol")).distinct()
        new = checkpointed(ahead.join(reduce(DataFrame.unionAll, seen), ["project_id", "symbol"], "left_anti"))
        if new.isEmpty():
            break
        seen.append(new)
    found = checkpointed(reduce(DataFrame.unionAll, local))
    best = lambda rows: rows.groupBy("project_id", "symbol").agg(F.min_by("value", "rank").alias("value"))
    known, steps = best(found), reduce(DataFrame.unionAll, onward) if onward else None
    for _ in range(depth if steps is not None else 0):
        led = steps.join(known.withColumnRenamed("symbol", "child"), ["project_id", "child"]).select("project_id", "symbol", "rank", "value")
        known = checkpointed(best(found.unionAll(led)))
    return checkpointed(symbols.select("project_id", "symbol").distinct().join(known.withColumnRenamed("value", "resolved"), ["project_id", "symbol"], "left"))


def verification(asked: DataFrame, resolved: DataFrame) -> DataFrame:
    """``project_id, finding_id, verified, dropped, usable``: what the symbols of each finding came to.

    ``asked(project_id, finding_id, symbol)``, ``resolved(project_id, symbol,
    resolved)`` as ``verify_symbols`` gives it.  ``verified`` holds the places
    of definition, ``dropped`` the symbols that have none, both in order and
    once.  Nothing verified is not evidence: then ``usable`` is false, and the
    package's verdict stands.  NULL symbols ask nothing.
    """
    rows = asked.filter("symbol is not null").distinct().join(resolved.select("project_id", "symbol", "resolved"), ["project_id", "symbol"], "left")
    out = rows.groupBy("project_id", "finding_id").agg(F.array_sort(F.collect_set("resolved")).alias("verified"), F.array_sort(F.collect_set(F.when(F.col("resolved").isNull(), F.col("symbol")))).alias("dropped"))
    every = asked.select("project_id", "finding_id").distinct().join(out, ["project_id", "finding_id"], "left")
    none = F.array().cast("array<string>")
    return every.select("project_id", "finding_id", F.coalesce("verified", none).alias("verified"), F.coalesce("dropped", none).alias("dropped"), (F.coalesce(F.size("verified"), F.lit(0)) > 0).alias("usable"))


def reach_index(nodes: DataFrame, edges: DataFrame, fans: Fans | None = None) -> tuple[DataFrame, DataFrame]:
    """Reach from all project definitions, and flags of each project: has_code, blind."""
    starts = nodes.filter("origin = 'project' and kind <> 'external'").select("project_id", F.col("fqn").alias("node"))
    reach = checkpointed(bfs(edges, starts, "auto", fans=fans))
    seen = reach.join(nodes.select("project_id", F.col("fqn").alias("node"), "dynamic", "unresolved"), ["project_id", "node"], "left")
    blind = seen.groupBy("project_id").agg(F.bool_or(F.coalesce(F.col("dynamic") | F.col("unresolved"), F.lit(False))).alias("blind"))
    flags = nodes.select("project_id").distinct().join(blind, "project_id", "left")
    return reach, flags.select("project_id", F.col("blind").isNotNull().alias("has_code"), F.coalesce("blind", F.lit(False)).alias("blind"))


def _owned(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Graph nodes under each finding's import names (the name itself or below it)."""
    names = names.withColumn("head", F.substring_index("n", ".", 1))
    heads = nodes.select("project_id", F.col("fqn").alias("node"), F.substring_index("fqn", ".", 1).alias("head"))
    return names.join(heads, ["project_id", "head"]).filter("node = n or startswith(node, concat(n, '.'))").select("project_id", "finding_id", "node").distinct()


def package_verdict(findings: DataFrame, nodes: DataFrame, edges: DataFrame, index: tuple[DataFrame, DataFrame] | None = None, names: DataFrame | None = None) -> DataFrame:
    """Findings with verdict, confidence, reason_code and path.

    Import names are an array of the finding (``import_names``), or rows of
    ``names(project_id, finding_id, n)``.  Missing ones and a project without
    code are unknown.  Empty tables give no row.
    """
    reach, flags = index or reach_index(nodes, edges)  # one traversal answers all findings
    if names is None:
        names = findings.select("project_id", "finding_id", F.explode("import_names").alias("n"))
    hit = _owned(names, nodes).join(reach.select("project_id", "node", "dist"), ["project_id", "node"], "left")
    best = hit.groupBy("project_id", "finding_id").agg(F.count(F.lit(1)).alias("n_owned"), F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", "node"))).alias("near"))
    best = names.select("project_id", "finding_id").distinct().join(best, ["project_id", "finding_id"], "left").select("project_id", "finding_id", F.coalesce("n_owned", F.lit(0)).alias("n_owned"), F.col("near.node").alias("node"))
    paths = evidence(reach, best.filter("node is not null").select("project_id", "node").distinct(), "auto")
    rows = findings.join(flags, "project_id", "left").join(best, ["project_id", "finding_id"], "left").join(paths, ["project_id", "node"], "left")
    code = F.coalesce("has_code", F.lit(False))
    reason = F.when(~code, "no_project_code").when(F.col("n_owned").isNull(), "no_import_names").when(F.col("node").isNotNull(), F.when(F.col("speculative"), "guessed_path").otherwise("path")).when(F.col("n_owned") == 0, "never_named").when(F.col("blind"), "blind_spot").otherwise("not_reached")
    rows = rows.withColumn("reason_code", reason)
    verdict = F.when(F.col("reason_code").isin("path", "guessed_path"), "reachable").when(F.col("reason_code").isin("never_named", "not_reached"), "not_reachable").otherwise("unknown")
    confidence = F.when(F.col("reason_code").isin("path", "never_named", "not_reached"), "high").when(F.col("reason_code") == "guessed_path", "medium").otherwise("low")
    return rows.withColumns({"verdict": verdict, "confidence": confidence}).drop("has_code", "blind", "n_owned", "node", "speculative")


def symbol_verdict(findings: DataFrame, nodes: DataFrame, edges: DataFrame, status: DataFrame, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Narrow package verdicts by verified symbols (``symbols``: array, NULL or empty for none).

    A reached symbol proves; absence proves only if every symbol is in the
    graph, expansion is complete, and nothing reached is a blind spot.
    """
    index = index or reach_index(nodes, edges)
    base = package_verdict(findings, nodes, edges, index).withColumnRenamed("path", "package_path").join(index[1].select("project_id", "blind"), "project_id", "left")
    reach = index[0]
    asked = findings.select("project_id", "finding_id", F.explode("symbols").alias("node"))
    seen = asked.join(nodes.select("project_id", F.col("fqn").alias("node"), F.lit(True).alias("known")), ["project_id", "node"], "left").join(reach.select("project_id", "node", "dist"), ["project_id", "node"], "left")
    best = seen.groupBy("project_id", "finding_id").agg(F.bool_and(F.col("known").isNotNull()).alias("all_known"), F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", "node"))).alias("near"))
    best = best.select("project_id", "finding_id", "all_known", F.col("near.node").alias("node"))
    paths = evidence(reach, best.filter("node is not null").select("project_id", "node").distinct(), "auto").withColumnRenamed("path", "symbol_path")
    rows = base.join(best, ["project_id", "finding_id"], "left").join(paths, ["project_id", "node"], "left").join(status.select("project_id", "complete"), "project_id", "left")
    keep = F.coalesce(F.size("symbols") <= 0, F.lit(True)) | (F.col("verdict") == "not_reachable")
    reason = (
        F.when(keep, F.col("reason_code")).when(F.col("node").isNotNull(), F.when(F.col("speculative"), "guessed_symbol_path").otherwise("symbol_path"))
        .when(F.col("verdict") != "reachable", F.col("reason_code")).when(~F.col("all_known"), "symbol_not_in_graph")
        .when(~F.coalesce("complete", F.lit(False)), "expansion_incomplete").when(F.col("blind"), "blind_spot").otherwise("symbol_not_reached")
    )
    rows = rows.withColumn("reason_code", reason)
    r = F.col("reason_code")
    verdict = F.when(r.isin("symbol_path", "guessed_symbol_path"), "reachable").when(r.isin("symbol_not_in_graph", "expansion_incomplete", "blind_spot"), "unknown").when(r == "symbol_not_reached", "not_reachable").otherwise(F.col("verdict"))
    confidence = F.when(r.isin("symbol_path", "symbol_not_reached"), "high").when(r == "guessed_symbol_path", "medium").when(r.isin("symbol_not_in_graph", "expansion_incomplete", "blind_spot"), "low").otherwise(F.col("confidence"))
    path = F.when(r.isin("symbol_path", "guessed_symbol_path"), F.col("symbol_path")).when(verdict == "reachable", F.col("package_path"))
    return rows.withColumns({"path": path, "confidence": confidence, "verdict": verdict}).drop("package_path", "symbol_path", "all_known", "node", "speculative", "complete", "blind")


__all__ = ["expand", "expand_on_demand", "package_verdict", "reach_index", "resolve", "stored_modules", "symbol_verdict", "verification", "verify_symbols"]
