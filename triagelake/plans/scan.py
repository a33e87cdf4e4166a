"""From lockfiles to ranked findings: one plan for any number of projects.

Sources are tables with states.  A question without an answer is a row less
(or a NULL), counted and never taken for a clean answer:

answers    name, version, status (ok, cached, failed), ids (array)
bodies     id, body (JSON text, NULL or absent if it could not be had), ts if there is one
releases   name, versions (array, NULL or absent if unanswered)
metadata   name, version, requires (array)

The work is factored.  A body is parsed once an id, advisories are merged once
a (name, version), fixes are found once a (name, version, set of constraints);
projects meet them by keys alone, and texts and lists join the ranked rows last.

Defined cases: a package without an answer has no findings and counts as
unqueried; an id without a body, or whose body is no record, counts as missing;
names are matched normalised; equal rows count once; where rows of one key
clash, an answer comes before a failure, ids and releases are united, the
newest body counts (without ``ts`` the greatest text), and row order plays no
part; empty tables give no row.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions import names as N
from triagelake.operators import advisories, findings, fixes, packages, reach, resolve, version_ranks
from triagelake.operators.graph import checkpointed
from triagelake.operators.parse_store import ParseStore, environments, listed
from triagelake.sources import lockfiles

KEYS = ["project_id", "name", "version"]


def scannable(entries: DataFrame) -> DataFrame:
    """Every resolved package but the project itself, forked versions too."""
    return entries.filter("not is_root").select(*KEYS).distinct()


def whole_batches(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers of batched queries: ``replies(batch, results)`` against ``asked(batch, name, version, place)``.

    A reply whose number of results isn't that of its questions answers none
    of them: their status is ``failed``.
    """
    sizes = asked.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    good = replies.join(sizes, "batch").filter(F.size("results") == F.col("n")).select("batch", "results")
    rows = asked.join(good, "batch", "left")
    ids = F.get("results", F.col("place"))
    return rows.select("name", "version", F.when(F.col("results").isNull(), "failed").otherwise("ok").alias("status"), F.when(F.col("results").isNotNull(), F.coalesce(ids, F.array().cast("array<string>"))).alias("ids"))


def answered(answers: DataFrame) -> DataFrame:
    """``name, version, status, ids``: one row a package version, united over all its answers."""
    good = F.col("status") != "failed"
    rank = F.when(F.col("status") == "ok", 0).otherwise(1)
    listed = F.when(good, F.struct(rank.alias("rank"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids")))
    rows = answers.groupBy(N.normalise(F.col("name")).alias("name"), "version").agg(F.min(F.when(good, rank)).alias("best"), F.array_sort(F.collect_set(listed)).alias("lists"))
    status = F.when(F.col("best") == 0, "ok").when(F.col("best") == 1, "cached").otherwise("failed")
    return rows.select("name", "version", status.alias("status"), F.array_distinct(F.flatten("lists.ids")).alias("ids"))


def records(wanted: DataFrame, bodies: DataFrame) -> DataFrame:
    """``key, record, severity`` of each distinct id in ``wanted(key)`` that has a record.

    The only parse of a scan: once an id, from its newest body.
    """
    order = F.struct(*[c for c in ("ts", "body") if c in bodies.columns])
    texts = bodies.filter("body is not null").withColumnRenamed("id", "key").join(wanted.select("key").distinct(), "key", "left_semi")
    newest = texts.groupBy("key").agg(F.max_by("body", order).alias("body"))
    return checkpointed(newest.select("key", advisories.parse(F.col("body")).alias("record"), advisories.word_severity(F.col("body")).alias("severity"))).filter("record.id is not null")


def advisory_facts(asked: DataFrame, read: DataFrame) -> DataFrame:
    """``asked(name, key)`` with what the record of that id says of that package."""
    record, name = F.col("record"), F.col("name")
    return asked.join(read, "key").select(
        "name", "key", record["id"].alias("id"), record["aliases"].alias("aliases"), record["summary"].alias("summary"), record["details"].alias("details"), "severity",
        advisories.fixed_versions(record, name).alias("fixed_versions"), advisories.reference_urls(record).alias("references"),
        advisories.fix_commits(record).alias("fix_commits"), advisories.affected_ranges(record, name).alias("affected_ranges"),
    )


def version_findings(versions: DataFrame, answers: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged advisories of each (name, version), and its state: status, ids without a body."""
    keys = ["name", "version"]
    state = checkpointed(versions.join(answered(answers), keys, "left").withColumn("status", F.coalesce("status", F.lit("failed"))))
    asked = state.filter("status <> 'failed'").select(*keys, F.posexplode("ids").alias("ord", "key"))
    read = records(asked, bodies)
    facts = advisory_facts(asked.select("name", "key").distinct(), read)
    gaps = asked.join(read.select("key"), "key", "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("bodies_missing"))
    merged = advisories.merge(asked.join(facts, ["name", "key"]).drop("key"), keys)
    return merged, state.select(*keys, "status").join(gaps, keys, "left").fillna(0, ["bodies_missing"])


def contexts(entries: DataFrame, metadata: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of constraints that projects put on ``names(name)``.

    First ``project_id, name, context``, then ``name, context, declared,
    parents`` (parent to constraint).  Projects with equal sets share a context:
    two 64-bit fingerprints over its rows that ignore their order.  A package
    under no constraint has no row.
    """
    above = packages.uses(packages.edges(entries), entries).join(names, "name", "left_semi")
    asked = checkpointed(packages.constraints(above, metadata).filter("constraint is not null"))
    held = above.join(asked.select("name", "parent", "parent_version"), ["name", "parent", "parent_version"], "left_semi")
    own = lockfiles.declared(entries).join(names, "name", "left_semi")
    marks = checkpointed(held.select("project_id", "name", "parent", F.col("parent_version").alias("mark")).unionAll(own.select("project_id", "name", F.lit(None).cast("string"), "specifier")))
    one, two = F.bit_xor(F.xxhash64("parent", "mark")), F.bit_xor(F.xxhash64(F.lit(1), F.col("mark"), F.col("parent")))
    keyed = marks.groupBy("project_id", "name").agg(F.concat(F.hex(one), F.lit("-"), F.hex(two)).alias("context"))
    shown = marks.join(keyed.groupBy("name", "context").agg(F.min("project_id").alias("project_id")), ["project_id", "name"])  # one project of each
    rows = shown.join(asked.withColumnRenamed("parent_version", "mark"), ["name", "parent", "mark"], "left")
    pairs = F.collect_list(F.when(F.col("parent").isNotNull(), F.struct("parent", "constraint")))
    sets = rows.groupBy("name", "context").agg(F.max(F.when(F.col("parent").isNull(), F.col("mark"))).alias("declared"), F.map_from_entries(F.array_sort(pairs)).alias("parents"))
    return keyed, sets


def version_targets(merged: DataFrame, released: DataFrame) -> DataFrame:
    """``name, version, display_id`` with ``readable``, ``target``, ``target_text``, ``back_text`` and ``back_first``.

    ``merged``: fixed_versions and affected_ranges of each; ``released(name,
    v)``.  All versions get places in one dictionary; what no project's
    constraints can change is searched once, by places alone.
    """
    keys = ["name", "version", "display_id"]
    fixed = merged.select(*keys, F.explode("fixed_versions").alias("v"))
    ranges = merged.select(*keys, F.inline("affected_ranges"))
    bounds = ranges.select(F.explode(F.array("introduced", "fixed", "last_affected")).alias("v"))
    offered = released.join(merged.select("name").distinct(), "name", "left_semi")
    places = checkpointed(version_ranks.dictionary(merged.select(F.col("version").alias("v")).unionAll(fixed.select("v")).unionAll(bounds).unionAll(offered.select("v"))))
    at = lambda df: df.join(places.drop("canonical"), "v")
    own = merged.select(*keys, F.col("version").alias("v")).join(places.select("v", "place", "major"), "v", "left")
    found = version_ranks.targets(own, at(fixed), keys)
    back = version_ranks.backports(own, at(fixed), version_ranks.intervals(ranges, places, keys), at(offered), keys, ["name"])
    rows = own.select(*keys, F.col("place").isNotNull().alias("readable")).join(found, keys, "left").join(back, keys, "left")
    text = lambda c: places.select(F.col("v").alias(c), F.col("canonical").alias(f"{c}_text"))
    rows = rows.join(text("target"), "target", "left").join(text("back"), "back", "left")
    first = F.col("back").isNotNull() & (F.col("target").isNull() | (F.col("back_place") < F.col("target_place")))
    return rows.select(*keys, "readable", "target", "target_text", "back_text", first.alias("back_first"))


def with_fixes(merged: DataFrame, asked: DataFrame, sets: DataFrame, releases: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fixes of ``merged`` advisories for each ``asked(name, version, context)``.

    Every distinct pair of a target and a constraint is judged once.  Parents'
    upgrades are looked up only where a parent is known to block.
    """
    keys = ["name", "version", "context", "display_id"]
    listed_ = packages.one_releases(releases).filter("versions is not null")
    targets = checkpointed(version_targets(merged, listed_.select("name", F.explode("versions").alias("v"))))
    rows = checkpointed(asked.join(targets, ["name", "version"]).join(sets.select("name", "context", "declared"), ["name", "context"], "left").join(listed_.select("name", F.lit(True).alias("answered")), "name", "left").withColumn("answered", F.coalesce("answered", F.lit(False))))
    every = F.concat(F.coalesce(F.when(F.col("declared").isNotNull(), F.array(F.struct(F.lit(fixes.OWN).alias("who"), F.col("declared").alias("constraint")))), F.array()), F.transform(F.map_entries("parents"), lambda e: F.struct(e["key"].alias("who"), e["value"].alias("constraint"))))
    held = rows.select(*keys, F.coalesce("target", F.lit("")).alias("target")).join(sets.select("name", "context", F.inline(every)), ["name", "context"])
    known = held.join(checkpointed(version_ranks.judged(held)), ["target", "constraint"])
    own, bad = F.col("who") == fixes.OWN, ~F.col("readable")
    stops = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(~F.col("allowed"), F.struct(F.col("who").alias("name"), "constraint")))).alias("block"), F.bool_or(own & bad).alias("unread_own"), F.bool_or(~own & bad).alias("unread_parent"))
    rows = rows.join(stops, keys, "left").withColumns({"block": F.coalesce("block", F.array().cast("array<struct<name:string,constraint:string>>")), "unread_own": F.coalesce("unread_own", F.lit(False)), "unread_parent": F.coalesce("unread_parent", F.lit(False))})
    rows = checkpointed(fixes.shaped(rows))
    blocked = rows.filter("shape = 'override'").select("name", F.explode("block.name").alias("parent"), F.col("target_version").alias("target")).filter(F.col("parent") != fixes.OWN).distinct()
    ups = packages.parent_upgrades(blocked, releases, metadata).filter("upgrade_to is not null")
    maps = ups.groupBy("name", F.col("target").alias("target_version")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("parent", "upgrade_to")))).alias("parent_upgrades"))
    out = rows.withColumn("lookup_failed", ~F.col("answered")).drop("target").join(maps, ["name", "target_version"], "left")
    return fixes.finished(out.withColumn("parent_upgrades", F.coalesce("parent_upgrades", F.create_map().cast("map<string,string>"))))


def scan_findings(
    parsed: DataFrame, answers: DataFrame, bodies: DataFrame, releases: DataFrame, metadata: DataFrame,
    floor: str | None = None, import_names: DataFrame | None = None, graph: tuple | None = None, symbols: DataFrame | None = None, status: DataFrame | None = None,
    only: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ranked findings, and each package's state.

    ``only`` (project_id, name) limits the packages that are looked at; ranks
    then count among them.

    ``parsed``: lockfiles (project_id, status, entries).  With ``graph`` (nodes
    and edges, of ``build``, and fans if it comes from ``build_fans``) and ``import_names`` (project_id, distribution, import_name)
    verdicts come from reach, narrowed by ``symbols`` (project_id, advisory_id,
    symbols, and the package's name if it matters) where ``status`` (project_id,
    complete) is given; without them every verdict is unknown.
    """
    usable = parsed.filter("status = 'ok'")
    if only is not None:
        usable = usable.join(only.select("project_id").distinct(), "project_id", "left_semi")
    entries = checkpointed(lockfiles.entries(usable))
    releases, metadata = (df.withColumn("name", N.normalise(F.col("name"))) for df in (releases, metadata))
    pkgs = scannable(entries)
    if only is not None:
        pkgs = checkpointed(pkgs.join(only, ["project_id", "name"], "left_semi"))
    merged, state = version_findings(pkgs.select("name", "version").distinct(), answers, bodies)
    if floor is not None:
        merged = merged.filter(N.passes_floor(F.col("severity"), F.lit(floor)))
    merged = checkpointed(merged)
    keyed, sets = contexts(entries, metadata, merged.select("name").distinct())
    hit = pkgs.join(merged.select("name", "version").distinct(), ["name", "version"], "left_semi")
    hit = checkpointed(hit.join(keyed, ["project_id", "name"], "left").withColumn("context", F.coalesce("context", F.lit(""))))  # keys of findings, by project
    fixed = with_fixes(merged, hit.select("name", "version", "context").distinct(), sets, releases, metadata).select("name", "version", "context", "display_id", "shape", "target_version", "command", "actionable", F.col("reason_code").alias("fix_reason"), "reason", "blocking_parents", "lookup_failed")
    texts = merged.select("name", "version", "display_id", "severity", "summary", "aliases", "fix_commits")
    fixed = checkpointed(fixed.join(texts, ["name", "version", "display_id"]).withColumnRenamed("display_id", "advisory_id"))
    slim = hit.join(fixed.select("name", "version", "context", "advisory_id", "severity", "actionable"), ["name", "version", "context"])
    slim = slim.join(packages.depths(entries), ["project_id", "name"], "left")
    paths = None
    if graph is None or import_names is None:
        slim = slim.withColumns({"verdict": F.lit("unknown"), "confidence": F.lit("low"), "reason_code": F.lit("no_project_code")})
    elif symbols is None or status is None:
        names = import_names.select("project_id", F.col("distribution").alias("finding_id"), F.col("import_name").alias("n")).distinct()
        judged = reach.package_verdict(slim.select("project_id", F.col("name").alias("finding_id")).distinct(), *graph[:2], reach.reach_index(*graph), names)
        judged = checkpointed(judged.withColumnRenamed("finding_id", "name"))  # once a package, whatever its findings
        slim = slim.join(judged.drop("path"), ["project_id", "name"])
        paths, by = judged.filter("path is not null").select("project_id", "name", "path"), ["project_id", "name"]
    else:
        by = ["project_id", *KEYS[1:], "advisory_id"]
        names = import_names.groupBy("project_id", F.col("distribution").alias("name")).agg(F.array_sort(F.collect_set("import_name")).alias("import_names"))
        asked = slim.select(*by).join(names, ["project_id", "name"], "left").join(symbols, [k for k in ("project_id", "name", "advisory_id") if k in symbols.columns], "left").withColumn("finding_id", F.struct("name", "version", "advisory_id"))
        judged = checkpointed(reach.symbol_verdict(asked, *graph[:2], status, reach.reach_index(*graph)).select(*by, "verdict", "confidence", "reason_code", "path"))
        slim = slim.join(judged.drop("path"), by)
        paths = judged.filter("path is not null").select(*by, "path")
    slim = findings.ranked(slim.withColumn("package", F.col("name")))
    out = slim.join(fixed.drop("severity", "actionable"), ["name", "version", "context", "advisory_id"]).drop("context")
    out = out.withColumn("path", F.lit(None).cast("array<string>")) if paths is None else out.join(paths, by, "left")
    return out, pkgs.join(state, ["name", "version"]).select(*KEYS, "status", "bodies_missing")


class Inputs(NamedTuple):
    """What a scan reads: lockfiles and the four tables of answers."""

    parsed: DataFrame
    answers: DataFrame
    bodies: DataFrame
    releases: DataFrame
    metadata: DataFrame


def _changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose row is new, gone or another; both hold one row a key."""
    rest = [c for c in after.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(F.lit(True).alias("here"), *rest).alias(name))
    return side(before, "__a").join(side(after, "__b"), keys, "full").filter(~F.col("__a").eqNullSafe(F.col("__b"))).select(*keys)


def to_redo(before: Inputs, after: Inputs) -> DataFrame:
    """``project_id, name`` of the packages whose findings may differ from the last scan's.

    Changes are found where they lie (an id, a version, a package, a lockfile)
    and led on to projects by semi-joins: a body to the versions that list it,
    releases and metadata to the package and to what stands below it.
    """
    entries = checkpointed(lockfiles.entries(after.parsed.filter("status = 'ok'")))
    pkgs = checkpointed(scannable(entries))
    one = lambda df: df.groupBy("project_id").agg(F.max(F.struct("status", "entries")).alias("e"))
    projects = _changed(one(before.parsed), one(after.parsed), ["project_id"])
    now = answered(after.answers)
    versions = _changed(answered(before.answers), now, ["name", "version"])
    newest = lambda df: df.filter("body is not null").groupBy("id").agg(F.max_by("body", F.struct(*[c for c in ("ts", "body") if c in df.columns])).alias("body"))
    ids = _changed(newest(before.bodies), newest(after.bodies), ["id"])
    listing = now.select("name", "version", F.explode("ids").alias("id")).join(ids, "id", "left_semi").select("name", "version")
    named = lambda df: df.withColumn("name", N.normalise(F.col("name")))
    offered = _changed(packages.one_releases(named(before.releases)), packages.one_releases(named(after.releases)), ["name"])
    asked = _changed(packages.one_metadata(named(before.metadata)), packages.one_metadata(named(after.metadata)), ["name", "version"]).select("name")
    above = offered.unionAll(asked).select(F.col("name").alias("parent")).distinct()
    below = packages.uses(packages.edges(entries), entries).join(above, "parent", "left_semi").select("project_id", "name")
    hit = [pkgs.join(projects, "project_id", "left_semi"), pkgs.join(versions.unionAll(listing).distinct(), ["name", "version"], "left_semi"), pkgs.join(offered, "name", "left_semi")]
    return checkpointed(reduce(DataFrame.unionAll, [*(h.select("project_id", "name") for h in hit), below]).distinct())


def rescan(found: DataFrame, state: DataFrame, before: Inputs, after: Inputs, **options) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN003
    """A scan of ``after`` from the last one's rows: only what changed is looked at again.

    ``found`` and ``state`` are the last scan's, made from ``before`` with the
    same ``options`` (those of ``scan_findings``; a project whose graph or
    symbols changed has to be given another lockfile row or a full scan).
    Returns findings, states, and the packages that were done again.  Findings
    of packages and projects that are gone go; ranks are renewed in projects
    that have any change, and the rows of others are carried as they are.
    """
    redo = to_redo(before, after)
    fresh, fresh_state = scan_findings(*after, only=redo, **options)
    there = checkpointed(scannable(lockfiles.entries(after.parsed.filter("status = 'ok'"))))
    kept = lambda df: df.join(redo, ["project_id", "name"], "left_anti").join(there, KEYS, "left_semi")
    touched = redo.select("project_id").unionAll(found.join(there, KEYS, "left_anti").select("project_id")).distinct()
    touched = checkpointed(touched)
    old = kept(found)
    still, moved = old.join(touched, "project_id", "left_anti"), old.join(touched, "project_id", "left_semi")
    renewed = findings.ranked(moved.select(fresh.columns).unionAll(fresh).drop("rank"))
    return still.unionByName(renewed), kept(state).unionByName(fresh_state), redo


def verified_symbols(parsed: DataFrame, extracted: DataFrame, import_names: DataFrame, installed: DataFrame, store: ParseStore) -> DataFrame:
    """``project_id, name, advisory_id, symbols, n_verified, n_dropped`` of symbols that installed source confirms.

    ``extracted(name, advisory_id, symbols)`` says what each advisory's text
    names.  Symbols of another package's names drop out first.  The others are
    looked up once for each distinct environment: projects that have the same
    modules installed share the answers.
    """
    pkgs = scannable(lockfiles.entries(parsed.filter("status = 'ok'"))).select("project_id", "name").distinct()
    said = extracted.select(N.normalise(F.col("name")).alias("name"), "advisory_id", F.posexplode("symbols").alias("ord", "symbol"))
    heads = import_names.select("project_id", F.col("distribution").alias("name"), F.col("import_name").alias("head")).distinct()
    shaped = said.filter(N.plausible_symbol(F.col("symbol"), F.array(F.substring_index("symbol", ".", 1)))).withColumn("head", F.substring_index("symbol", ".", 1))
    listing = checkpointed(listed(installed))
    envs = environments(listing)
    asked = checkpointed(pkgs.join(shaped, "name").join(heads, ["project_id", "name", "head"], "left_semi").join(envs, "project_id"))
    shown = envs.groupBy("env").agg(F.min("project_id").alias("project_id"))  # one project of each environment
    modules = listing.join(shown, "project_id").select(F.col("env").alias("project_id"), "fqn", "is_package", "digest")
    found = reach.verify_symbols(asked.select(F.col("env").alias("project_id"), "symbol").distinct(), reach.stored_modules(checkpointed(modules), store))
    rows = asked.join(found.withColumnRenamed("project_id", "env"), ["env", "symbol"], "left")
    first = F.array_sort(F.collect_set(F.when(F.col("resolved").isNotNull(), F.struct("ord", "resolved"))))
    out = rows.groupBy("project_id", "name", "advisory_id").agg(F.array_distinct(F.transform(first, lambda x: x["resolved"])).alias("symbols"), F.count_if(F.col("resolved").isNull()).alias("n_dropped"))
    return out.withColumn("n_verified", F.size("symbols"))


def scan_sources(
    parsed: DataFrame, answers: DataFrame, bodies: DataFrame, releases: DataFrame, metadata: DataFrame, project: DataFrame, installed: DataFrame, import_names: DataFrame,
    extracted: DataFrame | None = None, floor: str | None = None, budget: int = reach.BUDGET, store: ParseStore | None = None, model: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole way from source text to verdicts: ranked findings, package states, and counters.

    ``project`` and ``installed`` are modules (project_id, fqn, is_package,
    source); ``import_names`` (project_id, distribution, import_name) comes
    from installed records.  Expansion parses what the projects' names lead to,
    verification what ``extracted`` symbols may lie in, and both share one
    store.  A project without modules gets unknown verdicts; empty tables give
    no row.
    """
    store = store or ParseStore.of(project, installed)
    own, deps, status = reach.expand_on_demand(project, installed, budget, store)
    sources = checkpointed(own.unionByName(deps))
    graph = resolve.build_fans(sources)
    checked = None
    if extracted is not None:
        checked = checkpointed(verified_symbols(parsed, extracted, import_names, installed, store))
    found, state = scan_findings(parsed, answers, bodies, releases, metadata, floor, import_names, graph, None if checked is None else checked.select("project_id", "name", "advisory_id", "symbols"), status)
    found = checkpointed(found)
    used = None
    if checked is not None:
        used = checked.join(found.select("project_id", "name", "advisory_id").distinct(), ["project_id", "name", "advisory_id"], "left_semi").withColumn("failed", F.lit(False))
    return found, state, scan_counters(found, state, sources.select("project_id", "origin", "parse_ok"), graph, used, model)


def scan_counters(found: DataFrame, state: DataFrame, parsed_sources: DataFrame | None = None, graph: tuple[DataFrame, DataFrame] | None = None, verified: DataFrame | None = None, model: DataFrame | None = None) -> DataFrame:
    """All counters of a scan, one row a project.

    ``parsed_sources``: project_id, origin, parse_ok; ``verified``: project_id,
    advisory_id, n_verified, n_dropped, failed; ``model``: project_id,
    configured, quota_exhausted.
    """
    out = state.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("packages_scanned"), F.count_if(F.col("status") == "cached").alias("advisories_from_cache"),
        F.count_if(F.col("status") == "failed").alias("packages_unqueried"), F.sum("bodies_missing").alias("bodies_missing"),
    )
    counted = found.groupBy("project_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("package").alias("packages_affected"), F.countDistinct(F.when(F.col("lookup_failed"), F.col("package"))).alias("fix_lookups_failed"))
    out = out.join(counted, "project_id", "left")
    if graph is not None:
        out = out.join(graph[0].groupBy("project_id").agg(F.count(F.lit(1)).alias("graph_nodes")), "project_id", "left")
    if parsed_sources is not None:
        sources = parsed_sources.groupBy("project_id").agg(F.count_if((F.col("origin") == "dependency") & F.col("parse_ok")).alias("dependency_modules_parsed"), F.count_if(~F.col("parse_ok")).alias("unparsed_source_files"))
        out = out.join(sources, "project_id", "left")
    if verified is not None:
        seen = verified.groupBy("project_id").agg(F.count_if(F.col("n_verified") > 0).alias("advisories_narrowed"), F.sum("n_dropped").alias("symbols_dropped"), F.count_if("failed").alias("extractions_failed"))
        out = out.join(seen, "project_id", "left")
    if model is not None:
        out = out.join(model.select("project_id", F.col("configured").alias("symbol_extraction_available"), "quota_exhausted"), "project_id", "left")
    numbers = ["packages_scanned", "advisories_from_cache", "packages_unqueried", "bodies_missing", "findings", "packages_affected", "fix_lookups_failed", "graph_nodes", "dependency_modules_parsed", "unparsed_source_files", "advisories_narrowed", "symbols_dropped", "extractions_failed"]
    whole = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("long") if n in out.columns else F.lit(0).cast("long")
    truth = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in out.columns else F.lit(False)
    analysed = F.col("graph_nodes").isNotNull() if "graph_nodes" in out.columns else F.lit(False)
    return out.select("project_id", *(whole(n).alias(n) for n in numbers), analysed.alias("reachability_analysed"), truth("symbol_extraction_available").alias("symbol_extraction_available"), truth("quota_exhausted").alias("quota_exhausted"), (F.col("packages_unqueried") == 0).alias("complete"))
