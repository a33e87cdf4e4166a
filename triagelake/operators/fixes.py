"""Shape of the change that closes a finding: rules over one wide row, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import versions as V

from .graph import spread

OWN = "your project"


def blockers(target: Column, declared: Column, parents: Column) -> Column:
    """Names and constraints that keep the target out, sorted by name.

    A constraint that can't be read blocks too (it isn't known to allow).
    """
    out = lambda c: c.isNotNull() & ~F.coalesce(V.satisfies(target, c), F.lit(False))
    own = F.when(out(declared), F.array(F.struct(F.lit(OWN).alias("name"), declared.alias("constraint"))))
    mine = F.transform(F.filter(F.map_entries(parents), lambda e: out(e["value"])), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("constraint")))
    empty = F.array().cast("array<struct<name:string,constraint:string>>")
    return F.array_sort(F.concat(F.coalesce(own, empty), F.coalesce(mine, empty)))


def reason_text(lifted: Column) -> Column:
    """One sentence for each reason code, with the constraint that stands in the way."""
    first = F.get("blocking_parents", F.lit(0))
    return (
        F.when(F.col("reason_code") == "version_unread", F.format_string("Installed version %s can't be compared.", F.col("version")))
        .when(F.col("reason_code") == "releases_unanswered", F.lit("The package's releases could not be looked up."))
        .when(F.col("reason_code") == "constraint_unread", F.format_string("Your constraint %s can't be read.", F.col("declared")))
        .when(F.col("reason_code") == "parent_constraint_unread", F.lit("A parent's constraint can't be read."))
        .when(F.col("reason_code") == "backport", F.format_string("%s lies outside of the affected ranges.", F.col("target_version")))
        .when(F.col("reason_code") == "no_fix", F.lit("No released version fixes this."))
        .when(F.col("reason_code") == "in_range", F.format_string("Nothing forbids %s; the lockfile is behind.", F.col("target_version")))
        .when(F.col("reason_code") == "own_constraint", F.format_string("Your constraint %s forbids %s.", F.col("declared"), F.col("target_version")))
        .when(lifted, F.format_string("%s %s forbids %s; a newer release of it doesn't.", first["name"], first["constraint"], F.col("target_version")))
        .otherwise(F.format_string("%s %s forbids %s, and no known release of it allows that.", first["name"], first["constraint"], F.col("target_version")))
    )


def shaped(rows: DataFrame) -> DataFrame:
    """Adds reason_code, shape and target_version; the first rule that holds counts.

    ``rows``: ``readable`` (the installed version), ``answered`` (its releases),
    ``unread_own`` and ``unread_parent`` (constraints), ``target_text`` and
    ``back_text`` (NULL for none), ``back_first`` and ``block``.
    """
    own_only = F.forall("block", lambda b: b["name"] == OWN)
    reason = (
        F.when(~F.col("readable"), "version_unread").when(~F.col("answered"), "releases_unanswered")
        .when(F.col("unread_own"), "constraint_unread").when(F.col("unread_parent"), "parent_constraint_unread")
        .when(F.col("back_first"), "backport").when(F.col("target_text").isNull(), "no_fix")
        .when(F.size("block") == 0, "in_range").when(own_only, "own_constraint").otherwise("parent_constraint")
    )
    shape = (
        F.when(F.col("reason_code").isin("version_unread", "releases_unanswered", "constraint_unread", "parent_constraint_unread"), "unknown")
        .when(F.col("reason_code") == "backport", "backport_exists").when(F.col("reason_code") == "no_fix", "no_fix")
        .when(F.col("reason_code") == "in_range", "lockfile_refresh").when(F.col("reason_code") == "own_constraint", "direct_bump").otherwise("override")
    )
    target = F.when(F.col("shape") == "backport_exists", F.col("back_text")).when(~F.col("shape").isin("unknown", "no_fix"), F.col("target_text"))
    return rows.withColumn("reason_code", reason).withColumn("shape", shape).withColumn("target_version", target)


def finished(rows: DataFrame) -> DataFrame:
    """``shaped`` rows with ``parent_upgrades`` (map) get blocking_parents, command, reason, blocking and actionable."""
    held = F.filter("block", lambda b: b["name"] != OWN)
    rows = rows.withColumn("blocking_parents", F.when(F.col("shape") == "override", F.transform(held, lambda b: F.struct(b["name"].alias("name"), b["constraint"].alias("constraint"), F.try_element_at("parent_upgrades", b["name"]).alias("upgrade_to")))))
    bump = F.transform("blocking_parents", lambda b: F.format_string('uv add "%s>=%s"', b["name"], b["upgrade_to"]))
    lifted = F.forall("blocking_parents", lambda b: b["upgrade_to"].isNotNull())
    override = F.when(lifted, F.array_join(bump, " && ")).otherwise(F.format_string('[tool.uv]\noverride-dependencies = ["%s>=%s"]', F.col("name"), F.col("target_version")))
    command = (
        F.when(F.col("shape") == "lockfile_refresh", F.format_string("uv lock --upgrade-package %s", F.col("name")))
        .when(F.col("shape").isin("direct_bump", "backport_exists"), F.format_string('uv add "%s>=%s"', F.col("name"), F.col("target_version")))
        .when(F.col("shape") == "override", override)
    )
    return rows.withColumn("command", command).withColumn("reason", reason_text(lifted)).withColumn("blocking", F.transform("block", lambda b: b["name"])).withColumn("actionable", ~F.col("shape").isin("no_fix", "unknown")).drop("readable", "answered", "unread_own", "unread_parent", "target_text", "back_text", "back_first", "block")


def with_fix(rows: DataFrame) -> DataFrame:
    """Adds shape, target_version, command, reason_code, reason, blocking and blocking_parents, row by row.

    ``rows``: name, version, fixed (array), ranges, released (array or NULL for
    unanswered), declared, parents (map), parent_upgrades (map).  What isn't
    known gives ``unknown``, never a clean answer.  A scan of many projects
    finds the same by joins over distinct versions (``plans.scan.with_fixes``).
    """
    v, declared, parents = F.col("version"), F.col("declared"), F.col("parents")
    unread = lambda c: c.isNotNull() & V.specifier(c).isNull()
    rows = spread(rows).withColumn("__target", V.select_target(v, F.col("fixed"))).withColumn("__back", V.backport(v, F.col("fixed"), F.col("ranges"), F.coalesce("released", F.array().cast("array<string>"))))
    rows = rows.withColumns({
        "readable": V.is_version(v), "answered": F.col("released").isNotNull(), "unread_own": unread(declared), "unread_parent": F.coalesce(F.exists(F.map_values(parents), unread), F.lit(False)),
        "block": blockers(F.col("__target"), declared, parents), "target_text": V.canonical(F.col("__target")), "back_text": V.canonical(F.col("__back")),
        "back_first": F.col("__back").isNotNull() & (F.col("__target").isNull() | (V.version_key(F.col("__back")) < V.version_key(F.col("__target")))),
    })
    return finished(shaped(rows)).drop("__target", "__back")
