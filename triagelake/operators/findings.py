"""Ranking, grouping and counting of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.names import normalise, severity_rank

BAR = 20


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == "reachable", 0).when(verdict == "not_reachable", 2).otherwise(1)


def sort_key() -> Column:
    """Verdict, what can be acted on, severity (worst first), depth, id."""
    return F.struct(verdict_rank(F.col("verdict")).alias("v"), (~F.col("actionable")).alias("a"), (-severity_rank(F.col("severity"))).alias("s"), F.col("depth").alias("d"), F.col("advisory_id").alias("i"))


def ranked(findings: DataFrame) -> DataFrame:
    """Rank inside each project, so that no task sorts more than one project."""
    return findings.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(sort_key(), "package")).cast("long"))


def suppressible(verdict: Column) -> Column:
    return verdict == "not_reachable"


def flags(findings: DataFrame) -> DataFrame:
    """Findings with ``is_direct`` and ``suppressible``.

    A package is direct at one hop from the root; of unknown depth or verdict
    it is neither, since only a proven verdict puts a finding aside.
    """
    direct = F.coalesce(F.col("depth") == 1, F.lit(False))
    return findings.withColumns({"is_direct": direct, "suppressible": F.coalesce(suppressible(F.col("verdict")), F.lit(False))})


def package_groups(findings: DataFrame) -> DataFrame:
    """Packages with their findings' ids in order, their own rank, and whether all can be put aside."""
    rows = findings.withColumn("k", sort_key())
    out = rows.groupBy("project_id", "package").agg(F.min("k").alias("k"), F.array_sort(F.collect_list("k")).alias("ks"), F.bool_and(suppressible(F.col("verdict"))).alias("ignorable"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("k", "package"))
    return out.select("project_id", "package", rank.cast("long").alias("rank"), F.array_join(F.transform("ks", lambda x: x["i"]), ",").alias("advisories"), "ignorable", "n")


def verdict_totals(findings: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return findings.groupBy("project_id").agg(F.count_if(v == "reachable").alias("reachable"), F.count_if(verdict_rank(v) == 1).alias("unknown"), F.count_if(v == "not_reachable").alias("not_reachable"))


def severity_bars(findings: DataFrame) -> DataFrame:
    """Counts by severity and the length of a bar in proportion to the largest, at least 1."""
    counts = findings.groupBy("project_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy("project_id"))
    return counts.withColumn("bar", F.greatest(F.lit(1), F.bround(F.col("n") / most * BAR)).cast("int")).withColumn("severity_rank", severity_rank(F.col("severity")))


def scanner_parity(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """CVE ids that only one side has: ``project_id, cve, side`` (missed or extra)."""
    cves = lambda df: df.select("project_id", F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("cve")).filter("startswith(cve, 'CVE-')").distinct()
    a, b = cves(theirs), cves(ours)
    keys = ["project_id", "cve"]
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missed")).unionAll(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))


def parity_report(theirs: DataFrame, ours: DataFrame, state: DataFrame) -> DataFrame:
    """One row a project: status, and how the CVE and package sets of two scanners differ.

    ``theirs`` and ``ours``: project_id, package, id, aliases; ``state``:
    project_id, status.  An incomplete scan can't be compared, so a project
    with an unqueried package is ``skipped`` and proves nothing; a CVE that only
    they report is a failure; other differences are notes.
    """
    unqueried = state.groupBy("project_id").agg(F.count_if(F.col("status") == "failed").alias("unqueried"))
    cves = scanner_parity(theirs, ours).groupBy("project_id").agg(F.count_if(F.col("side") == "missed").alias("missed"), F.count_if(F.col("side") == "extra").alias("extra"))
    named = lambda df, side: df.select("project_id", normalise(F.col("package")).alias("package"), F.lit(side).alias("side"))
    seen = named(theirs, 1).unionAll(named(ours, 2)).distinct().groupBy("project_id", "package").agg(F.sum("side").alias("sides"))
    packages = seen.groupBy("project_id").agg(F.count_if(F.col("sides") == 1).alias("packages_missed"), F.count_if(F.col("sides") == 2).alias("packages_extra"))
    records = theirs.groupBy("project_id").agg(F.count(F.lit(1)).alias("records"))
    every = theirs.select("project_id").unionAll(ours.select("project_id")).unionAll(state.select("project_id")).distinct()
    for t in (unqueried, cves, packages, records):
        every = every.join(t, "project_id", "left")
    rows = every.fillna(0)
    status = F.when(F.col("unqueried") > 0, "skipped").when(F.col("missed") > 0, "failed").otherwise("passed")
    return rows.withColumn("status", status).withColumn("exit_code", F.when(F.col("status") == "failed", 1).otherwise(0))


GATES = ("never", "any", "reachable")


def fail_gate(findings: DataFrame, fail_on: str, parsed: DataFrame | None = None) -> DataFrame:
    """Exit code of each project: 2 without a usable lockfile, 1 where the gate (never, any, reachable) is met, else 0.

    ``parsed`` (project_id, status) names all projects that were asked for,
    those without findings too; without it only projects with findings have a
    row.  Another gate is a mistake of the caller and raises.
    """
    if fail_on not in GATES:
        raise ValueError(f"fail_on is one of {', '.join(GATES)}")
    hit = {"never": F.lit(False), "any": F.lit(True), "reachable": F.col("verdict") == "reachable"}[fail_on]
    met = findings.groupBy("project_id").agg(F.max(F.when(hit, 1).otherwise(0)).alias("exit_code"))
    if parsed is None:
        return met
    rows = parsed.groupBy("project_id").agg(F.bool_and(F.col("status") == "ok").alias("ok")).join(met, "project_id", "left")
    return rows.select("project_id", F.when(F.col("ok"), F.coalesce("exit_code", F.lit(0))).otherwise(2).alias("exit_code"))


def scan_summary(queried: DataFrame, findings: DataFrame) -> DataFrame:
    """Coverage of each project; a scan is complete only if every package was answered."""
    q = queried.groupBy("project_id").agg(F.count(F.lit(1)).alias("packages"), F.count_if(F.col("status") == "cached").alias("cache_hits"), F.count_if(F.col("status") == "failed").alias("unqueried"))
    f = findings.groupBy("project_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("package").alias("packages_affected"))
    out = q.join(f, "project_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("project_id", "packages", "cache_hits", "unqueried", none("findings"), none("packages_affected"), (F.col("unqueried") == 0).alias("complete"))
