"""Advisory records: projections of the wire format, and merging of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.names import display_id, normalise, severity, severity_rank

#: Wire format of an advisory; unknown fields are ignored.
RECORD = (
    "id string, aliases array<string>, summary string, details string, severity array<struct<type:string,score:string>>,"
    " affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,repo:string,"
    "events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>,"
    " references array<struct<type:string,url:string>>, database_specific struct<severity:string>"
)
RANGE = "struct<introduced:string,fixed:string,last_affected:string>"


def parse(text: Column) -> Column:
    """Record of a JSON text, NULL if it is no record."""
    return F.from_json(text, RECORD, {"mode": "PERMISSIVE"})


def word_severity(text: Column) -> Column:
    """Severity of a JSON record; only a string counts."""
    quoted = F.get_json_object(text, "$.database_specific.severity")
    is_text = F.regexp_like(text, F.lit(r'"severity"\s*:\s*"'))
    return severity(F.when(is_text, quoted))


def _ranges(record: Column, package: Column) -> Column:
    mine = F.filter(record["affected"], lambda a: normalise(a["package"]["name"]) == normalise(package))
    every = F.flatten(F.transform(mine, lambda a: F.coalesce(a["ranges"], F.array().cast("array<struct<type:string,repo:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"))))
    return F.filter(every, lambda r: F.upper(r["type"]).isin("ECOSYSTEM", "SEMVER"))


def fixed_versions(record: Column, package: Column) -> Column:
    """Distinct fixed versions for the package, in order."""
    found = F.flatten(F.transform(_ranges(record, package), lambda r: F.transform(r["events"], lambda e: e["fixed"])))
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull() & (v != "")))


def intervals(events: Column) -> Column:
    """Affected ranges of one ordered event list.

    An introduction sets the pending start (over an earlier one); a fix or last
    affected version closes it; what is still pending at the end stays open.
    """
    kind = f"struct<at:string,open:boolean,out:array<{RANGE}>>"
    none = F.struct(F.lit(None).cast("string").alias("at"), F.lit(False).alias("open"), F.array().cast(f"array<{RANGE}>").alias("out")).cast(kind)
    row = lambda low, fixed, last: F.struct(low.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected"))
    null = F.lit(None).cast("string")

    def step(acc: Column, e: Column) -> Column:
        start = F.struct(e["introduced"].alias("at"), F.lit(True).alias("open"), acc["out"].alias("out"))
        close = F.struct(null.alias("at"), F.lit(False).alias("open"), F.concat(acc["out"], F.array(row(acc["at"], e["fixed"], e["last_affected"]))).alias("out"))
        ends = e["fixed"].isNotNull() | e["last_affected"].isNotNull()
        return F.when(e["introduced"].isNotNull(), start.cast(kind)).when(ends, close.cast(kind)).otherwise(acc)

    return F.aggregate(events, none, step, lambda acc: F.when(acc["open"], F.concat(acc["out"], F.array(row(acc["at"], null, null)))).otherwise(acc["out"]))


def affected_ranges(record: Column, package: Column) -> Column:
    return F.flatten(F.transform(_ranges(record, package), lambda r: intervals(r["events"])))


def fix_commits(record: Column) -> Column:
    """Distinct commit links of all Git ranges, whatever the package."""
    gits = F.filter(F.flatten(F.transform(record["affected"], lambda a: a["ranges"])), lambda r: (F.upper(r["type"]) == "GIT") & r["repo"].isNotNull())
    base = lambda r: F.regexp_replace(F.regexp_replace(r["repo"], "/+$", ""), r"\.git$", "")
    links = F.flatten(F.transform(gits, lambda r: F.transform(F.filter(r["events"], lambda e: e["fixed"].isNotNull() & (e["fixed"] != "")), lambda e: F.concat(base(r), F.lit("/commit/"), e["fixed"]))))
    return F.array_distinct(links)


def reference_urls(record: Column) -> Column:
    return F.filter(F.transform(record["references"], lambda r: r["url"]), lambda u: u.isNotNull() & (u != ""))


def merge(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each display id within ``keys``.

    ``records``: keys, ord, id, aliases, summary, details, severity,
    fixed_versions, references, fix_commits, affected_ranges.  Members stand in
    order of ``ord``.  The leading id has a known severity, then the longest
    summary, then the first place; the worst severity and longest texts win;
    lists are unions in order of first sight.  Order of rows plays no part.
    """
    lists = ["fixed_versions", "references", "fix_commits", "affected_ranges"]
    known = (F.col("severity") != "unknown").cast("int")
    size = F.coalesce(F.length("summary"), F.lit(0))
    rows = records.withColumn("display_id", display_id(F.col("id"), F.col("aliases")))
    member = F.struct("ord", "id", "aliases", *lists)
    longest = lambda c: F.max_by(c, F.struct(F.coalesce(F.length(c), F.lit(-1)), -F.col("ord")))
    out = rows.groupBy(*keys, "display_id").agg(
        F.max_by("id", F.struct(known, size, -F.col("ord"))).alias("id"),
        F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"),
        longest("summary").alias("summary"),
        longest("details").alias("details"),
        F.array_sort(F.collect_list(member)).alias("m"),
        F.min("ord").alias("first_ord"),
        F.count(F.lit(1)).alias("n_records"),
    )
    union = lambda name: F.array_distinct(F.flatten(F.transform("m", lambda x: F.coalesce(x[name], F.array().cast(dict(rows.dtypes)[name])))))
    names = F.array_distinct(F.concat(F.flatten(F.transform("m", lambda x: F.coalesce(x["aliases"], F.array().cast("array<string>")))), F.transform("m", lambda x: x["id"])))
    aliases = F.filter(names, lambda a: a != F.col("id"))
    return out.withColumns({"aliases": aliases, **{n: union(n) for n in lists}}).drop("m")
