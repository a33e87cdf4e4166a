"""Source trees, installed distributions and model replies as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.names import is_test_path, module_fqn, normalise

from .filewalk import SKIP_DIRS, read_trees

#: Fixed value: characters of an advisory's prose in a question.
DETAIL_CHARS = 6000


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """``path, source`` of the Python files below a folder; undecodable text is NULL.

    Skipped folders are pruned by the walk itself (``filewalk``): nothing in them is listed or read.
    """
    return read_trees(spark, [path]).select("path", "source")


def _project(df: DataFrame) -> list[str]:
    return ["project_id"] if "project_id" in df.columns else []


def skipped(path: Column) -> Column:
    """Below a folder of SKIP_DIRS or one that starts with a dot."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(dirs, lambda d: d.isin(*SKIP_DIRS) | F.startswith(d, F.lit(".")))


def discover(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """``files(project_id, path, …)`` that are modules, with fqn and is_package.

    The root is ``src/`` where a project has files there and no package at its
    top; tests beside ``src/`` are taken only if asked for.  A folder that is
    itself a package roots at its parent: its name (column ``folder``, the last
    part of a path, or else the project's id) leads every module's name.
    """
    files = files.withColumn("__name", F.element_at(F.split("folder" if "folder" in files.columns else F.col("project_id").cast("string"), "/"), -1))
    rows = files.filter(F.col("path").endswith(".py") & ~skipped(F.col("path")))
    flags = rows.groupBy("project_id").agg(F.bool_or(F.startswith("path", F.lit("src/"))).alias("src"), F.bool_or(F.col("path") == "__init__.py").alias("top"))
    rows = rows.join(flags, "project_id").withColumn("in_src", F.col("src") & ~F.col("top"))
    inside = F.when(F.col("in_src"), F.startswith("path", F.lit("src/"))).otherwise(F.lit(True))
    tests = is_test_path(F.col("path"))
    kept = rows.filter(F.when(tests, F.lit(include_tests)).otherwise(inside))
    inner = F.when(F.col("in_src") & F.startswith("path", F.lit("src/")), F.expr("substring(path, 5)")).when(F.col("top"), F.concat("__name", F.lit("/"), "path")).otherwise(F.col("path"))
    out = kept.withColumn("fqn", module_fqn(inner)).withColumn("is_package", F.col("path").endswith("__init__.py"))
    return out.filter("fqn <> ''").drop("src", "top", "in_src", "__name")


def site_packages(files: DataFrame, settings: DataFrame) -> DataFrame:
    """``project_id, site_packages, environment_status``: where each project's dependencies are installed.

    ``files(project_id, path)`` lists whole paths, ``settings(project_id, root,
    override, virtual_env)`` holds one row a project.  An override alone decides
    where it is set, and may name a site-packages folder itself.  Else the
    root's ``.venv`` comes first, then the active environment if it lies inside
    the root; never another project's.  In an environment ``Lib`` comes before
    the first ``lib/python*`` by name.  A folder without files is not seen.
    Status: ``found``, ``override_unusable`` or ``no_environment``.
    """
    clean = lambda c: F.rtrim(F.col(c), F.lit("/"))
    inside = F.startswith(F.concat(clean("virtual_env"), F.lit("/")), F.concat(clean("root"), F.lit("/")))
    place = lambda i, base: F.struct(F.lit(i).alias("turn"), base.alias("base"))
    turns = F.when(F.col("override").isNotNull(), F.array(place(0, clean("override")))).otherwise(F.array(place(1, F.concat(clean("root"), F.lit("/.venv"))), place(2, F.when(inside, clean("virtual_env")))))
    bases = settings.select("project_id", F.inline(turns)).filter("base is not null")
    below = files.filter(F.contains("path", F.lit("site-packages/"))).join(bases, "project_id").filter("startswith(path, concat(base, '/'))")
    part = F.regexp_extract(F.expr("substring(path, length(base) + 2)"), r"^(Lib/site-packages|lib/python[^/]*/site-packages)/", 1)
    itself = (F.col("turn") == 0) & F.col("base").rlike("(^|/)site-packages$")
    rows = below.withColumn("part", part).withColumn("dir", F.when(F.col("part") != "", F.concat("base", F.lit("/"), "part")).when(itself, F.col("base"))).filter("dir is not null")
    rank = F.when(F.col("part") == "", 2).when(F.startswith("part", F.lit("Lib/")), 0).otherwise(1)
    best = rows.groupBy("project_id").agg(F.min(F.struct("turn", rank.alias("rank"), "dir")).alias("best"))
    status = F.when(F.col("best").isNotNull(), "found").when(F.col("override").isNotNull(), "override_unusable").otherwise("no_environment")
    return settings.select("project_id", "override").join(best, "project_id", "left").select("project_id", F.col("best.dir").alias("site_packages"), status.alias("environment_status"))


def installed_distributions(dirs: DataFrame) -> DataFrame:
    """Normalised ``name, version`` from names of ``*.dist-info`` folders, by project where ``dirs`` has its id."""
    return dirs.select(*_project(dirs), normalise(F.regexp_extract("dir", r"^(.+)-([^-]+)\.dist-info$", 1)).alias("name"), F.regexp_extract("dir", r"^(.+)-([^-]+)\.dist-info$", 2).alias("version")).filter("name <> ''")


def module_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each wanted module (of its project, where both tables have ids); a plain file comes before a package, none is NULL."""
    keys = [*_project(files), "fqn"]
    base = F.regexp_replace("path", r"\.py$", "")
    known = files.filter(F.col("path").endswith(".py")).select(*_project(files), F.col("path"), F.regexp_replace(F.regexp_replace(base, "/__init__$", ""), "/", ".").alias("fqn"), F.col("path").endswith("/__init__.py").cast("int").alias("rank"))
    best = known.groupBy(*keys).agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return wanted.join(best, keys, "left")


def owning_distribution(modules: DataFrame, import_names: DataFrame) -> DataFrame:
    """The first distribution (by name) of the module's project that provides its top-level name."""
    keys = _project(import_names)
    heads = import_names.groupBy(*keys, F.col("import_name").alias("head")).agg(F.min("distribution").alias("distribution"))
    return modules.withColumn("head", F.substring_index("fqn", ".", 1)).join(heads, [*keys, "head"], "left").drop("head")


def _whole_json(text: Column) -> Column:
    """Variant of a text that is one JSON value and nothing more, else NULL.

    The parser stops after the first value; only at the end of the text do both
    brackets close it.
    """
    array, pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"k":'), text, F.lit("}")))
    alone = F.size(F.try_variant_get(array, "$", "array<variant>")) == 1
    return F.when(alone & pair.isNotNull(), F.try_variant_get(pair, "$.k", "variant"))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def reply_symbols(reply: Column) -> Column:
    """Symbols of a model's JSON envelope; NULL for any other shape (ask again later), empty if it names none.

    The text must be one JSON object; ``symbols``, where it is there, a list of
    strings alone.
    """
    told = F.try_variant_get(_whole_json(reply), "$.candidates[0].content.parts[0].text", "variant")
    said = _whole_json(F.when(_kind(told) == "STRING", F.try_variant_get(told, "$", "string")))
    listed = F.try_variant_get(said, "$.symbols", "variant")
    items = F.try_variant_get(listed, "$", "array<variant>")
    good = F.startswith(_kind(listed), F.lit("ARRAY")) & F.forall(items, lambda x: _kind(x) == "STRING")
    return F.when(F.startswith(_kind(said), F.lit("OBJECT")), F.when(listed.isNull(), F.array().cast("array<string>")).when(good, F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))))


def prompt(advisory: Column, details: Column, diff: Column) -> Column:
    """Question to a model: identifier, prose (cut), and the reduced diff if there is one."""
    body = F.concat(F.lit("Advisory: "), advisory, F.lit("\n\n"), F.substring(F.coalesce(details, F.lit("")), 1, DETAIL_CHARS))
    return F.when(diff.isNull() | (diff == ""), body).otherwise(F.concat(body, F.lit("\n\nFix:\n"), diff))


def fix_cell(target: Column, fixed: Column) -> Column:
    """Short text of where a finding is fixed."""
    more = F.when(F.size(fixed) > 1, F.concat(F.lit(" +"), F.size(fixed) - 1)).otherwise("")
    return F.coalesce(target, F.concat(F.get(fixed, F.lit(0)), more), F.lit("no fix"))


def warnings(summary: DataFrame) -> DataFrame:
    """``project_id, warning`` rows that follow from the counters of a scan."""
    rules = {"packages_unqueried": "advisories_unanswered", "bodies_missing": "advisory_bodies_missing", "fix_lookups_failed": "releases_unanswered", "unparsed_source_files": "files_not_parsed", "symbols_dropped": "symbols_not_verified"}
    made = [F.when(F.col(c) > 0, F.lit(w)) for c, w in rules.items() if c in summary.columns]
    if "reachability_analysed" in summary.columns:  # one of the four, the first that holds
        traced = F.col("reachability_analysed")
        made.append(F.when(~traced, "no_call_graph").when(F.col("quota_exhausted"), "quota_exhausted").when(~F.col("symbol_extraction_available"), "package_level_verdicts"))
        made.append(F.when((F.col("extractions_failed") > 0) & ~F.col("quota_exhausted"), "symbol_lookups_failed"))
    every = F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")
    return summary.select("project_id", F.explode(every).alias("warning"))


def availability(rows: DataFrame) -> DataFrame:
    """Whether a model is configured (a key, not offline) and may still be asked (quota left)."""
    configured = F.col("has_key") & ~F.col("offline")
    return rows.withColumn("configured", configured).withColumn("available", configured & ~F.col("quota_exhausted"))
