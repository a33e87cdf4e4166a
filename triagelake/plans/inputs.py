"""Queries over what a scan reads and hands on: trees, environments, replies, patches, batches, caches, cells.

As in ``contract``, rows are derived from the driver tables by the same
arithmetic in both engines; these queries are registered beside its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import names as N
from triagelake.operators import advisories as A
from triagelake.operators import findings as R
from triagelake.operators import packages, patches, reach, resolve
from triagelake.operators.graph import checkpointed, table_path
from triagelake.plans import scan
from triagelake.plans.contract import DIFF_SQL, FINDINGS_SQL, TREE, TREE_EDGES, _findings, _kinds, _patches, _tree_parsed, query, table
from triagelake.sources import cache, generations, lockfiles, projects, sinks

c = F.col


@query("""
WITH g AS (SELECT page_id AS j, page_id % 8 AS p, page_id % 7 AS kind, page_id % 8 % 3 AS layout FROM pages),
s AS (SELECT p, any_value(layout) AS layout, coalesce(bool_or(kind < 2), false) AND any_value(layout) = 0 AS src FROM g GROUP BY p),
b AS (SELECT g.*, src, CASE g.layout WHEN 0 THEN CASE WHEN src THEN '' END WHEN 1 THEN 'code.' ELSE 'app' || g.p || '.src.' END AS inner_part, CASE WHEN g.layout = 2 THEN 'app' || g.p || '.' ELSE '' END AS lead FROM g JOIN s USING (p)),
m AS (SELECT p, t AS with_tests, CASE kind WHEN 0 THEN inner_part || 'pkg' || j WHEN 1 THEN inner_part || 'pkg' || j || '.mod' WHEN 2 THEN CASE WHEN t THEN lead || 'tests.test_' || j END WHEN 5 THEN CASE WHEN NOT src THEN lead || 'flat' || j END END AS fqn, kind = 0 AS is_package
  FROM b, (VALUES (false), (true)) w(t)),
top AS (SELECT p, t AS with_tests, 'app' || p AS fqn, true AS is_package FROM s, (VALUES (false), (true)) w(t) WHERE layout = 2)
SELECT p AS project_id, with_tests, fqn, is_package FROM m WHERE fqn IS NOT NULL UNION ALL SELECT * FROM top""")
def source_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File lists of projects with a ``src`` folder, without one, and that are a package themselves."""
    pages = table(spark, sf_dir, "pages").select(c("page_id").alias("j"), (c("page_id") % 8).alias("project_id"))
    inner = F.when(c("project_id") % 3 == 1, "code/").otherwise("src/")
    path = F.expr("CASE j % 7 WHEN 0 THEN concat(inner, 'pkg', j, '/__init__.py') WHEN 1 THEN concat(inner, 'pkg', j, '/mod.py') WHEN 2 THEN concat('tests/test_', j, '.py') WHEN 3 THEN concat('.git/h', j, '.py') WHEN 4 THEN concat('venv/lib/v', j, '.py') WHEN 5 THEN concat('flat', j, '.py') ELSE concat(inner, 'notes', j, '.txt') END")
    rows = pages.withColumn("inner", inner).select("project_id", path.alias("path"))
    rows = rows.unionAll(pages.filter("project_id % 3 = 2").select("project_id", F.lit("__init__.py")).distinct()).withColumn("folder", F.concat(F.lit("/home/app"), "project_id"))
    found = [projects.discover(rows, tests).withColumn("with_tests", F.lit(tests)) for tests in (False, True)]
    return found[0].unionByName(found[1]).select("project_id", "with_tests", "fqn", "is_package")


@query("""
WITH k AS (SELECT p_partkey AS k, p_partkey % 40 AS p FROM part),
d AS (SELECT p, k, 'dist-' || k || '-x' AS distribution, '1.' || k % 9 AS version, k % 25 AS m FROM k WHERE k % 6 <> 5),
o AS (SELECT p, m, min(distribution) AS distribution FROM d GROUP BY ALL)
SELECT k.p AS project_id, k.k AS wanted, CASE WHEN k.k % 4 IN (0, 3) THEN 'top' || k.k % 25 || '/sub' || k.k || '.py' WHEN k.k % 4 = 1 THEN 'top' || k.k % 25 || '/sub' || k.k || '/__init__.py' END AS path, o.distribution, d.version
FROM k LEFT JOIN o ON k.p = o.p AND k.k % 25 = o.m LEFT JOIN d ON d.p = o.p AND d.distribution = o.distribution""")
def installed_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file behind a module name (a plain file before a package), the distribution that owns it, and its version."""
    t = table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), (c("p_partkey") % 40).alias("project_id"))
    held = t.filter("k % 6 <> 5").withColumn("dist", F.expr("concat('Dist_', k, '.X')"))
    dirs = held.select("project_id", F.expr("concat(dist, '-1.', k % 9, '.dist-info')").alias("dir")).unionAll(t.select("project_id", F.expr("concat('top', k, '.egg-link')")))
    records = held.select("project_id", c("dist").alias("distribution"), F.expr("concat('top', k % 25, '/__init__.py,sha256=x,1')").alias("line"))
    files = t.select("project_id", F.explode(F.expr("""CASE k % 4 WHEN 0 THEN array(concat('top', k % 25, '/sub', k, '.py')) WHEN 1 THEN array(concat('top', k % 25, '/sub', k, '/__init__.py'))
      WHEN 2 THEN array(concat('top', k % 25, '/sub', k, '.so')) ELSE array(concat('top', k % 25, '/sub', k, '/__init__.py'), concat('top', k % 25, '/sub', k, '.py')) END""")).alias("path"))
    wanted = t.select("project_id", c("k").alias("wanted"), F.expr("concat('top', k % 25, '.sub', k)").alias("fqn"))
    owned = projects.owning_distribution(projects.module_files(wanted, files), packages.import_names(records))
    versions = projects.installed_distributions(dirs).withColumnRenamed("name", "distribution")
    return owned.join(versions, ["project_id", "distribution"], "left").select("project_id", "wanted", "path", "distribution", "version")


@query("""
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'pkg.f' || doc_id || ',pkg.g' WHEN 1 THEN '' WHEN 5 THEN '' END AS symbols,
  md5('Advisory: A-' || doc_id || chr(10) || chr(10) || left(coalesce(text, ''), 6000) || CASE WHEN doc_id % 3 = 1 THEN chr(10) || chr(10) || 'Fix:' || chr(10) || '+x' ELSE '' END) AS prompt_md5 FROM documents""")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of whole advisories, and replies of every shape: only an object with a list of strings is an answer."""
    said = F.expr("""CASE doc_id % 10 WHEN 0 THEN concat('{"symbols": ["pkg.f', doc_id, '", "pkg.g"]}') WHEN 1 THEN '{"symbols": []}' WHEN 2 THEN '{"symbols": "pkg.f"}' WHEN 3 THEN '{"symbols": ["pkg.f", 7]}'
      WHEN 4 THEN '{"symbols": ["pkg.f"]} and more' WHEN 5 THEN '{"other": 1}' WHEN 6 THEN '["pkg.f"]' WHEN 7 THEN '{"symbols": [{"name": "pkg.f"}]}' ELSE 'no json' END""")
    envelope = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(said.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    reply = F.when(c("doc_id") % 10 == 9, None).when(c("doc_id") % 10 == 8, '{"candidates": []}').otherwise(envelope)
    diff = F.expr("CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '+x' END")
    asked = projects.prompt(F.concat(F.lit("A-"), "doc_id"), c("text"), diff)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(projects.reply_symbols(reply), ",").alias("symbols"), F.md5(asked.cast("binary")).alias("prompt_md5"))


@query(DIFF_SQL + """, v AS (SELECT doc_id, min(pos) FILTER (WHERE NOT h AND used > 12000) AS cut FROM u GROUP BY doc_id),
t AS (SELECT u.doc_id, trim(string_agg(line, chr(10) ORDER BY pos)) AS diff FROM u JOIN v ON u.doc_id = v.doc_id WHERE cut IS NULL OR pos < cut GROUP BY u.doc_id),
b AS (SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents),
s AS (SELECT doc_id, CASE WHEN doc_id % 7 IN (1, 2) THEN 'skipped' WHEN doc_id % 7 = 3 OR (text IS NULL AND doc_id % 11 <> 5) THEN 'failed'
  WHEN doc_id % 11 = 5 OR length('--- a/x' || chr(10) || '+++ b/' || CASE WHEN doc_id % 5 = 0 THEN 'tests/' ELSE 'src/pkg/' END || 'm' || doc_id || '.py' || chr(10)) + length(text) + n + (n + 1) // 4 > 80000 THEN 'refused' ELSE 'reduced' END AS state FROM b)
SELECT s.doc_id AS patch_id, state, CASE state WHEN 'refused' THEN md5('') WHEN 'reduced' THEN md5(coalesce(diff, '')) END AS diff_md5, CASE state WHEN 'refused' THEN 0 WHEN 'reduced' THEN length(coalesce(diff, '')) ELSE -1 END AS n_chars FROM s LEFT JOIN t ON s.doc_id = t.doc_id""")
def patch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit links that can't be fetched, patches that failed, are too long, change tests alone, or are reduced."""
    k = c("patch_id")
    url = F.when(k % 7 == 1, F.concat(F.lit("https://github.com/o/r/pull/"), k)).when(k % 7 == 2, None).otherwise(F.concat(F.lit("https://github.com/o/r/commit/"), F.lpad(F.lower(F.hex(k)), 8, "0")))
    patch = F.when(k % 7 == 3, None).when(k % 11 == 5, F.repeat(F.lit("+ab\n"), F.lit(patches.PATCH_CHARS // 4 + 1))).otherwise(c("patch"))
    out = patches.patch_states(_patches(spark, sf_dir).select("patch_id", url.alias("url"), patch.alias("patch")))
    return out.select("patch_id", "state", F.md5(c("diff").cast("binary")).alias("diff_md5"), F.coalesce(F.length("diff").cast("long"), F.lit(-1)).alias("n_chars"))


@query("""
WITH w AS (SELECT c_custkey AS k, c_custkey % 7 AS p, 'n' || c_custkey AS name FROM customer WHERE c_custkey % 4 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY name) - 1 AS n FROM w),
q AS (SELECT *, n // 8 AS batch, (p + n // 8) % 5 <> 3 AS whole FROM b)
SELECT 'cached' AS status, 'n' || c_custkey AS name, CAST(NULL AS VARCHAR) AS ids FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT CASE WHEN whole THEN 'ok' ELSE 'failed' END, name, CASE WHEN whole THEN CASE WHEN k % 3 = 0 THEN '' ELSE 'A-' || k || ',B-' || k END END FROM q""")
def scan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages split into cached and pending, asked in batches; a reply with a result missing answers none of its batch."""
    t = table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), (c("c_custkey") % 7).alias("project_id"), F.expr("concat('n', c_custkey)").alias("name"), F.lit("1.0").alias("version"))
    split = generations.split(t, t.filter("k % 4 = 0").select("name", "version"), ["name", "version"])
    asked = cache.batches(split.filter("status = 'pending'"), ["name"], 8).withColumn("turn", c("batch"))
    first = asked.groupBy("project_id", "batch").agg(F.array_sort(F.collect_list("name")).alias("all"))
    asked = asked.join(first, ["project_id", "batch"]).withColumn("place", (F.array_position("all", c("name")) - 1).cast("int")).withColumn("batch", F.concat_ws("-", "project_id", "turn"))
    ids = F.when(c("k") % 3 != 0, F.expr("array(concat('A-', k), concat('B-', k))"))
    results = F.array_sort(F.collect_list(F.struct("place", ids.alias("ids"))))
    replies = asked.groupBy("batch", "project_id", "turn").agg(F.transform(results, lambda x: x["ids"]).alias("results"))
    cut = F.when((c("project_id") + c("turn")) % 5 == 3, F.expr("slice(results, 1, size(results) - 1)")).otherwise(c("results"))
    got = scan.whole_batches(replies.select("batch", cut.alias("results")), asked.select("batch", "name", "version", "place"))
    return split.filter("status = 'cached'").select("status", "name", F.lit(None).cast("string").alias("ids")).unionByName(got.select("status", "name", F.array_join("ids", ",").alias("ids")))


@query("""
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL""")
def cache_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writers' generations of one keyed cache, two of them compacted, read as the newest row of each key."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    store = generations.Generations(spark, table_path(spark, "cache"), "user_id long, event_type string, event_id long, ts timestamp_ntz" if dict(rows.dtypes)["ts"] == "timestamp_ntz" else "user_id long, event_type string, event_id long, ts timestamp", ["user_id", "event_type"])
    for part in range(3):
        store.write(cache.newest(rows.filter(c("event_id") % 3 == part), ["user_id", "event_type"], "ts", "event_id"))
        if part == 1:
            store.compact()
    return store.read()


@query("""
WITH g AS (SELECT p_partkey % 10 AS p, p_partkey // 10 AS j FROM part)
SELECT p AS project_id, e.fqn, e.kind, e.origin, j % 4 = 1 AND e.fqn = 'm' || j || '.K.run' AS dynamic, j % 3 = 0 AND e.fqn = 'm' || j || '.K.run' AS unresolved FROM g, LATERAL (VALUES
  ('m' || j, 'module', 'project'), ('m' || j || '.K', 'class', 'project'), ('m' || j || '.K.run', 'method', 'project'), ('m' || j || '.helper_' || j, 'function', 'project'),
  ('lib' || j, 'module', 'dependency'), ('lib' || j || '.core', 'module', 'dependency'), ('lib' || j || '.core.Base', 'class', 'dependency'), ('lib' || j || '.core.Sub', 'class', 'dependency'),
  ('lib' || j || '.core.util', 'function', 'dependency'), ('lib' || j || '.core.lone_' || j, 'function', 'dependency'), ('lib' || j || '.Base', 'external', 'absent'), ('lib' || j || '.util', 'external', 'absent')) e(fqn, kind, origin)""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of both origins, names that only edges know, dynamic calls, and dotted calls that lead nowhere."""
    return resolve.build(_kinds(spark, sf_dir, marked=True))[0].select("project_id", "fqn", "kind", "origin", "dynamic", "unresolved")


@query("""
WITH g AS (SELECT p_partkey % 10 AS p, p_partkey // 10 AS j FROM part), b AS (SELECT p, CAST(count(DISTINCT j) AS INTEGER) AS bases FROM g GROUP BY p)
SELECT p AS project_id, e.node, e.successor, j % 4 = 1 AND e.node = 'm' || j || '.K.run' AS dynamic, e.tails FROM g JOIN b USING (p), LATERAL (VALUES
  ('m' || j || '.K.run', 'm' || j || '.helper_' || j, 0), ('m' || j || '.K.run', 'lib' || j || '.core.lone_' || j, 0), ('lib' || j || '.Base', 'lib' || j || '.core.Base', bases), ('nobody.f' || j, NULL, 0)) e(node, successor, tails)""")
def graph_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors and dynamic marks of nodes, known or not; for nodes outside of the graph the number of the project's definitions that have their last name."""
    nodes, edges = resolve.build(_kinds(spark, sf_dir, marked=True))
    t = table(spark, sf_dir, "part").selectExpr("p_partkey % 10 AS project_id", "p_partkey div 10 AS j")
    asked = t.select("project_id", F.explode(F.expr("array(concat('m', j, '.K.run'), concat('lib', j, '.Base'), concat('nobody.f', j))")).alias("node"))
    out = resolve.successors(asked, edges).join(resolve.dynamic_flags(asked, nodes), ["project_id", "node"]).join(resolve.namesakes(asked, nodes), ["project_id", "node"], "left")
    return checkpointed(out.select("project_id", "node", "successor", "dynamic", F.coalesce("tails", F.lit(0)).cast("int").alias("tails")))


@query("""
WITH k AS (SELECT p_partkey AS k, p_partkey % 20 AS p FROM part)
SELECT p AS project_id, k AS finding_id, k % 4 = 1 AS is_direct, k % 3 = 2 AS suppressible,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'lib.core.f' || k WHEN 2 THEN '' WHEN 3 THEN 'lib.core.f' || k ELSE 'lib.a' || k || ',lib.b' || k END AS verified,
  CASE k % 5 WHEN 2 THEN 'lib.gone' || k WHEN 3 THEN 'lib.gone' || k ELSE '' END AS dropped, k % 5 NOT IN (0, 2) AS usable FROM k""")
def finding_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct packages, findings that may be put aside, and whether any symbol of a finding was confirmed."""
    t = table(spark, sf_dir, "part").select(c("p_partkey").alias("finding_id"), (c("p_partkey") % 20).alias("project_id"))
    rows = t.withColumns({"depth": F.when(c("finding_id") % 4 != 3, (c("finding_id") % 4).cast("int")), "verdict": F.expr("CASE finding_id % 3 WHEN 0 THEN 'reachable' WHEN 2 THEN 'not_reachable' END")})
    symbols = F.expr("""CASE finding_id % 5 WHEN 0 THEN array(cast(NULL AS string)) WHEN 1 THEN array(concat('lib.f', finding_id), concat('lib.core.f', finding_id)) WHEN 2 THEN array(concat('lib.gone', finding_id))
      WHEN 3 THEN array(concat('lib.gone', finding_id), concat('lib.f', finding_id)) ELSE array(concat('lib.b', finding_id), concat('lib.a', finding_id)) END""")
    asked = t.select("project_id", "finding_id", F.explode(symbols).alias("symbol"))
    place = F.when(c("symbol").contains(".gone"), None).otherwise(F.regexp_replace("symbol", r"^lib\.f", "lib.core.f"))
    told = reach.verification(asked, asked.select("project_id", "symbol", place.alias("resolved")).distinct())
    out = R.flags(rows).join(told, ["project_id", "finding_id"])
    return out.select("project_id", "finding_id", "is_direct", "suppressible", F.array_join("verified", ",").alias("verified"), F.array_join("dropped", ",").alias("dropped"), "usable")


@query(f"""
WITH t AS ({TREE}), e AS ({TREE_EDGES}), u AS (SELECT p, dst, string_agg('p-' || src, ',' ORDER BY 'p-' || src) AS parents FROM e GROUP BY ALL)
SELECT t.p AS project_id, 'p-' || t.j AS name, '1.' || t.j % 4 AS version, 0 AS fork_ordinal, parents FROM t LEFT JOIN u ON t.p = u.p AND t.j = u.dst
UNION ALL SELECT t.p, 'p-' || t.j, '1.9', 1, parents FROM t LEFT JOIN u ON t.p = u.p AND t.j = u.dst WHERE t.j % 9 = 4""")
def forked_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that a lockfile resolves twice, and what stands above each name: forks add no edges of their own."""
    entries = checkpointed(lockfiles.entries(checkpointed(_tree_parsed(spark, sf_dir, forks=True))))
    above = packages.parents(packages.edges(entries)).select("project_id", "name", F.array_join("parents", ",").alias("parents"))
    return packages.split_forks(entries).join(above, ["project_id", "name"], "left").select("project_id", "name", "version", "fork_ordinal", "parents")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 > 1 THEN p_name WHEN p_partkey % 3 = 1 THEN p_type ELSE '(no summary)' END AS summary,
  CASE WHEN length(x) <= 60 THEN x ELSE '...' || right(x, 57) END AS short_path,
  CASE WHEN p_partkey % 5 = 0 THEN '9.9' WHEN p_partkey % 4 = 0 THEN 'no fix' WHEN p_partkey % 4 = 1 THEN '1.0' ELSE '1.0 +' || p_partkey % 4 - 1 END AS fix_cell,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://a.example/' || p_partkey ELSE 'https://a.example/' || p_partkey || ' https://b.example' END AS links,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'a|f' ELSE 'a.b' || p_partkey || '|C.m a|b' || p_partkey || '.C.m' END AS some_splits
FROM (SELECT *, '/srv/' || p_name || '/' || p_type || '/' || p_brand || '.py' AS x FROM part)""")
def advisory_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and their fallbacks, cut paths, fix texts, links of a record, and the ways to split a symbol."""
    k = c("p_partkey")
    p = table(spark, sf_dir, "part")
    summary = F.when(k % 4 > 1, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(k % 4 == 1, "  ")
    details = F.when(k % 3 == 1, F.concat("p_type", F.lit("\nmore"))).when(k % 3 == 2, "\nsecond line")
    fixed = F.expr("slice(array('1.0', '2.0', '3.0'), 1, cast(p_partkey % 4 as int))")
    record = F.expr("""to_json(named_struct('references', CASE WHEN p_partkey % 2 = 0 THEN array(named_struct('type', 'WEB', 'url', concat('https://a.example/', p_partkey)), named_struct('type', 'FIX', 'url', ''))
      ELSE array(named_struct('type', 'WEB', 'url', concat('https://a.example/', p_partkey)), named_struct('type', 'WEB', 'url', 'https://b.example')) END))""")
    symbol = F.expr("CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' WHEN 2 THEN 'a.f' ELSE concat('a.b', p_partkey, '.C.m') END")
    splits = N.module_splits(symbol)  # of three and more the longest and the shortest module
    ends = F.when(F.size(splits) > 2, F.array(F.get(splits, F.lit(1)), F.get(splits, F.size(splits) - 1))).otherwise(splits)
    path = F.concat(F.lit("/srv/"), "p_name", F.lit("/"), "p_type", F.lit("/"), "p_brand", F.lit(".py"))
    return p.select(
        "p_partkey", N.summary_line(summary, details).alias("summary"), N.shorten_path(path).alias("short_path"), projects.fix_cell(F.when(k % 5 == 0, "9.9"), fixed).alias("fix_cell"),
        F.array_join(A.reference_urls(A.parse(record)), " ").alias("links"), F.coalesce(F.array_join(F.transform(ends, lambda x: F.concat(x["module"], F.lit("|"), x["attribute"])), " "), F.lit("")).alias("some_splits"),
    )


@query("""
WITH s AS (SELECT c_custkey AS k FROM customer)
SELECT k AS project_id, w.warning FROM s, LATERAL (VALUES
  (CASE WHEN k % 4 = 1 THEN 'advisories_unanswered' END), (CASE WHEN k % 5 = 2 THEN 'advisory_bodies_missing' END), (CASE WHEN k % 7 = 0 THEN 'releases_unanswered' END), (CASE WHEN k % 6 = 3 THEN 'files_not_parsed' END), (CASE WHEN k % 9 = 4 THEN 'symbols_not_verified' END),
  (CASE WHEN k % 3 = 0 THEN 'no_call_graph' WHEN k % 5 = 0 THEN 'quota_exhausted' WHEN k % 8 IN (1, 2) OR k % 11 = 0 THEN 'package_level_verdicts' END), (CASE WHEN k % 10 > 6 AND k % 5 <> 0 THEN 'symbol_lookups_failed' END)) w(warning) WHERE w.warning IS NOT NULL""")
def scan_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan has to say about its gaps; whether symbols can be had follows from the key, the mode and the quota."""
    k = c("k")
    s = table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"))
    rows = projects.availability(s.withColumns({"has_key": k % 8 != 1, "offline": k % 8 == 2, "quota_exhausted": k % 5 == 0}))
    counters = rows.select(
        k.alias("project_id"), (k % 4 == 1).cast("int").alias("packages_unqueried"), (k % 5 == 2).cast("int").alias("bodies_missing"), (k % 7 == 0).cast("int").alias("fix_lookups_failed"),
        (k % 6 == 3).cast("int").alias("unparsed_source_files"), (k % 9 == 4).cast("int").alias("symbols_dropped"), (k % 3 != 0).alias("reachability_analysed"), "quota_exhausted",
        (c("available") & (k % 11 != 0)).alias("symbol_extraction_available"), F.greatest(k % 10 - 6, F.lit(0)).alias("extractions_failed"),
    )
    return projects.warnings(counters)


@query("SELECT c_custkey AS k, c_custkey % 8 NOT IN (1, 2) AS configured, c_custkey % 8 NOT IN (1, 2) AND c_custkey % 5 <> 0 AS available FROM customer")
def model_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("k")
    s = table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"))
    return projects.availability(s.withColumns({"has_key": k % 8 != 1, "offline": k % 8 == 2, "quota_exhausted": k % 5 == 0})).select("k", "configured", "available")


@query(FINDINGS_SQL + """
SELECT CAST(to_json({'project_id': project_id, 'package': package, 'advisory_id': advisory_id, 'verdict': verdict, 'severity': severity, 'actionable': actionable}) AS VARCHAR) AS line FROM findings""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as JSON lines and read back; what only an analysis needs is left out, no row is collapsed."""
    path = table_path(spark, "json")
    rows = _findings(spark, sf_dir).select("project_id", "package", "advisory_id", "verdict", "severity", "actionable")
    sinks.write_json(rows.withColumns({"details": F.lit("long prose"), "references": F.array(F.lit("u")), "fix_commits": F.array(F.lit("v"))}), path)
    return spark.read.text(path).withColumnRenamed("value", "line")
