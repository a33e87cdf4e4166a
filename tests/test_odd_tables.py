"""Nulls, repeated rows, clashing columns and empty tables: each has a defined result."""

from pyspark.sql import functions as F

from triagelake.operators import findings as R
from triagelake.operators import packages, patches, reach, resolve
from triagelake.plans import contract, inputs  # noqa: F401 (inputs adds its queries)
from triagelake.sources import projects as P


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_graph_access(spark):
    nodes = spark.createDataFrame([(1, "m", "module", "project", False, False), (1, "m.f", "function", "project", True, False), (1, "x.f", "external", "absent", False, False), (2, "m.f", "function", "dependency", False, False)], "project_id long, fqn string, kind string, origin string, dynamic boolean, unresolved boolean")
    edges = spark.createDataFrame([(1, "m.f", "x.f", "calls", True), (1, "m.f", "x.f", "imports", False), (2, "m.f", None, "calls", False)], "project_id long, src string, dst string, kind string, speculative boolean")
    asked = spark.createDataFrame([(1, "m.f", "z"), (1, "m.f", "z"), (1, "gone", "z"), (2, "m.f", "z"), (None, "m.f", "z"), (1, None, "z")], "project_id long, node string, dynamic string")
    assert rows(resolve.successors(asked, edges)) == sorted([(1, "m.f", "x.f"), (1, "gone", None), (2, "m.f", None), (None, "m.f", None), (1, None, None)], key=repr)
    assert rows(resolve.dynamic_flags(asked, nodes)) == sorted([(1, "m.f", True), (1, "gone", False), (2, "m.f", False), (None, "m.f", False), (1, None, False)], key=repr)
    assert rows(resolve.boundary(nodes)) == [(1, "x.f")]
    assert rows(resolve.definition_index(nodes)) == [(1, "f", "m.f", "project"), (1, "m", "m", "project"), (2, "f", "m.f", "dependency")]
    for df in (resolve.successors(asked.limit(0), edges), resolve.dynamic_flags(asked.limit(0), nodes), resolve.boundary(nodes.limit(0)), resolve.definition_index(nodes.limit(0))):
        assert df.count() == 0
    assert resolve.successors(asked, edges.limit(0)).filter("successor is not null").count() == 0


def test_namesakes_lie_in_any_module(spark):
    """A name that the graph doesn't define meets every definition of its project that ends like it."""
    defined = [(1, "m", "module", "project"), (1, "m.f", "function", "project"), (1, "m.f", "function", "dependency"), (1, "lib.core.f", "function", "dependency"), (1, "far.away.K.f", "method", "dependency"), (1, "lib.f", "external", "absent"), (1, "x.g", "external", "absent"), (2, "m.f", "function", "project"), (None, "m.f", "function", "project")]
    nodes = spark.createDataFrame(defined, "project_id long, fqn string, kind string, origin string")
    asked = spark.createDataFrame([(1, "lib.f", "z"), (1, "lib.f", "z"), (1, "never.seen.f", "z"), (1, "f", "z"), (1, "x.m", "z"), (1, "x.g", "z"), (1, "m.f", "z"), (2, "lib.f", "z"), (3, "lib.f", "z"), (None, "lib.f", "z"), (1, None, "z")], "project_id long, node string, tails string")
    want = [(1, "lib.f", 3), (1, "never.seen.f", 3), (1, "f", 3), (1, "x.m", 1), (1, "x.g", 0), (2, "lib.f", 1), (3, "lib.f", 0), (None, "lib.f", 0), (1, None, 0)]
    assert rows(resolve.namesakes(asked, nodes)) == sorted(want, key=repr)
    assert resolve.namesakes(asked.limit(0), nodes).count() == 0 and not resolve.namesakes(asked, nodes.limit(0)).filter("tails > 0").count()


def test_graph_access_leaves_no_namesake_out(spark):
    got = contract.QUERIES["graph_access"](spark, "/root/testdata/sf0.001").collect()
    there = {(r.project_id, r.fqn) for r in contract.QUERIES["graph_nodes"](spark, "/root/testdata/sf0.001").filter("kind <> 'external'").collect()}
    last = lambda name: name.rsplit(".", 1)[-1]
    pairs = {(r.project_id, r.node): sum(p == r.project_id and last(f) == last(r.node) for p, f in there) for r in got if (r.project_id, r.node) not in there}
    assert {(r.project_id, r.node): r.tails for r in got} == {(r.project_id, r.node): 0 for r in got} | pairs
    assert max(pairs.values()) == 20


def test_flags_and_verification(spark):
    found = spark.createDataFrame([(1, None, None, 7), (1, 1, "not_reachable", 7), (1, 0, "unknown", 7)], "project_id long, depth int, verdict string, usable int")
    assert rows(R.flags(found).select("is_direct", "suppressible")) == [(False, False), (False, False), (True, True)]
    asked = spark.createDataFrame([(1, 1, "a.f"), (1, 1, "a.f"), (1, 1, "a.gone"), (1, 2, None), (2, 1, "a.f")], "project_id long, finding_id long, symbol string")
    told = spark.createDataFrame([(1, "a.f", "a.core.f"), (1, "a.gone", None)], "project_id long, symbol string, resolved string")
    assert rows(reach.verification(asked, told)) == [(1, 1, ["a.core.f"], ["a.gone"], True), (1, 2, [], [], False), (2, 1, [], ["a.f"], False)]
    assert reach.verification(asked.limit(0), told).count() == 0
    assert not reach.verification(asked, told.limit(0)).filter("usable").count()


def test_packages(spark):
    locked = spark.createDataFrame([(1, "A_b", "1", "x"), (1, "c", None, "x"), (None, "a-b", "1", "x"), (1, None, "1", "x")], "project_id long, name string, version string, installed string")
    there = spark.createDataFrame([(1, "a.b", "2"), (1, "c", "3")], "project_id long, name string, version string")
    assert rows(packages.drift(locked.drop("installed"), there).select("project_id", "name", "drift")) == sorted([(1, "a-b", "mismatch"), (None, "a-b", "missing"), (1, None, "missing")], key=repr)
    assert packages.drift(locked.limit(0), there).count() == 0
    records = spark.createDataFrame([("D", None), ("D", ""), ("D", "pkg/a.py,x,1"), ("D", "pkg/a.py,x,1"), (None, "other.py,,")], "distribution string, line string")
    assert rows(packages.import_names(records)) == sorted([("d", "pkg"), (None, "other")], key=repr)
    tops = spark.createDataFrame([("e", "one\ntwo one"), ("d", "spare"), ("f", None), ("g", "")], "distribution string, text string")
    assert rows(packages.import_names(records.filter("distribution is not null"), tops)) == [("d", "pkg"), ("e", "one"), ("e", "two")]
    releases = spark.createDataFrame([("p", ["1.0", None, "junk"]), ("p", None), ("q", None)], "name string, versions array<string>")
    assert {r.name: r.versions for r in packages.one_releases(releases).collect()}["q"] is None
    blocked = spark.createDataFrame([(1, "n", "p", "2.0"), (1, "n", None, "2.0"), (1, "n", "q", None)], "project_id long, name string, parent string, target string")
    meta = spark.createDataFrame([("p", "1.0", ["n<3"])], "name string, version string, requires array<string>")
    assert rows(packages.parent_upgrades(blocked, releases, meta)) == sorted([(1, "n", "p", "2.0", "1.0"), (1, "n", None, "2.0", None), (1, "n", "q", None, None)], key=repr)
    assert packages.parent_upgrades(blocked.limit(0), releases, meta).count() == 0


def test_trees_and_environments(spark):
    files = spark.createDataFrame([(1, None), (1, ""), (1, "a.py"), (1, "a.py"), (None, "b.py"), (2, "__init__.py")], "project_id long, path string")
    assert rows(P.discover(files.filter("project_id is not null and path is not null")).select("project_id", "fqn", "is_package").distinct()) == [(1, "a", False), (2, "2", True)]
    assert P.discover(files).filter("path is null").count() == 0 and P.discover(files.limit(0)).count() == 0
    dirs = spark.createDataFrame([(None,), ("",), ("x-1.dist-info",), ("x.dist-info",)], "dir string")
    assert rows(P.installed_distributions(dirs)) == [("x", "1")]
    wanted = spark.createDataFrame([("a",), (None,), ("a",)], "fqn string")
    assert rows(P.module_files(wanted, files.drop("project_id"))) == sorted([("a", "a.py"), ("a", "a.py"), (None, None)], key=repr)
    settings = spark.createDataFrame([(1, None, None, None), (2, "", "", "")], "project_id long, root string, override string, virtual_env string")
    assert {r.project_id: r.environment_status for r in P.site_packages(files.limit(0), settings).collect()} == {1: "no_environment", 2: "override_unusable"}
    assert P.site_packages(files, settings.limit(0)).count() == 0


def test_patches_and_replies(spark):
    given = spark.createDataFrame([(1, "https://github.com/o/r/commit/abcdef1", ""), (2, None, "+x"), (3, "https://github.com/o/r/commit/abcdef1", None)], "patch_id long, url string, patch string")
    assert rows(patches.patch_states(given)) == [(1, "reduced", ""), (2, "skipped", None), (3, "failed", None)]
    assert patches.patch_states(given.limit(0)).count() == 0
    diffs = spark.createDataFrame([(1, 1, None), (1, 2, "abc"), (1, 3, "def")], "advisory_id long, ord long, diff string")
    assert [(r.ord, r.diff) for r in patches.share_budget(diffs, 4).orderBy("ord").collect()] == [(1, None), (2, "abc"), (3, "d")]
    texts = spark.createDataFrame([(None, None, None), ("A", None, ""), ("A", "d" * 50_000, "+x")], "a string, d string, p string")
    got = [r[0] for r in texts.select(P.prompt(F.col("a"), F.col("d"), F.col("p"))).collect()]
    assert got[0] is None and got[1] == "Advisory: A\n\n" and len(got[2]) == len("Advisory: A\n\n") + P.DETAIL_CHARS + len("\n\nFix:\n+x")
