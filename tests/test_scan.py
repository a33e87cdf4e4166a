"""A whole scan, and the states of its sources."""

import json

from pyspark.sql import functions as F

from triagelake.functions import names as N
from triagelake.operators import fixes, packages, patches
from triagelake.plans import scan
from triagelake.sources import lockfiles
from triagelake.sources import projects as P

LOCK = """version = 1
[[package]]
name = "Me"
version = "0"
source = { virtual = "." }
dependencies = [{ name = "web" }, { name = "PyYAML" }]
[package.metadata]
requires-dist = [{ name = "pyyaml", specifier = "==1.0" }]
[[package]]
name = "web"
version = "1.0"
dependencies = [{ name = "pyyaml" }]
[[package]]
name = "PyYAML"
version = "1.0"
[[package]]
name = "PyYAML"
version = "0.9"
"""


def body(ident, **more):
    return json.dumps({"id": ident, "aliases": ["CVE-1"], "database_specific": {"severity": "HIGH"}, "affected": [{"package": {"name": "pyyaml"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2.0"}]}]}]} | more)


def tables(spark, upgrades=True):
    parsed = lockfiles.parse_lockfiles(spark.createDataFrame([(1, LOCK), (2, None), (3, "x = ["), (4, LOCK)], "project_id long, text string"))
    answers = spark.createDataFrame([("pyyaml", "1.0", "ok", ["A", "A", "B", "gone"]), ("PyYAML", "0.9", "cached", []), ("web", "1.0", "failed", None)], "name string, version string, status string, ids array<string>")
    bodies = spark.createDataFrame([("A", body("A")), ("B", body("B", summary="words")), ("B", None), ("C", "[]")], "id string, body string")
    releases = spark.createDataFrame([("web", ["1.0", "5.0"]), ("PyYAML", ["1.0", "2.0"])], "name string, versions array<string>")
    rows = [("web", "1.0", ["PyYAML<2"]), ("web", "5.0", ["PyYAML"] if upgrades else ["PyYAML<2"])]
    return parsed, answers, bodies, releases, spark.createDataFrame(rows, "name string, version string, requires array<string>")


def test_scan_from_lockfiles_to_findings(spark):
    found, state = scan.scan_findings(*tables(spark))
    rows = found.collect()
    assert {(r.project_id, r.package, r.version, r.advisory_id, r.severity, r.depth, r.shape, r.target_version, r.command, r.verdict) for r in rows} == {(p, "pyyaml", "1.0", "CVE-1", "high", 1, "override", "2.0", 'uv add "web>=5.0"', "unknown") for p in (1, 4)}
    assert [(b.name, b.constraint, b.upgrade_to) for b in rows[0].blocking_parents] == [("web", "<2", "5.0")] and "web <2 forbids 2.0" in rows[0].reason
    assert {(r.project_id, r.name, r.version, r.status, r.bodies_missing) for r in state.collect()} == {(p, *x) for p in (1, 4) for x in (("web", "1.0", "failed", 0), ("pyyaml", "1.0", "ok", 1), ("pyyaml", "0.9", "cached", 0))}
    counts = scan.scan_counters(found, state).filter("project_id = 1").first()
    assert (counts.packages_scanned, counts.advisories_from_cache, counts.packages_unqueried, counts.bodies_missing, counts.findings, counts.fix_lookups_failed, counts.reachability_analysed, counts.complete) == (3, 1, 1, 1, 1, 0, False, False)
    said = {r.warning for r in P.warnings(scan.scan_counters(found, state)).collect()}
    assert said == {"advisories_unanswered", "advisory_bodies_missing", "no_call_graph"}


def test_an_override_is_a_table_of_two_lines(spark):
    found, _ = scan.scan_findings(*tables(spark, upgrades=False))
    assert {r.command for r in found.collect()} == {'[tool.uv]\noverride-dependencies = ["pyyaml>=2.0"]'}


def test_own_constraint_needs_no_upgrade(spark):
    row = spark.createDataFrame([("p", "1.0", ["2.0"], [("0", "2.0", None)], ["1.0", "2.0"], "==1.0", {"q": "<2"}, {"q": "5.0"})], "name string, version string, fixed array<string>, ranges array<struct<introduced:string,fixed:string,last_affected:string>>, released array<string>, declared string, parents map<string,string>, parent_upgrades map<string,string>")
    r = fixes.with_fix(row).first()
    assert (r.shape, r.command) == ("override", 'uv add "q>=5.0"') and r.blocking == ["q", fixes.OWN]


def test_empty_tables(spark):
    parsed, *rest = tables(spark)
    found, state = scan.scan_findings(parsed.limit(0), *(t.limit(0) for t in rest))
    assert found.count() == 0 and state.count() == 0 and scan.scan_counters(found, state).count() == 0
    found, state = scan.scan_findings(parsed, *(t.limit(0) for t in rest))
    assert found.count() == 0 and {r.status for r in state.collect()} == {"failed"}


def test_a_short_reply_answers_nothing(spark):
    asked = spark.createDataFrame([(0, "a", "1", 0), (0, "b", "1", 1), (1, "c", "1", 0), (2, "d", "1", 0)], "batch int, name string, version string, place int")
    replies = spark.createDataFrame([(0, [["X"], None]), (1, [])], "batch int, results array<array<string>>")
    assert {tuple(r)[:1] + (r.status, tuple(r.ids) if r.ids is not None else None) for r in scan.whole_batches(replies, asked).collect()} == {("a", "ok", ("X",)), ("b", "ok", ()), ("c", "failed", None), ("d", "failed", None)}


def test_missing_lockfiles_and_links(spark, tmp_path):
    parsed = lockfiles.parse_lockfiles(spark.createDataFrame([(1, LOCK)], "project_id long, text string"))
    both = lockfiles.with_missing(parsed, spark.createDataFrame([(1,), (7,)], "project_id long"))
    assert {(r.project_id, r.status) for r in both.collect()} == {(1, "ok"), (7, "missing")}
    for name, content in (("a/uv.lock", LOCK.encode()), ("a/poetry.lock", b"other"), ("b/uv.lock", b"\xff\xfe")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = lockfiles.parse_lockfiles(lockfiles.read_lockfiles(spark, str(tmp_path))).collect()
    assert sorted(r.status for r in got) == ["not_toml", "ok"]
    links = spark.createDataFrame([(f"{s}://github.com/o/r/commit/{'a' * 40}",) for s in ("http", "https", "ftp")], "u string")
    assert [r[0] for r in links.select(N.fetchable(F.col("u"))).collect()] == [True, True, False]


def test_names_by_project(spark):
    files = spark.createDataFrame([(1, "/x/app", "__init__.py"), (1, "/x/app", "core.py"), (1, "/x/app", "src/y.py"), (2, "/x/two", "src/z.py"), (2, "/x/two", "other.py")], "project_id long, folder string, path string")
    assert {(r.project_id, r.fqn) for r in P.discover(files).collect()} == {(1, "app"), (1, "app.core"), (1, "app.src.y"), (2, "z")}
    records = spark.createDataFrame([(1, "PyYAML", 'yaml/__init__.py,sha,1'), (2, "Other_Yaml", '"yaml/a,b.py",sha,1')], "project_id long, distribution string, line string")
    names = packages.import_names(records)
    assert {tuple(r) for r in names.collect()} == {(1, "pyyaml", "yaml"), (2, "other-yaml", "yaml")}
    wanted = spark.createDataFrame([(1, "yaml.x"), (2, "yaml.x"), (3, "yaml.x")], "project_id long, fqn string")
    assert {(r.project_id, r.distribution) for r in P.owning_distribution(wanted, names).collect()} == {(1, "pyyaml"), (2, "other-yaml"), (3, None)}
    found = P.module_files(wanted, spark.createDataFrame([(1, "yaml/x.py"), (2, "yaml/x/__init__.py")], "project_id long, path string"))
    assert {(r.project_id, r.path) for r in found.collect()} == {(1, "yaml/x.py"), (2, "yaml/x/__init__.py"), (3, None)}


def test_states_of_patches(spark):
    link = "https://github.com/o/r/commit/" + "a" * 40
    good = "+++ b/src/lib/core.py\n@@ -1 +1 @@\n-a\n+b\nnoise"
    rows = [(1, link, good), (2, link, None), (3, link, "+++ b/lib.py\n+" + "x" * patches.PATCH_CHARS), (4, "https://example.org/x", good), (5, None, good), (6, link, "+++ b/tests/test_a.py\n+x"), (7, link, "")]
    out = patches.patch_states(spark.createDataFrame(rows, "patch_id int, url string, patch string"))
    got = {r.patch_id: (r.state, r.diff) for r in out.collect()}
    assert got == {1: ("reduced", "--- lib.core ---\n@@ -1 +1 @@\n-a\n+b"), 2: ("failed", None), 3: ("refused", ""), 4: ("skipped", None), 5: ("skipped", None), 6: ("reduced", ""), 7: ("reduced", "")}
    assert patches.patch_states(out.limit(0).select("patch_id", out.state.alias("url"), out.diff.alias("patch"))).count() == 0



FORKED = """version = 1
[[package]]
name = "app"
version = "0"
source = { editable = "." }
dependencies = [{ name = "par" }]
[[package]]
name = "par"
version = "1.0"
dependencies = [{ name = "q" }]
[[package]]
name = "par"
version = "2.0"
dependencies = [{ name = "q" }]
[[package]]
name = "q"
version = "1.0"
"""


def forked_tables(spark):
    parsed = lockfiles.parse_lockfiles(spark.createDataFrame([(1, FORKED)], "project_id long, text string"))
    answers = [("q", "1.0", "failed", None), ("q", "1.0", "ok", ["A"]), ("Q", "1.0", "cached", ["B"]), ("par", "1.0", "ok", []), ("par", "2.0", "ok", ["P"])]
    ranged = {"affected": [{"package": {"name": "q"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2.5"}]}]}]}
    bodies = [("A", body("A", **ranged), 2), ("A", body("A", aliases=["zzz"]), 1), ("B", body("B", aliases=["CVE-2"], **ranged), 1), ("P", body("P", aliases=[]), 1)]
    releases = [("q", ["1.0", "2.5"]), ("q", None), ("Q", ["3.0"]), ("par", ["1.0"]), ("par", ["2.0"])]
    meta = [("par", "1.0", ["q<2"]), ("par", "1.0", ["q<2"]), ("par", "1.0", None), ("par", "2.0", ["q<3"])]
    make = lambda rows, kind: (rows, kind)
    return parsed, make(answers, "name string, version string, status string, ids array<string>"), make(bodies, "id string, body string, ts int"), make(releases, "name string, versions array<string>"), make(meta, "name string, version string, requires array<string>")


def test_forked_parents_and_clashing_rows_in_any_order(spark):
    parsed, *rest = forked_tables(spark)
    seen = set()
    for turn in (1, -1):
        found, state = scan.scan_findings(parsed, *(spark.createDataFrame(rows[::turn], kind) for rows, kind in rest))
        rows = sorted(found.collect(), key=lambda r: (r.package, r.advisory_id))
        assert [(r.package, r.version, r.advisory_id, r.shape, r.target_version) for r in rows] == [("par", "2.0", "P", "no_fix", None), ("q", "1.0", "CVE-1", "override", "2.5"), ("q", "1.0", "CVE-2", "override", "2.5")]
        assert [(b.name, b.constraint, b.upgrade_to) for b in rows[1].blocking_parents] == [("par", "<2", "2.0")]  # the first entry alone is asked
        seen.add(tuple(map(str, rows)) + tuple(sorted(map(str, state.collect()))))
    assert len(seen) == 1
    assert {(r.name, r.version, r.status) for r in state.collect()} == {("q", "1.0", "ok"), ("par", "1.0", "ok"), ("par", "2.0", "ok")}


def test_a_thousand_projects_parse_each_body_once(spark):
    parsed, answers, bodies, releases, meta = tables(spark)
    many = parsed.filter("project_id = 1").drop("project_id").crossJoin(spark.range(1000).withColumnRenamed("id", "project_id")).select("project_id", "status", "entries")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    one = bodies.filter("body is not null").withColumn("body", counted.asNondeterministic()("body"))
    found, _ = scan.scan_findings(many, answers, one, releases, meta)
    rows = found.groupBy("advisory_id", "shape", "command").count().collect()
    assert [tuple(r) for r in rows] == [("CVE-1", "override", 'uv add "web>=5.0"', 1000)]
    assert read.value == 3  # A, B and one that nothing asks for


def test_projects_differ_by_their_constraints_alone(spark):
    texts = [(1, LOCK), (2, LOCK.replace('specifier = "==1.0"', 'specifier = ">=1.0"')), (3, LOCK.replace("requires-dist", "requires")), (4, LOCK)]
    parsed = lockfiles.parse_lockfiles(spark.createDataFrame(texts, "project_id long, text string"))
    _, *rest = tables(spark)
    keyed, sets = scan.contexts(lockfiles.entries(parsed), rest[3].withColumn("name", N.normalise(F.col("name"))), spark.createDataFrame([("pyyaml",)], "name string"))
    by = {r.project_id: r.context for r in keyed.collect()}
    assert by[1] == by[4] and len(set(by.values())) == 3
    assert sorted((r.declared or "", str(r.parents)) for r in sets.collect()) == [("", "{'web': '<2'}"), ("==1.0", "{'web': '<2'}"), (">=1.0", "{'web': '<2'}")]


def test_a_rescan_does_again_what_changed_and_equals_a_full_scan(spark):
    parsed, *rest = tables(spark)
    kinds = [t.schema for t in rest]
    rows = [[tuple(r) for r in t.collect()] for t in rest]
    before = scan.Inputs(parsed, *rest)
    found, state = scan.scan_findings(*before)
    found, state = found.cache(), state.cache()

    def changed(new):
        return scan.Inputs(parsed, *(spark.createDataFrame(new.get(i, rows[i]), kinds[i]) for i in range(4)))

    late = lockfiles.parse_lockfiles(spark.createDataFrame([(4, LOCK.replace('"==1.0"', '">=1.0"')), (5, LOCK)], "project_id long, text string"))
    cases = {
        "answer and release": (changed({0: [r if r[0] != "web" else ("web", "1.0", "ok", ["A"]) for r in rows[0]], 2: [("web", ["1.0"]), rows[2][1]]}), {(p, n) for p in (1, 4) for n in ("web", "pyyaml")}),
        "body and metadata": (changed({1: [*rows[1], ("gone", body("gone", aliases=["CVE-7"]))], 3: [rows[3][0], ("web", "5.0", ["PyYAML<2"])]}), {(p, "pyyaml") for p in (1, 4)}),
        "lockfiles": (before._replace(parsed=late), {(p, n) for p in (4, 5) for n in ("web", "pyyaml")}),
    }
    text = lambda df: sorted(str(r.asDict(True)) for r in df.select(sorted(df.columns)).collect())
    for name, (after, want) in cases.items():
        full, full_state = scan.scan_findings(*after)
        again, again_state, redo = scan.rescan(found, state, before, after)
        assert {tuple(r) for r in redo.collect()} == want, name
        assert text(again) == text(full), name
        assert text(again_state) == text(full_state), name
