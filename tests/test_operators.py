import os
import random
import textwrap

import pytest
from pyspark.sql import functions as F

from triagelake.functions import names as N
from triagelake.operators import advisories as A
from triagelake.operators import fixes, graph, packages, parse_store, patches, pysource, reach, resolve
from triagelake.operators import findings as R
from triagelake.sources import cache, lockfiles, sinks

LOCK = """
version = 1
[[package]]
name = "Sample_Project"
version = "0.1.0"
source = { virtual = "." }
dependencies = [{ name = "PyYAML" }, { name = "requests" }]
[package.metadata]
requires-dist = [{ name = "pyyaml", specifier = "==5.3.1" }, { name = "requests" }]
[[package]]
name = "pyyaml"
version = "5.3.1"
[[package]]
name = "requests"
version = "2.25.1"
dependencies = [{ name = "urllib3" }]
[[package]]
name = "urllib3"
version = "1.26.5"
[[package]]
name = "urllib3"
version = "2.0.0"
[[package]]
name = "orphan"
version = "1"
"""


def test_lockfile_statuses_forks_and_depths(spark):
    texts = [(1, LOCK), (2, None), (3, "not [ toml"), (4, "version = 99"), (5, "version = 1"), (6, "version = 1\n[[package]]\nname = 3"), (7, "version = 1\n[[package]]\nname = 'a'\nversion = '1'\n")]
    parsed = lockfiles.parse_lockfiles(spark.createDataFrame(texts, "project_id long, text string"))
    assert {r.project_id: r.status for r in parsed.collect()} == {1: "ok", 2: "missing", 3: "not_toml", 4: "version", 5: "no_packages", 6: "no_entries", 7: "ok"}
    rows = lockfiles.entries(parsed)
    forks = {(r.name, r.version): r.fork_ordinal for r in packages.split_forks(rows).filter("project_id = 1").collect()}
    assert forks["urllib3", "1.26.5"] == 0 and forks["urllib3", "2.0.0"] == 1
    for strategy in ("project", "frontier"):
        depth = {(r.project_id, r.name): r.depth for r in packages.depths(rows, strategy).collect()}
        assert depth == {(1, "sample-project"): 0, (1, "pyyaml"): 1, (1, "requests"): 1, (1, "urllib3"): 2, (1, "orphan"): -1, (7, "a"): 0}
    assert {(r.name, r.specifier) for r in lockfiles.declared(rows).collect()} == {("pyyaml", "==5.3.1")}
    assert {r.name: r.parents for r in packages.parents(packages.edges(rows)).collect()}["urllib3"] == ["requests"]


def plain_bfs(edges, starts):
    dist, todo = {s: 0 for s in starts}, list(starts)
    for at in todo:
        for a, b in edges:
            if a == at and b not in dist:
                dist[b] = dist[at] + 1
                todo.append(b)
    return dist


def test_both_traversals_agree_on_random_graphs(spark):
    r = random.Random(3)
    edges = [(p, f"n{r.randint(0, 12)}", f"n{r.randint(0, 12)}", r.random() < 0.4) for p in range(4) for _ in range(18)]
    e = spark.createDataFrame(edges, "project_id long, src string, dst string, speculative boolean")
    s = spark.createDataFrame([(p, "n0") for p in range(4)], "project_id long, node string")
    one, two = (sorted(map(tuple, graph.bfs(e, s, k).collect()), key=str) for k in ("project", "frontier"))
    assert one == two
    for p in range(4):
        assert {n: d for q, n, d, _, _ in one if q == p} == plain_bfs([(a, b) for q, a, b, _ in edges if q == p], ["n0"])


def test_large_graphs_are_walked_by_joins_and_small_ones_in_groups(spark):
    """Graphs of 8 to 40 edges and a chain longer than the levels kept apart, under a limit that some pass."""
    r = random.Random(8)
    edges = [(p, f"n{r.randint(0, 9)}", f"n{r.randint(0, 9)}", r.random() < 0.4) for p in range(4) for _ in range(8 + 8 * p)]
    edges += [(4, f"n{i}", f"n{i + 1}", i == 5) for i in range(20)]
    e = spark.createDataFrame(edges, "project_id long, src string, dst string, speculative boolean")
    s = spark.createDataFrame([(p, "n0") for p in range(6)], "project_id long, node string")
    whole = graph.checkpointed(graph.bfs(e, s))
    assert sorted(map(tuple, graph.bfs(e, s, "auto", 18).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    targets = whole.select("project_id", "node").unionAll(spark.createDataFrame([(0, "nowhere"), (9, "n0")], "project_id long, node string"))
    paths = [sorted(map(tuple, graph.evidence(whole, targets, how, 8).collect()), key=str) for how in ("project", "frontier", "auto")]
    assert paths[0] == paths[1] == paths[2] and len(paths[0]) == whole.count()
    assert graph.bfs(e.limit(0), s.limit(0), "auto").count() == 0 and graph.evidence(whole, targets.limit(0), "frontier").count() == 0


def test_intervals_state_machine(spark):
    steps = [("1", None, None), ("2", None, None), (None, "3", None), (None, None, "4"), ("5", "x", None), (None, None, None)]
    df = spark.createDataFrame([(steps,)], f"e array<struct<introduced:string,fixed:string,last_affected:string>>")
    assert [tuple(x) for x in df.select(A.intervals(F.col("e"))).first()[0]] == [("2", "3", None), (None, None, "4"), ("5", None, None)]


@pytest.mark.parametrize("parts", [1, 3])
def test_merge_does_not_depend_on_row_order(spark, parts):
    rows = [
        ("p", 0, "GHSA-1", ["CVE-1"], None, "d", "unknown", ["1.0"], [], [], []),
        ("p", 1, "PYSEC-1", ["CVE-1", "GHSA-1"], "long summary", "dd", "high", ["2.0", "1.0"], ["u"], [], []),
        ("p", 2, "X", None, "s", None, "low", ["3"], None, None, None),
    ]
    random.Random(parts).shuffle(rows)
    kinds = f"package string, ord int, id string, aliases array<string>, summary string, details string, severity string, fixed_versions array<string>, references array<string>, fix_commits array<string>, affected_ranges array<{A.RANGE}>"
    out = {r.display_id: r for r in A.merge(spark.createDataFrame(rows, kinds).repartition(parts), ["package"]).collect()}
    assert set(out) == {"CVE-1", "X"}
    one = out["CVE-1"]
    assert (one.id, one.severity, one.summary, one.details, one.fixed_versions, one.references) == ("PYSEC-1", "high", "long summary", "dd", ["1.0", "2.0"], ["u"])
    assert one.aliases == ["CVE-1", "GHSA-1"] and out["X"].aliases == []


def test_unknown_is_never_clean(spark):
    base = {"name": "p", "version": "1.0", "fixed": ["1.1"], "ranges": [("0", "1.1", None)], "released": ["1.1"], "declared": None, "parents": {}, "parent_upgrades": {}}
    cases = {
        "version_unread": {"version": "?"}, "releases_unanswered": {"released": None}, "constraint_unread": {"declared": "??"}, "parent_constraint_unread": {"parents": {"q": "??"}},
        "in_range": {}, "own_constraint": {"declared": "==1.0"}, "parent_constraint": {"parents": {"q": "<1.1"}}, "no_fix": {"fixed": [], "ranges": []},
        "backport": {"fixed": ["2.0"], "ranges": [("0", None, "1.0")], "released": ["1.1", "2.0"]},
    }
    kinds = "want string, name string, version string, fixed array<string>, ranges array<struct<introduced:string,fixed:string,last_affected:string>>, released array<string>, declared string, parents map<string,string>, parent_upgrades map<string,string>"
    rows = [tuple({"want": k, **base, **v}.values()) for k, v in cases.items()]
    out = fixes.with_fix(spark.createDataFrame(rows, kinds)).collect()
    assert {r.want: r.reason_code for r in out} == {k: k for k in cases}
    shape = {r.want: (r.shape, r.target_version) for r in out}
    assert shape["backport"] == ("backport_exists", "1.1") and shape["version_unread"] == ("unknown", None) and shape["in_range"] == ("lockfile_refresh", "1.1")


def test_severity_and_names(spark):
    df = spark.createDataFrame([("MODERATE",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(N.severity(F.col("s"))).collect()] == ["medium", "unknown", "unknown"]
    floors = spark.createDataFrame([("low", "high"), ("unknown", "critical"), ("low", None), ("high", "high")], "s string, f string")
    assert [r[0] for r in floors.select(N.passes_floor(F.col("s"), F.col("f"))).collect()] == [False, True, True, True]
    one = spark.range(1)
    assert [tuple(x) for x in one.select(N.module_splits(F.lit("a.b.c"))).first()[0]] == [("a.b", "c"), ("a", "b.c")]
    assert one.select(N.module_splits(F.lit("a"))).first()[0] == []
    assert one.select(N.repo_module(F.lit("src/latest_release.py"))).first()[0] == ""
    assert one.select(N.summary_line(F.lit(" "), F.lit("first\nsecond"))).first()[0] == "first"
    assert len(one.select(N.shorten_path(F.lit("x" * 99))).first()[0]) == 60
    assert one.select(N.fetchable(F.lit("https://github.com/o/r/commit/" + "a" * 40))).first()[0]


SOURCE = '''
import os.path
from . import sib as s
@deco(1)
class C(Base, make()):
    x: int = size()
    def m(self, d=first()) -> ret():
        def inner():
            return self.q.run()
        return [f() for f in d]
def top():
    getattr(a, b)
    table[0]()
    importlib.import_module("x")
'''


def test_source_facts():
    out = pysource.symbols(SOURCE, "p.mod")
    assert out["definitions"] == [("p.mod", "module", 1), ("p.mod.C", "class", 5), ("p.mod.C.m", "method", 7), ("p.mod.C.m.inner", "function", 8), ("p.mod.top", "function", 11)]
    calls = {(a, b) for a, b, _ in out["calls"]}
    assert calls == {("p.mod", "deco"), ("p.mod", "make"), ("p.mod.C", "size"), ("p.mod.C", "first"), ("p.mod.C.m.inner", "self.q.run"), ("p.mod.C.m", "f"), ("p.mod.top", "getattr"), ("p.mod.top", "importlib.import_module")}
    assert out["dynamic"] == ["p.mod.C", "p.mod.top"] and out["bases"] == [("p.mod.C", "Base")]
    assert out["imports"] == [(None, "os.path", None, 0), (None, "sib", "s", 1)]
    assert not pysource.symbols("def (", "m")["parse_ok"] and not pysource.symbols(None, "m")["parse_ok"] and pysource.symbols("", "m")["parse_ok"]


def modules(spark, texts, origin="project", project=1):
    rows = [(project, origin, k, k.endswith("__init__") or k == "pkg", textwrap.dedent(v)) for k, v in texts.items()]
    return pysource.parse_modules(spark.createDataFrame(rows, "project_id long, origin string, fqn string, is_package boolean, source string"))


def test_expansion_and_verdicts(spark):
    app = modules(spark, {"app": "import pkg\ndef main():\n    pkg.load()\n"})
    lib = modules(spark, {"pkg": "from .core import load\n", "pkg.core": "def load():\n    parse()\ndef parse():\n    pass\ndef idle():\n    pass\n", "unused": "x = 1\n"}, "dependency")
    extra, status = reach.expand(app, lib)
    assert {r.fqn for r in extra.collect()} == {"pkg", "pkg.core"} and status.first().complete
    nodes, edges = resolve.build(app.unionByName(extra))
    found = spark.createDataFrame([(1, 1, ["pkg"], ["pkg.core.parse"]), (1, 2, ["pkg"], ["pkg.core.idle"]), (1, 3, None, None), (1, 4, ["absent"], None)], "project_id long, finding_id int, import_names array<string>, symbols array<string>")
    out = {r.finding_id: r for r in reach.symbol_verdict(found, nodes, edges, status).collect()}
    assert (out[1].verdict, out[1].path) == ("reachable", ["app.main", "pkg.load", "pkg.core.load", "pkg.core.parse"])
    assert (out[2].verdict, out[2].reason_code) == ("not_reachable", "symbol_not_reached")
    assert (out[3].verdict, out[4].verdict) == ("unknown", "not_reachable")
    late = {r.finding_id: r for r in reach.symbol_verdict(found, nodes, edges, status.withColumn("complete", F.lit(False))).collect()}
    assert late[2].verdict == "unknown"


def test_resolution_order_and_guesses(spark):
    parsed = modules(spark, {"a": "from b import f as g\ndef run():\n    g()\n    run2()\n    x.go()\n    y.gone()\ndef run2():\n    pass\n", "b": "def f():\n    pass\nclass K:\n    def go(self):\n        self.go()\n"})
    out = resolve.resolve(pysource.calls(parsed).drop("line", "pos"), resolve.import_table(parsed), pysource.definitions(parsed))
    got = {(r.caller, r["name"]): (r.target, r.speculative) for r in out.collect()}
    assert got == {("a.run", "g"): ("b.f", False), ("a.run", "run2"): ("a.run2", False), ("a.run", "x.go"): ("b.K.go", True), ("a.run", "y.gone"): (None, False), ("b.K.go", "self.go"): (None, False)}
    nodes, _ = resolve.build(parsed)
    assert {r.fqn for r in nodes.filter("unresolved").collect()} == {"a.run", "b.K.go"}


def test_merge_edges_is_sticky(spark):
    rows = [(1, "a", "b", "imports", True), (1, "a", "b", "calls", False), (1, "a", "c", "calls", True)]
    out = resolve.merge_edges(spark.createDataFrame(rows, "project_id long, src string, dst string, kind string, speculative boolean"))
    assert {(r.dst, r.kind, r.speculative) for r in out.collect()} == {("b", "calls", False), ("c", "calls", True)}


def test_patch_reduction(spark):
    text = "--- a/x\n+++ b/src/pkg/core.py\n@@ -1 +1 @@ def f\n-old\n+new\n one space\n  two\n--gone\n+++ b/tests/test_x.py\n+skipped\n+++ /dev/null\n+gone"
    df = patches.reduce_diffs(spark.createDataFrame([(1, text)], "patch_id int, patch string"))
    assert [r.line for r in df.orderBy("pos").collect()] == ["--- pkg.core ---", "@@ -1 +1 @@ def f", "-old", "+new", "  two", "--gone"]
    assert [r.line for r in patches.budgeted(df, 39).orderBy("pos").collect()] == ["--- pkg.core ---", "@@ -1 +1 @@ def f"]
    shared = patches.share_budget(spark.createDataFrame([(1, 1, "a" * 8), (1, 2, "b" * 8), (1, 3, "c")], "advisory_id int, ord int, diff string"), 10)
    assert [r.diff for r in shared.orderBy("ord").collect()] == ["a" * 8, "bb"]


def test_cache_and_sink(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, "2024-01-01 00:00:00"), ("k", 2, "2024-01-02 00:00:00"), ("old", 3, "2023-01-01 00:00:00")], "key string, v int, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    live = cache.fresh(rows, ["key"], F.lit("2024-01-03 00:00:00").cast("timestamp"))
    assert [(r.key, r.v) for r in live.collect()] == [("k", 2)]
    wanted = spark.createDataFrame([("k",), ("new",)], "key string")
    assert [r.key for r in cache.pending(wanted, live, ["key"]).collect()] == ["new"]
    many = cache.batches(spark.range(250).select(F.lit(1).alias("project_id"), "id"), ["id"])
    assert {r.batch: r["count"] for r in many.groupBy("batch").count().collect()} == {0: 100, 1: 100, 2: 50}
    sinks.write_json(spark.createDataFrame([("a", "long text")], "package string, details string"), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"package":"a"}']


def test_summary_counts_gaps(spark):
    q = spark.createDataFrame([(1, "ok"), (1, "cached"), (2, "failed")], "project_id int, status string")
    f = spark.createDataFrame([(1, "p")], "project_id int, package string")
    assert {r.project_id: (r.complete, r.findings) for r in R.scan_summary(q, f).collect()} == {1: (True, 1), 2: (False, 0)}


def test_stream_keeps_newest(spark, tmp_path):
    from triagelake.streaming import feed

    src = str(tmp_path / "in")
    spark.sql("SELECT 'a' AS key, 1 AS v, TIMESTAMP '2024-01-01 00:00:00' AS ts UNION ALL SELECT 'a', 2, TIMESTAMP '2024-01-01 00:10:00'").write.parquet(src)
    stream = spark.readStream.schema("key string, v int, ts timestamp").parquet(src)
    q = feed.newest_answers(stream, ["key"]).writeStream.format("memory").queryName("newest").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.key, r.v) for r in spark.table("newest").collect()] == [("a", 2)]


def test_starred_facades_and_last_definitions(spark):
    app = modules(spark, {"app": "import pkg\ndef main():\n    pkg.run()\ndef twice():\n    pass\nclass twice:\n    pass\n"})
    lib = modules(spark, {"pkg": "from .core import *\n", "pkg.core": "def run():\n    pass\ndef _hidden():\n    pass\nclass Kind:\n    pass\n"}, "dependency")
    nodes, edges = resolve.build(app.unionByName(lib))
    found = {(r.src, r.dst, r.kind) for r in edges.collect()}
    assert {("pkg.run", "pkg.core.run", "alias"), ("pkg.Kind", "pkg.core.Kind", "alias")} <= found
    assert not any("_hidden" in src for src, _, kind in found if kind == "alias")
    assert {r.fqn: r.kind for r in nodes.collect()}["app.twice"] == "class"



def test_fans_reach_what_the_multiplied_edges_reach(spark):
    app = {"a": "import b\nfrom b import *\nclass K(unknown.Base):\n    def go(self):\n        self.go()\n        q.stop()\ndef run():\n    x.go()\n    K()\n    lost.gone()\n", "b": "import a\nclass Base:\n    pass\nclass L:\n    def go(self):\n        z.run()\n    def stop(self):\n        self.stop()\n", "c": "def stop():\n    w.only()\ndef only():\n    s.only()\n"}
    parsed = modules(spark, app).unionByName(modules(spark, {"lib": "from .core import *\ndef go():\n    k.stop()\n", "lib.core": "class Base(Other):\n    pass\ndef run():\n    pass\n"}, "dependency")).unionByName(modules(spark, app, project=2))
    nodes, edges = resolve.build(parsed)
    fan_nodes, sure, fans = resolve.build_fans(parsed)
    assert sorted(map(str, nodes.collect())) == sorted(map(str, fan_nodes.select(nodes.columns).collect()))
    starts = nodes.filter("fqn in ('a', 'a.run', 'c')").select("project_id", nodes.fqn.alias("node"))
    want = sorted(map(str, graph.bfs(edges, starts).collect()))
    for how in ("project", "frontier"):
        assert sorted(map(str, graph.bfs(sure, starts, how, fans=fans).collect())) == want
    assert sorted(map(str, graph.bfs(sure, starts, "auto", group_rows=1, fans=fans).collect())) == want
    for f in (fans, (fans[0].limit(0), fans[1].limit(0))):
        assert graph.bfs(sure.limit(0), starts.limit(0), "frontier", fans=f).count() == 0


def test_a_tail_of_many_callers_and_definitions_stays_linear(spark):
    many = 10_000
    parsed = modules(spark, {"a": "".join(f"def f{i}():\n    x.go()\n" for i in range(many)), "b": "".join(f"class C{i}:\n    def go(self):\n        pass\n" for i in range(many))})
    nodes, edges, (callers, holders) = resolve.build_fans(parsed)
    assert (edges.count(), callers.count(), holders.count()) == (0, many, many)
    starts = spark.createDataFrame([(1, "a.f7")], "project_id long, node string")
    found = graph.bfs(edges, starts, fans=(callers, holders))
    assert found.filter("dist = 1 and pred = 'a.f7' and via_speculative").count() == many and found.count() == many + 1


def test_long_paths_take_few_rounds(spark, monkeypatch):
    hops = 10_000
    chain = spark.range(hops + 1).selectExpr("1L AS project_id", "concat('n', id) AS node", "int(id) AS dist", "CASE WHEN id > 0 THEN concat('n', id - 1) END AS pred", "id = 5000 AS via_speculative")
    written = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (written.append(1), real(df))[1])
    targets = spark.createDataFrame([(1, f"n{hops}"), (1, "n3"), (1, "n0"), (1, "absent")], "project_id long, node string")
    rows = {r.node: r for r in graph.evidence(chain, targets, "frontier").collect()}
    assert rows[f"n{hops}"].path == [f"n{i}" for i in range(hops + 1)] and rows[f"n{hops}"].speculative
    assert (rows["n3"].path, rows["n3"].speculative, rows["n0"].path, len(rows)) == (["n0", "n1", "n2", "n3"], False, ["n0"], 3)
    assert (len(written) - 1) / 3 < 16  # a round writes three tables


def test_demand_and_fixpoint_agree_and_idle_files_stay_unread(spark):
    app = {"app": "import pkg\nfrom wide import thing\ndef main():\n    pkg.load()\n", "app.sub": "from . import x\nimport broken\n"}
    lib = {"pkg": "from .core import load\n", "pkg.core": "import deep.er\ndef load():\n    pass\n", "deep.er": "x = 1\n", "wide": "from deep import *\n", "deep": "y = 2\n", "broken": "def (:\n", "unused": "import pkg\n"}
    raw = lambda texts: spark.createDataFrame([(p, k, False, v) for p in (1, 2) for k, v in texts.items()] + [(3, k, False, v) for k, v in list(texts.items())[:1]], "project_id long, fqn string, is_package boolean, source string")
    own, there = raw(app), raw(lib).unionAll(spark.createDataFrame([(1, "nothing", False, None)], "project_id long, fqn string, is_package boolean, source string"))
    for budget in (100, 2):
        store = parse_store.ParseStore.of(own, there)
        mine, deps, status = reach.expand_on_demand(own, there, budget, store)
        parsed = lambda df, origin: pysource.parse_modules(df.select("project_id", F.lit(origin).alias("origin"), "fqn", "is_package", "source"))
        want, want_status = reach.expand(parsed(own, "project"), parsed(there, "dependency"), budget)
        key = lambda df: sorted((r.project_id, r.fqn, r.parse_ok, str(r.definitions), str(r.calls)) for r in df.select("*").collect() if r.parse_ok)
        assert key(deps) == key(want)
        assert {(r.project_id, r.modules_parsed, r.complete) for r in status.collect()} == {(r.project_id, r.modules_parsed, r.complete) for r in want_status.collect()}
        assert mine.count() == 5
    held = {d for (d,) in store.held().select("digest").collect()}
    digests = {r.fqn: r.d for r in there.select("fqn", parse_store.digest(F.col("source")).alias("d")).collect()}
    assert digests["unused"] not in held and digests["pkg"] in held
    whole = reach.expand_on_demand(own.limit(0), there, 5)
    assert [df.count() for df in whole] == [0, 0, 0]


def test_a_store_serves_later_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", False, "x = 1\n"), (2, "b.c", False, "x = 1\n"), (2, "d", True, "def f():\n    f()\n")], "project_id long, fqn string, is_package boolean, source string")
    first = parse_store.ParseStore.of(rows, folder=str(tmp_path / "facts"))
    out = {(r.project_id, r.fqn): r for r in first.parsed(parse_store.listed(rows)).collect()}
    assert [d.fqn for d in out[2, "d"].definitions] == ["d", "d.f"] and out[2, "b.c"].definitions[0].fqn == "b.c" and first.held().count() == 2
    later = parse_store.ParseStore.of(rows.limit(0), folder=str(tmp_path / "facts"))
    again = {(r.project_id, r.fqn): r for r in later.parsed(parse_store.listed(rows)).collect()}
    assert again == out and later.held().count() == 2


def plain_verify(texts, symbol, depth=3):
    facts = {m: pysource.symbols(t, m) for m, (t, _) in texts.items()}

    def base(m, level):
        parts = m.split(".")
        keep = len(parts) - level + texts[m][1]
        return ".".join(parts[:keep]) if keep > 0 else None

    def find(s, left):
        parts = s.split(".")
        for cut in range(len(parts) - 1, 0, -1):
            m, rest = ".".join(parts[:cut]), parts[cut:]
            if left < 0 or m not in facts or not facts[m]["parse_ok"]:
                continue
            defs = {f: k for f, k, _ in facts[m]["definitions"]}
            if s in defs:
                return s
            bound, wide = {}, []
            for mod, name, alias, level in facts[m]["imports"]:
                pre = mod if not level else ".".join(x for x in (base(m, level), mod) if x)
                if name == "*":
                    wide.append(pre)
                elif mod is None and not level:
                    bound[alias or name.split(".")[0]] = name if alias else name.split(".")[0]
                else:
                    bound[alias or name] = f"{pre}.{name}"
            onward = [".".join([bound[rest[0]], *rest[1:]])] if rest[0] in bound else []
            onward += [".".join([w, *rest]) for w in wide]
            nested = [f for f, k in defs.items() if k in ("method", "function") and f.endswith("." + ".".join(rest))]
            got = next((r for r in (find(x, left - 1) for x in onward) if r), None) or (nested[0] if len(nested) == 1 else None)
            if got:
                return got
        return None

    return find(symbol, depth)


def test_symbols_are_found_as_a_plain_search_finds_them(spark):
    texts = {
        "pkg": ("from .core import load\nfrom .more import *\nfrom .ring import loop\nfrom .core import C as D\nimport pkg.a as short\n", True), "pkg.core": ("def load():\n    pass\nclass C:\n    def m(self):\n        pass\n    def both(self):\n        pass\nclass E:\n    def both(self):\n        pass\n", False),
        "pkg.more": ("from .empty import *\nfrom .core import *\ndef wide():\n    pass\ndef load():\n    pass\n", False), "pkg.empty": ("", False), "pkg.ring": ("from . import loop\nfrom .ring2 import *\n", False), "pkg.ring2": ("from .ring import *\n", False), "pkg.bad": ("def (", False),
        "pkg.a": ("from .b import deep\nfrom .b import *\n", True), "pkg.a.b": ("from .c import deep\n", True), "pkg.a.b.c": ("from .d import deep\n", True), "pkg.a.b.c.d": ("from .e import deep\n", True), "pkg.a.b.c.d.e": ("def deep():\n    pass\nclass deep2:\n    pass\n", True),
    }
    asked = ["pkg.load", "pkg.wide", "pkg.D.m", "pkg.core.m", "pkg.core.both", "pkg.both", "pkg.loop", "pkg.nope", "pkg.a.deep", "pkg.short.deep", "pkg.a.b.deep", "pkg.a.b.c.d.deep", "pkg.bad.x", "pkg", "other.x", "pkg.more.C.m", "pkg.core.core.m", "pkg.E.both"]
    rows = spark.createDataFrame([(p, k, is_package, t) for p in (1, 2) for k, (t, is_package) in texts.items()], "project_id long, fqn string, is_package boolean, source string")
    symbols = spark.createDataFrame([(p, s) for p in (1, 2) for s in asked] + [(9, "pkg.load")], "project_id long, symbol string")
    want = {(p, s): plain_verify(texts, s) for p in (1, 2) for s in asked} | {(9, "pkg.load"): None}
    assert len({v for v in want.values() if v}) == 5
    parsed = pysource.parse_modules(rows.withColumn("origin", F.lit("dependency")))
    for given in (parsed, reach.stored_modules(parse_store.listed(rows), parse_store.ParseStore.of(rows))):
        assert {(r.project_id, r.symbol): r.resolved for r in reach.verify_symbols(symbols, given).collect()} == want
    assert reach.verify_symbols(symbols.limit(0), parsed).count() == 0 and reach.verify_symbols(symbols, parsed.limit(0)).filter("resolved is not null").count() == 0


def test_an_owner_deletes_its_tables(spark):
    df = spark.createDataFrame([(1, "a", "b")], "project_id long, src string, dst string")
    with graph.workspace(spark) as folder:
        kept = graph.checkpointed(df)
        with graph.workspace(spark) as inner:
            assert graph.checkpointed(df).inputFiles()[0].count("/" + inner.rpartition("/")[2] + "/") == 1
        assert not os.path.exists(inner.removeprefix("file:")) and kept.count() == 1
        found = graph.bfs(df, df.select("project_id", df.src.alias("node")), "frontier").collect()
    assert len(found) == 2 and not os.path.exists(folder.removeprefix("file:"))
    assert graph.checkpointed(df).count() == 1


def test_empty_and_null_rows(spark):
    none = modules(spark, {"a": "x = 1\n"}).limit(0)
    for part in (*resolve.build(none), *resolve.build_fans(none)[:2], resolve.graph_summary(*resolve.build(none), none)):
        assert part.count() == 0
    empty = spark.createDataFrame([], "project_id long, ordinal int, name string, version string, is_root boolean, dependencies array<string>, declared array<struct<name:string,specifier:string>>")
    meta = spark.createDataFrame([], "name string, version string, requires array<string>")
    rows = packages.uses(packages.edges(empty), empty)
    assert [df.count() for df in (packages.split_forks(empty), packages.edges(empty), packages.depths(empty), rows, packages.constraints(rows, meta), packages.one_metadata(meta))] == [0] * 6
    odd = spark.createDataFrame([(1, 0, "a", "1", False, None, None), (1, 1, "b", None, False, ["a", "gone"], [])], empty.schema)
    assert [tuple(r) for r in packages.edges(odd).collect()] == [(1, "b", "a")]
    assert {(r.name, r.depth) for r in packages.depths(odd).collect()} == {("a", 0), ("b", 0)}
    assert [(r.name, r.parent, r.parent_version) for r in packages.uses(packages.edges(odd), odd).collect()] == [("a", "b", None)]
    assert packages.parent_constraints(packages.edges(odd), odd, meta).count() == 0
    found = spark.createDataFrame([], "project_id long, package string, advisory_id string, verdict string, severity string, depth int, actionable boolean")
    assert [df.count() for df in (R.ranked(found), R.package_groups(found), R.verdict_totals(found), R.severity_bars(found), R.fail_gate(found, "any"))] == [0] * 5
    nulls = spark.createDataFrame([(1, "p", None, None, None, None, None), (1, "p", "A", "reachable", "high", 1, True)], found.schema)
    assert [(r.advisory_id, r["rank"]) for r in R.ranked(nulls).orderBy("rank").collect()] == [("A", 1), (None, 2)]
    sides = spark.createDataFrame([], "project_id long, package string, id string, aliases array<string>")
    assert R.scanner_parity(sides, sides).count() == 0 and R.parity_report(sides, sides, spark.createDataFrame([], "project_id long, status string")).count() == 0
