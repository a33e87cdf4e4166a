from pyspark.sql import functions as F

from triagelake.sources import projects as P


def test_discovery(spark, tmp_path):
    files = [(1, p) for p in ("src/pkg/__init__.py", "src/pkg/a.py", "tests/test_a.py", "setup.py", ".git/x.py", "venv/lib/y.py", "src/pkg/readme.md")] + [(2, "m.py"), (2, "sub/tests/x.py"), (2, "sub/n.py")]
    df = spark.createDataFrame(files, "project_id long, path string")
    assert {(r.project_id, r.fqn, r.is_package) for r in P.discover(df).collect()} == {(1, "pkg", True), (1, "pkg.a", False), (2, "m", False), (2, "sub.n", False)}
    assert {r.fqn for r in P.discover(df, True).collect()} == {"pkg", "pkg.a", "tests.test_a", "m", "sub.n", "sub.tests.x"}
    root = tmp_path / "proj"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/ok.py").write_text("x = 1\n")
    (root / "pkg/bad.py").write_bytes(b"\xff\xfe")
    assert {(r.path, r.source) for r in P.read_sources(spark, str(root)).collect()} == {("pkg/ok.py", "x = 1\n"), ("pkg/bad.py", None)}


def test_environments(spark):
    paths = {
        1: ["/a/.venv/lib/python3.12/site-packages/x.py", "/a/.venv/lib/python3.11/site-packages/x.py", "/a/.venv/Lib/site-packages/x.py"],
        2: ["/b/.venv/lib/python3.9/site-packages/x.py", "/b/.venv/lib/python3.10/site-packages/x.py", "/b/env/Lib/site-packages/x.py"],
        3: ["/c/env/lib/python3.9/site-packages/x/y.py"],
        4: ["/c/env/lib/python3.9/site-packages/x.py", "/dd/env/Lib/site-packages/x.py"],
        5: ["/e/.venv/Lib/site-packages/x.py", "/o/site-packages/x.py"],
        6: ["/f/.venv/Lib/site-packages/x.py", "/o/y.py"],
    }
    files = spark.createDataFrame([(k, p) for k, v in paths.items() for p in v], "project_id long, path string")
    rows = [(1, "/a", None, "/a/env"), (2, "/b/", None, "/b/env"), (3, "/c", None, "/c/env/"), (4, "/d", None, "/dd/env"), (5, "/e", "/o/site-packages", None), (6, "/f", "/o", "/f/env"), (7, None, None, None)]
    got = P.site_packages(files, spark.createDataFrame(rows, "project_id long, root string, override string, virtual_env string"))
    assert {r.project_id: (r.site_packages, r.environment_status) for r in got.collect()} == {
        1: ("/a/.venv/Lib/site-packages", "found"), 2: ("/b/.venv/lib/python3.10/site-packages", "found"), 3: ("/c/env/lib/python3.9/site-packages", "found"),
        4: (None, "no_environment"), 5: ("/o/site-packages", "found"), 6: (None, "override_unusable"), 7: (None, "no_environment"),
    }


def test_distributions_and_files(spark):
    dirs = spark.createDataFrame([("a_b-1.0.dist-info",), ("c-d-2.dist-info",), ("junk",)], "dir string")
    assert {tuple(r) for r in P.installed_distributions(dirs).collect()} == {("a-b", "1.0"), ("c-d", "2")}
    files = spark.createDataFrame([("a/b.py",), ("a/b/__init__.py",), ("c/__init__.py",)], "path string")
    wanted = spark.createDataFrame([("a.b",), ("c",), ("sys",)], "fqn string")
    assert {r.fqn: r.path for r in P.module_files(wanted, files).collect()} == {"a.b": "a/b.py", "c": "c/__init__.py", "sys": None}
    names = spark.createDataFrame([("z", "a"), ("y", "a")], "distribution string, import_name string")
    assert {r.fqn: r.distribution for r in P.owning_distribution(wanted, names).collect()} == {"a.b": "y", "c": None, "sys": None}


def test_replies_prompts_cells_warnings(spark):
    wrap = lambda t: '{"candidates":[{"content":{"parts":[{"text":%s}]}}]}' % t
    rows = [wrap('"{\\"symbols\\":[\\"a.b\\"]}"'), wrap('"{\\"symbols\\":[]}"'), wrap('"{\\"symbols\\":\\"a\\"}"'), wrap('"oops"'), "{}", None]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    assert [x[0] for x in df.select(P.reply_symbols(F.col("r"))).collect()] == [["a.b"], [], None, None, None, None]
    one = spark.createDataFrame([("ID", "x" * 7000, None, ["1", "2"])], "i string, d string, p string, f array<string>")
    got = one.select(P.prompt(F.col("i"), F.col("d"), F.col("p")), P.fix_cell(F.col("p"), F.col("f"))).first()
    assert got[0].count("x") == P.DETAIL_CHARS and got[1] == "1 +1"
    counters = spark.createDataFrame([(1, 2, 0), (2, 0, 0)], "project_id int, packages_unqueried int, unparsed_source_files int")
    assert [tuple(r) for r in P.warnings(counters).collect()] == [(1, "advisories_unanswered")]
    asked = spark.createDataFrame([(True, False, True), (True, False, False), (False, False, False)], "has_key boolean, offline boolean, quota_exhausted boolean")
    assert [(r.configured, r.available) for r in P.availability(asked).collect()] == [(True, False), (True, True), (False, False)]
