"""What keeps large tables out of the driver, out of one task and out of second passes."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from triagelake.operators import graph, packages, pysource, resolve
from triagelake.plans import contract, inputs  # noqa: F401 (inputs adds its queries)
from triagelake.sources import lockfiles


def test_a_side_is_not_broadcast_by_the_size_of_its_files(spark, tmp_path):
    spark.range(400_000).select("id", F.concat(F.lit("a long name that compresses well "), F.col("id") % 7).alias("name")).write.parquet(str(tmp_path / "t"))
    rows = lambda: spark.read.parquet(str(tmp_path / "t"))
    plan = lambda: rows().join(rows().select("id", F.col("name").alias("other")), "id")._jdf.queryExecution().executedPlan().toString()
    guess, known = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(guess, None), spark.conf.get(known, None)
    assert "BroadcastHashJoin" in plan()
    with graph.measured_joins(spark):
        assert "SortMergeJoin" in plan() and "BroadcastHashJoin" not in plan()
    assert (spark.conf.get(guess, None), spark.conf.get(known, None)) == before


@pytest.mark.parametrize("name", ["graph_summary", "graph_nodes", "tail_fans", "evidence_paths", "graph_access", "reachability_bfs"])
def test_graph_queries_broadcast_nothing_by_the_size_of_its_files(spark, monkeypatch, name):
    """Neither a table on the way nor the plan that a query returns; small tables stand for large ones by a guess of no bytes."""
    plan, plans = (lambda df: df._jdf.queryExecution().executedPlan().toString()), []
    real = DataFrameWriter.parquet
    monkeypatch.setattr(graph, "GUESSED_BYTES", -1)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: plans.append(plan(self._df)) or real(self, path))
    plans.append(plan(contract.QUERIES[name](spark, "/root/testdata/sf0.001")))
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans)


def test_sources_are_parsed_once_and_by_many_tasks(spark):
    rows = spark.range(40).coalesce(1).select(F.lit(1).alias("project_id"), F.lit("project").alias("origin"), F.concat(F.lit("m"), "id").alias("fqn"), F.lit(False).alias("is_package"), F.lit("x = 1").alias("source"))
    good = pysource.parse_modules(rows).filter("parse_ok")
    assert good._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert good.select(F.spark_partition_id()).distinct().count() > 1


def test_a_graph_resolves_its_calls_once(spark, monkeypatch):
    """Nodes and edges read one table of resolved calls; edges alone need no table of nodes."""
    text = "import b\nclass K(Base):\n    def run(self):\n        b.go()\n        x.stop()\n        x.nowhere()\n"
    mods = [(1, "project", "a", False, text), (1, "project", "b", False, "class Base:\n    pass\ndef go():\n    pass\ndef stop():\n    pass\n"), (1, "project", "bad", False, "def (")]
    parsed = pysource.parse_modules(spark.createDataFrame(mods, "project_id long, origin string, fqn string, is_package boolean, source string"))
    real, plans = resolve.checkpointed, []
    monkeypatch.setattr(resolve, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    nodes, edges = resolve.build(parsed)
    assert sum(p.count("row_number()") > 0 for p in plans) == 1
    assert {r.fqn for r in nodes.filter("unresolved").collect()} == {"a.K.run"}
    n = len(plans)
    assert sorted(map(tuple, resolve.build_edges(parsed).collect())) == sorted(map(tuple, edges.collect()))
    assert len(plans) == n + n - 1 and {("a.K.run", "b.go"), ("a.K.run", "b.stop"), ("a.K", "b.Base"), ("a", "b")} == {(r.src, r.dst) for r in edges.collect()}


def test_facts_in_columns_are_the_facts_of_each_source():
    sources = [None, "def (", "", "import a.b as c\nfrom . import d\nclass K(x.Y, f()):\n    def m(self):\n        getattr(self, 'z')()\n"] * 150
    names = [f"m{i}" for i in range(len(sources))]
    got = pysource.facts(pa.array(sources, pa.string()), names).to_pylist()
    assert got[3]["imports"] == [{"module": None, "name": "a.b", "alias": "c", "level": 0}, {"module": None, "name": "d", "alias": None, "level": 1}]
    flat = lambda x: {k: [tuple(e.values()) if isinstance(e, dict) else e for e in v] if isinstance(v, list) else v for k, v in x.items()}
    assert [flat(g) for g in got] == [pysource.symbols(s, n) for s, n in zip(sources, names, strict=True)]
    assert pysource.facts(pa.array([], pa.string()), []).to_pylist() == []


def test_marks_say_what_the_paths_say(spark):
    r = random.Random(5)
    edges = [(p, f"n{r.randint(0, 9)}", f"n{r.randint(0, 9)}", r.random() < 0.4) for p in range(4) for _ in range(8 + 8 * p)]
    edges += [(4, f"n{i}", f"n{i + 1}", i == 5) for i in range(20)]
    e = spark.createDataFrame(edges, "project_id long, src string, dst string, speculative boolean")
    whole = graph.checkpointed(graph.bfs(e, spark.createDataFrame([(p, "n0") for p in range(6)], "project_id long, node string")))
    targets = whole.select("project_id", "node").unionAll(spark.createDataFrame([(0, "nowhere"), (9, "n0")], "project_id long, node string"))
    paths = sorted(map(tuple, graph.evidence(whole, targets).select("project_id", "node", F.size("path"), "speculative").collect()))
    for how in ("project", "frontier", "auto"):
        assert sorted(map(tuple, graph.evidence_marks(whole, targets, how, 8).collect())) == paths


def test_a_lockfile_is_read_in_pieces(monkeypatch):
    """What pieces say is what the whole text says; no parse sees more than a piece of a plain lockfile."""
    bits = ["[[package]]\n", 'name = "a"\n', '[[package]]\nname = "b"\nversion = "1"\ndependencies = [\n { name = "x" },\n]\n', "[package.metadata]\nrequires-dist = [{ name = 'q', specifier = '<2' }]\n", 's = """\n[[package]]\n"""\n', '"""\n', "x = [\n", "package = []\n", "[manifest]\n", "[[ package ]] # c\r\n", 'source = { virtual = "." }\n', '[["package"]]\n', "é = 1\n"]
    r, flat = random.Random(3), lambda got: (got[0], [e for part in got[1] for e in part.to_pylist()])
    monkeypatch.setattr(lockfiles, "PIECE", 1 << 30)
    for i in range(3000):
        text = ("version = 1\n" * (i % 5 > 0) + "".join(r.choices(bits, [4, 2, 6, 3, 1, 1, 1, 1, 1, 3, 2, 1, 1], k=r.randint(0, 8)))).encode()
        for piece in (1, 60):
            with monkeypatch.context() as m:
                m.setattr(lockfiles, "HEADER", re.compile(b"(?!)"))
                whole = flat(lockfiles.read_lock(text))
            with monkeypatch.context() as m:
                m.setattr(lockfiles, "PIECE", piece)
                assert flat(lockfiles.read_lock(text)) == whole
    long = [0]
    monkeypatch.setattr(lockfiles, "PIECE", 1000)
    loads = lockfiles.tomllib.loads
    monkeypatch.setattr(lockfiles.tomllib, "loads", lambda s: long.append(len(s)) or loads(s))
    status, parts = lockfiles.read_lock(b"version = 1\n" + b'[[package]]\nname = "p"\nversion = "1"\n' * 3000)
    assert status == "ok" and sum(map(len, parts)) == 3000 and max(long) < 1100


def test_entries_keep_their_key_and_depths_choose_their_walk(spark):
    text = 'version = 1\n[[package]]\nname = "p"\nversion = "1"\ndependencies = [{ name = "q" }]\n[[package]]\nname = "q"\nversion = "1"\n'
    rows = graph.checkpointed(lockfiles.entries(graph.checkpointed(lockfiles.parse_lockfiles(spark.createDataFrame([(k, text) for k in range(30)], "project_id int, text string")))))
    assert rows.schema["project_id"].dataType.simpleString() == "int" and rows.count() == 60
    assert {(r.name, r.depth) for r in packages.depths(rows).collect()} == {("p", 0), ("q", 0)}
