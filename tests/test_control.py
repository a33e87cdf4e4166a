"""Walks over folders, cache generations, control of a model's questions, and strict readers."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from triagelake.functions import names as N
from triagelake.operators import extraction, findings, version_ranks
from triagelake.functions import versions as V
from triagelake.sources import filewalk, projects
from triagelake.sources.generations import Generations, split


def test_replies_of_any_other_shape_are_no_answer(spark):
    wrap = lambda text: json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})
    good = {'{"symbols":["a.b","c"]}': ["a.b", "c"], ' {"more": 1, "symbols" : [ ] } ': [], "{}": [], '{"symbols":["1"]}': ["1"]}
    bad = ['{"symbols":[1,2]}', '{"symbols":[{"a":1}]}', '{"symbols":[true]}', '{"symbols":["a",null]}', '{"symbols":null}', '{"symbols":"a"}', '{"symbols":["a"]} and more', '{"symbols":["a"]}{}', '{"symbols":["a"]}] [1', '{"symbols":["a"]}} {"b":1', '["a"]', '"a"', "oops", ""]
    rows = [(wrap(t), v) for t, v in good.items()] + [(wrap(t), None) for t in bad]
    rows += [(json.dumps(x), None) for x in ({"candidates": []}, {}, "text", {"candidates": [{"content": {"parts": [{"text": 5}]}}]}, {"candidates": [{"content": {"parts": [{"text": {"symbols": []}}]}}]}, {"candidates": {"0": 1}})] + [(None, None), (wrap("{}") + "x", None)]
    got = spark.createDataFrame(rows, "reply string, want array<string>").select(projects.reply_symbols(F.col("reply")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_identifiers_of_any_script(spark):
    texts = ["módulo.función", "a.b\n", "a.b", "a", "a..b", ".a.b", "a.1b", "_x.y2", "模块.函数", "a.b c", "a.b-c", "é.x·y", "", "a.b.", "ａ.b", "²a.b", "a.x²"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(N.plausible_symbol(F.col("t"), F.array(F.substring_index("t", ".", 1)))).collect()]
    assert got == [len(t.split(".")) >= 2 and all(p.isidentifier() for p in t.split(".")) for t in texts]


def test_exit_codes_of_all_projects(spark):
    found = spark.createDataFrame([(1, "reachable"), (2, "unknown")], "project_id long, verdict string")
    parsed = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "ok"), (4, "missing"), (5, "not_toml")], "project_id long, status string")
    got = {g: {r.project_id: r.exit_code for r in findings.fail_gate(found, g, parsed).collect()} for g in findings.GATES}
    assert got == {"never": {1: 0, 2: 0, 3: 0, 4: 2, 5: 2}, "any": {1: 1, 2: 1, 3: 0, 4: 2, 5: 2}, "reachable": {1: 1, 2: 0, 3: 0, 4: 2, 5: 2}}
    with pytest.raises(ValueError):
        findings.fail_gate(found, "sometimes")
    assert findings.fail_gate(found.limit(0), "any", parsed.limit(0)).count() == 0


def test_skipped_folders_are_never_entered(spark, tmp_path):
    texts = {"app/src/pkg/__init__.py": "x = 1\n", "app/src/pkg/deep/a/b/c.py": "y = 2\n", "app/setup.py": "", "app/notes.txt": "no", "two/m.py": "z = 3\n", "two/sub/n.py": "ü = 1\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "two/sub/bad.py").write_bytes(b"\xff\xfe")
    for skipped in ("app/.venv/lib", "app/src/pkg/node_modules/x", "two/build", "two/.git", "two/sub/__pycache__"):
        (tmp_path / skipped).mkdir(parents=True)
        os.mkfifo(tmp_path / skipped / "trap.py")  # whoever opens it waits for ever
    roots = [str(tmp_path / "app"), str(tmp_path / "two") + "/", str(tmp_path / "none")]
    want = {(str(tmp_path / k.split("/")[0]), k.split("/", 1)[1], v) for k, v in texts.items() if k.endswith(".py")} | {(str(tmp_path / "two"), "sub/bad.py", None)}
    for parts in (1, 3, 50):
        df = filewalk.read_trees(spark, roots, parts)
        assert {(r.root.rstrip("/"), r.path, r.source) for r in df.collect()} == want and df.count() == len(want)
        files = df.withColumn("project_id", F.xxhash64("root")).withColumn("folder", F.rtrim("root", F.lit("/")))
        assert {r.fqn for r in projects.discover(files).collect()} == {"pkg", "pkg.deep.a.b.c", "m", "sub.n", "sub.bad"}
    assert {(r.path, r.source) for r in projects.read_sources(spark, str(tmp_path / "app")).collect()} == {(p, s) for root, p, s in want if root.endswith("app")}
    assert len(filewalk.TreeReader(roots, 4).partitions()) >= 4


def cache_of(spark, folder, version=1):
    return Generations(spark, folder, "key string, symbols array<string>, ts long", ["key"], version=version)


def test_two_writers_and_a_reader_lose_and_tear_nothing(spark, tmp_path):
    folder, errors, seen = str(tmp_path / "cache"), [], []
    rows = lambda items: spark.createDataFrame(items, "key string, symbols array<string>, ts long")
    assert cache_of(spark, folder).read().count() == 0 and cache_of(spark, folder).compact() is None
    cache_of(spark, folder).write(rows([("both", ["0"], 0), ("old", ["kept"], 0)]))
    done = threading.Event()

    def writer(me):
        try:
            for k in range(4):
                cache_of(spark, folder).write(rows([(f"{me}-{k}", [me] * 3, k), ("both", [me, str(k)], 2 * k + (me == "b") + 1)]))
                if k == 2 and me == "a":
                    cache_of(spark, folder).compact()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    def reader():
        try:
            while not done.is_set():
                got = cache_of(spark, folder).read().collect()
                assert len({r.key for r in got}) == len(got) and all(len(r.symbols) in (1, 2, 3) for r in got)
                seen.append(len(got))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=writer, args=(m,)) for m in "ab"]
    watch = threading.Thread(target=reader)
    for t in (*threads, watch):
        t.start()
    for t in threads:
        t.join()
    done.set()
    watch.join()
    assert not errors and seen == sorted(seen)
    store = cache_of(spark, folder)
    want = {r.key: list(r.symbols) for r in store.read().collect()}
    assert want == {f"{m}-{k}": [m] * 3 for m in "ab" for k in range(4)} | {"both": ["b", "3"], "old": ["kept"]}
    store.compact()
    assert len(store.live()) == 1 and store.vacuum() > 0 and store.vacuum() == 0
    assert {r.key: list(r.symbols) for r in store.read().collect()} == want
    # a generation whose writer was lost before its commit
    rows([("lost", ["x"], 99)]).write.parquet(f"{folder}/v1/data/gen-lost")
    assert store.read().filter("key = 'lost'").count() == 0
    assert cache_of(spark, folder, version=2).read().count() == 0


def test_a_stale_answer_never_replaces_a_newer_one(spark, tmp_path):
    store = cache_of(spark, str(tmp_path / "c"))
    for ts, text in ((5, "new"), (3, "old"), (5, "a tie")):
        store.write(spark.createDataFrame([("k", [text], ts)], "key string, symbols array<string>, ts long"))
    assert [list(r.symbols) for r in store.read().collect()] == [["new"]]
    wanted = spark.createDataFrame([("k",), ("x",)], "key string")
    assert {(r.key, r.status) for r in split(wanted, store.read(), ["key"]).collect()} == {("k", "cached"), ("x", "pending")}
    assert {(r.key, r.status) for r in split(wanted, store.read(), ["key"], offline=True).collect()} == {("k", "cached"), ("x", "failed")}


def plain_control(questions, cached, log, configured):
    """The scan as a loop: what a client that asks one question after another does and finds."""
    out, ended = {}, {}
    for scan, ord_, advisory, names in sorted(questions, key=lambda q: (q[0], q[1])):
        tries = [log.get((scan, advisory, k)) for k in (1, 2)]
        good = [t is not None and t[0] == 200 and t[1] is not None for t in tries]
        if advisory in cached:
            out[scan, ord_] = "cached"
        elif not configured.get(scan) or not names:
            out[scan, ord_] = "unavailable"
        elif ended.get(scan):
            out[scan, ord_] = "stopped"
        elif tries[0] is None:
            out[scan, ord_] = "ask"
        elif good[0] or good[1]:
            out[scan, ord_] = "answered"
        elif tries[1] is None:
            out[scan, ord_] = "retry"
        else:
            out[scan, ord_] = "failed"
            ended[scan] = tries[1][0] == 429
    return out


def test_control_equals_a_client_in_a_loop(spark):
    rng = random.Random(6)
    questions = [(s, i, f"A{rng.randint(0, 60)}", rng.choice([["pkg"], ["pkg"], ["pkg"], [], None])) for s in range(12) for i in range(25)]
    questions = [q for i, q in enumerate(questions) if (q[0], q[2]) not in {(p[0], p[2]) for p in questions[:i]}]
    cached = {f"A{i}" for i in range(0, 60, 9)}
    log = {}
    for s, _, a, _ in questions:
        for k in (1, 2):
            if rng.random() < 0.9 and (k == 1 or (s, a, 1) in log):
                log[s, a, k] = (rng.choice([200, 200, 200, 429, 500]), rng.choice([["pkg.f", "pkg.f", "other.x"], [], None]), rng.choice(["5", None, "soon"]), rng.choice(["retry in 12.5s", "retry in 900s", "", None]))
    configured = {s: s != 4 for s in range(11)}
    frames = (
        spark.createDataFrame(questions, "scan_id int, ord int, advisory_id string, import_names array<string>"), spark.createDataFrame([(f"v5_{a}", ["pkg.old"]) for a in cached], "key string, symbols array<string>"),
        spark.createDataFrame([(*k, v[0], v[2], v[3], v[1]) for k, v in log.items()], "scan_id int, advisory_id string, attempt int, code int, retry_after string, text string, symbols array<string>"),
        spark.createDataFrame(list(configured.items()), "scan_id int, configured boolean"),
    )
    rows = extraction.control(*frames).collect()
    assert {(r.scan_id, r.ord): r.state for r in rows} == plain_control(questions, cached, log, configured)
    assert {r.state for r in rows} == {"cached", "unavailable", "stopped", "ask", "answered", "retry", "failed"}
    for r in rows:
        assert (r.symbols is not None) == (r.state in ("cached", "answered")) and (r.wait is not None) == (r.state == "retry")
        if r.state == "answered":
            assert list(r.symbols) in ([], ["pkg.f"])
        if r.state == "retry":
            code, _, header, text = log[r.scan_id, r.advisory_id, 1]
            stated = 5.0 if header == "5" else {"retry in 12.5s": 12.5, "retry in 900s": 60.0}.get(text, 0.0)
            assert r.wait == (stated if code == 429 else 0.0)
    kept = {r.key for r in extraction.to_keep(extraction.control(*frames)).collect()}
    assert kept == {f"v5_{r.advisory_id}" for r in rows if r.state == "answered"}
    count = {r.scan_id: (r.cache_hits, r.extractions_failed, r.quota_exhausted) for r in extraction.counters(extraction.control(*frames)).collect()}
    for s in count:
        mine = [r.state for r in rows if r.scan_id == s]
        assert count[s] == (mine.count("cached"), mine.count("failed"), "stopped" in mine)
    assert extraction.control(frames[0].limit(0), *frames[1:]).count() == 0 and extraction.control(frames[0], *(f.limit(0) for f in frames[1:])).filter("state <> 'unavailable'").count() == 0


VERSIONS = ["1.0", "1.0.0", "1", "1.0rc1", "1.0.dev3", "1.0a2.dev1", "1.0.post2", "1.0+abc", "1.0+abc.2", "1.0+2", "2!0.1", "0.9.9", "1.10", "1.9", "1.0.post2.dev1", "v1.0-ALPHA.3", "0", "0.0.1", "1.0.1", "1." + "9" * 60, "1." + "1" + "0" * 60, "junk", "", None, "1.0b1", "1.0-1", "10.0", "2.0"]


def test_places_are_the_order_of_versions(spark):
    packaging = pytest.importorskip("packaging.version")
    df = spark.createDataFrame([(v,) for v in VERSIONS * 2], "v string")
    for part_rows in (500_000, 6):
        got = {r.v: r.place for r in version_ranks.dictionary(df, part_rows).collect()}
        readable = [v for v in VERSIONS if v and v != "junk"]
        assert set(got) == set(readable)
        for a in readable:
            for b in readable:
                x, y = packaging.Version(a), packaging.Version(b)
                assert (got[a] < got[b]) == (x < y) and (got[a] == got[b]) == (x == y), (a, b)
    assert version_ranks.dictionary(df.limit(0)).count() == 0


def test_places_answer_as_row_by_row_keys_do(spark):
    rng = random.Random(7)
    known = [v for v in VERSIONS if v and len(v) < 20]
    rows = []
    for k in range(150):
        ranges = [(rng.choice([None, "", *known]), rng.choice([None, None, "", *known]), rng.choice([None, None, *known])) for _ in range(rng.randint(0, 3))]
        rows.append((k, rng.choice(known), rng.sample(known, rng.randint(0, 4)), ranges, rng.sample(known, rng.randint(0, 12))))
    df = spark.createDataFrame(rows, "k int, version string, fixed array<string>, ranges array<struct<introduced:string,fixed:string,last_affected:string>>, released array<string>")
    want = {r.k: (r.t, r.b, list(r.a)) for r in df.select("k", V.select_target(F.col("version"), F.col("fixed")).alias("t"), V.backport(F.col("version"), F.col("fixed"), F.col("ranges"), F.col("released")).alias("b"), F.transform("released", lambda v: V.is_affected(v, F.col("ranges"))).alias("a")).collect()}
    keys = ["k"]
    ranges = df.select("k", F.inline("ranges"))
    every = df.select(F.explode(F.concat(F.array("version"), "fixed", "released")).alias("v")).unionAll(ranges.select(F.explode(F.array("introduced", "fixed", "last_affected")).alias("v")))
    places = version_ranks.dictionary(every)
    at = lambda rows_: rows_.join(places, "v", "left")
    own, fixed, released = at(df.select("k", F.col("version").alias("v"))), at(df.select("k", F.explode("fixed").alias("v"))), at(df.select("k", F.posexplode("released").alias("pos", "v")))
    spans = version_ranks.intervals(ranges, places, keys)
    targets = {r.k: r.target for r in version_ranks.targets(own, fixed, keys).collect()}
    backs = {r.k: r.back for r in version_ranks.backports(own, fixed, spans, released, keys).collect()}
    hit = {(r.k, r.pos): r.affected for r in version_ranks.affected(released.select("k", "place", "pos"), spans, keys).collect()}
    for k, _, _, _, out in rows:
        assert (targets.get(k), backs.get(k), [hit[k, i] for i in range(len(out))]) == want[k], k
