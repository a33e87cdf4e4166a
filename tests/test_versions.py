import random

import pytest
from packaging.specifiers import InvalidSpecifier, SpecifierSet
from packaging.version import InvalidVersion, Version
from pyspark.sql import functions as F

from triagelake.functions import versions as V

SPECS = [">=1.2", "<1.7", "<1.7rc2", ">1.0", ">1.0.post1", "==1.0", "==1.0+abc", "==1.2.*", "!=1.2.*", "~=1.2.1", "~=1.2", "<=1.0", "===1.0", "", ">=1,<3,!=2.0", "bad", ">=1.*", "~=1"]


def some_versions(n=400, seed=1):
    r, out = random.Random(seed), set()
    while len(out) < n:
        s = r.choice(["", "", "v", "1!"]) + ".".join(str(r.randint(0, 3)) for _ in range(r.randint(1, 4)))
        s += r.choice(["", "", "a1", "b", "rc2", "-pre3", ".alpha.1"]) + r.choice(["", "", ".post1", "-2", "post"])
        out.add(s + r.choice(["", "", ".dev1", "dev"]) + r.choice(["", "", "+abc.1", "+1", "x", ".."]))
    return sorted(out)


def known(v):
    try:
        return Version(v)
    except InvalidVersion:
        return None


def test_order_equality_and_text_agree_with_the_standard(spark):
    vs = some_versions()
    df = spark.createDataFrame([(v,) for v in vs], "v string")
    rows = df.select("v", V.version_key(F.col("v")).alias("k"), V.canonical(F.col("v")).alias("c")).filter("k is not null").orderBy("k").collect()
    assert {r.v for r in rows} == {v for v in vs if known(v)}
    for a, b in zip(rows, rows[1:]):
        assert Version(a.v) <= Version(b.v)
        assert (Version(a.v) == Version(b.v)) == (a.k == b.k)
    assert all(str(Version(r.v)) == r.c for r in rows)


def test_dev_numbers_of_nineteen_digits_and_more(spark):
    vs = ["1.0a1.dev9999999999999999999", "1.0a1", "1.0", "1.0.post1.dev99999999999999999999999", "1.0.post1"]
    got = spark.createDataFrame([(v,) for v in reversed(vs)], "v string").orderBy(V.version_key(F.col("v"))).collect()
    assert [r.v for r in got] == vs == sorted(vs, key=Version)


def test_specifiers_agree_with_the_standard(spark):
    vs = [v for v in some_versions(150, 2) if known(v)] + ["1.0", "1.7.0.post1", "1.7rc1", "1.2.9rc1", "1.0+x"]
    df = spark.createDataFrame([(v, s) for v in vs for s in SPECS], "v string, s string")
    for r in df.select("v", "s", V.satisfies(F.col("v"), F.col("s")).alias("x")).collect():
        try:
            want = SpecifierSet(r.s).contains(r.v, prereleases=True)
        except InvalidSpecifier:
            want = None
        assert r.x == want, r


@pytest.mark.parametrize(
    ("installed", "candidates", "want"),
    [("1.0", ["0.9", "1.2", "1.1", "2.0"], "1.1"), ("1.5", ["1.2", "3.0", "2.1"], "2.1"), ("1.0", ["1.0.0"], None), ("1.0", [], None), ("1.0", ["junk", "1.10", "1.9"], "1.9"), ("x", ["1.0"], None)],
)
def test_target(spark, installed, candidates, want):
    df = spark.createDataFrame([(installed, candidates)], "v string, c array<string>")
    assert df.select(V.select_target(F.col("v"), F.col("c"))).first()[0] == want


RANGE = "array<struct<introduced:string,fixed:string,last_affected:string>>"


@pytest.mark.parametrize(
    ("v", "ranges", "want"),
    [
        ("1.5", [("1.0", "2.0", None)], True), ("2.0", [("1.0", "2.0", None)], False), ("2.0", [("1.0", None, "2.0")], True), ("2.1", [("1.0", None, "2.0")], False),
        ("0.5", [("1.0", None, None)], False), ("9", [("0", None, None)], True), ("1", [], False), ("1", [("junk", "0.1", None)], True), ("5", [("0", "junk", None)], True), ("5", [("", "", None)], True),
    ],
)
def test_affected(spark, v, ranges, want):
    df = spark.createDataFrame([(v, ranges)], f"v string, r {RANGE}")
    assert df.select(V.is_affected(F.col("v"), F.col("r"))).first()[0] is want


def test_requirement_first_match_decides(spark):
    df = spark.createDataFrame([(["other>1", 'Foo_Bar>2; extra == "x"', "foo.bar (>=1,<2) ; python_version > '3'", "foo-bar<9"],), (["foo-bar"],), ([],)], "r array<string>")
    assert [r[0] for r in df.select(V.requirement_on(F.col("r"), F.lit("foo-bar"))).collect()] == [">=1,<2", None, None]
