"""PEP 440 versions and specifiers as native column expressions.

A version is a struct that Spark orders as PEP 440 does, so comparisons stay in
the JVM and push down; text that is no version is NULL and never an error.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: PEP 440 public and local version form.
PATTERN = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|beta|preview|pre|a|b|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
#: The release part of text that is a version.
RELEASE = r"(?i)^\s*v?(?:\d+!)?(\d+(?:\.\d+)*)"
NUM = "decimal(38,0)"
NO_DEV = Decimal(10**38 - 1)  # above every number that NUM holds but one


def _let(value: Column, body) -> Column:
    """Evaluate a value once and use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(v: Column) -> Column:
    """All ten parts of a version by one match."""
    return F.split(F.regexp_replace(v, PATTERN, "|".join(f"${i}" for i in range(1, 11))), r"\|")


def _part(g: Column, i: int) -> Column:
    return F.nullif(F.get(g, F.lit(i - 1)), F.lit(""))


def _num(g: Column, i: int) -> Column:
    return F.coalesce(_part(g, i), F.lit("0")).try_cast(NUM)


def _post(g: Column) -> Column:
    return F.coalesce(_part(g, 5), F.when(_part(g, 6).isNotNull(), F.coalesce(_part(g, 7), F.lit("0"))))


def is_version(v: Column) -> Column:
    return F.coalesce(v.rlike(PATTERN), F.lit(False))


def release(v: Column) -> Column:
    """Release components as written."""
    return F.transform(F.split(F.regexp_extract(v, RELEASE, 1), r"\."), lambda x: x.try_cast(NUM))


def strip_zeros(parts: Column) -> Column:
    last = F.coalesce(F.array_max(F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0))), F.lit(0))
    return F.slice(parts, F.lit(1), last)


def version_key(v: Column, with_local: bool = True) -> Column:
    """Sortable struct, NULL for text that is no version."""
    digits = lambda s: s.rlike(r"^\d+$")
    none = F.array().cast(f"array<struct<n:{NUM},s:string>>")

    def key(g: Column) -> Column:
        pre, dev, post = _part(g, 3), _part(g, 8), _post(g)
        letter = F.lower(F.substring(pre, 1, 1))
        rank = F.when(pre.isNull(), F.when(dev.isNotNull() & post.isNull(), -1).otherwise(3)).when(letter == "a", 0).when(letter == "b", 1).otherwise(2)
        local = F.transform(F.split(F.lower(_part(g, 10)), "[-_.]"), lambda s: F.struct(F.when(digits(s), s.try_cast(NUM)).otherwise(F.lit(-1).cast(NUM)).alias("n"), F.when(digits(s), "").otherwise(s).alias("s")))
        parts = F.transform(F.split(_part(g, 2), r"\."), lambda x: x.try_cast(NUM))
        return F.struct(
            _num(g, 1).alias("e"), strip_zeros(parts).alias("r"), rank.alias("pl"), _num(g, 4).alias("pn"),
            F.coalesce(post.try_cast(NUM), F.lit(-1).cast(NUM)).alias("po"),
            F.when(dev.isNotNull(), _num(g, 9)).otherwise(F.lit(NO_DEV).cast(NUM)).alias("d"),
            (F.coalesce(local, none) if with_local else none).alias("l"),
        )

    return F.when(is_version(v), _let(_groups(v), key))


def sort_key(v: Column) -> Column:
    """Text that sorts, byte by byte, as versions do; NULL for text that is no version.

    Numbers of up to 9,999 digits stand behind their length, so none is cut.
    For tables of distinct versions: plain text sorts and joins faster than a struct.
    """
    bare = lambda s: F.regexp_replace(F.coalesce(s, F.lit("0")), "^0+(?=[0-9])", "")
    sized = lambda s: F.concat(F.lpad(F.length(s).cast("string"), 4, "0"), s)
    num = lambda s: sized(bare(s))

    def key(g: Column) -> Column:
        pre, dev, post = _part(g, 3), _part(g, 8), _post(g)
        letter = F.lower(F.substring(pre, 1, 1))
        rank = F.when(pre.isNull(), F.when(dev.isNotNull() & post.isNull(), "0").otherwise("4")).when(letter == "a", "1").when(letter == "b", "2").otherwise("3")
        parts = F.array_join(F.transform(F.split(_part(g, 2), r"\."), lambda x: F.concat(F.lit("."), num(x))), "")
        local = F.transform(F.split(F.lower(_part(g, 10)), "[-_.]"), lambda s: F.when(s.rlike(r"^\d+$"), F.concat(F.lit("b"), num(s))).otherwise(F.concat(F.lit("a"), s)))
        return F.concat(
            num(_part(g, 1)), F.regexp_replace(parts, r"(\.00010)+$", ""), F.lit("!"), rank, num(_part(g, 4)),
            F.when(post.isNull(), "0").otherwise(F.concat(F.lit("1"), num(post))), F.when(dev.isNull(), "9").otherwise(F.concat(F.lit("0"), num(_part(g, 9)))),
            F.coalesce(F.concat(F.array_join(local, "!"), F.lit("!")), F.lit("")),
        )

    return F.when(is_version(v), _let(_groups(v), key))


def without_local(key: Column) -> Column:
    return F.struct(*[key[n].alias(n) for n in ("e", "r", "pl", "pn", "po", "d")], F.array().cast(f"array<struct<n:{NUM},s:string>>").alias("l"))


def canonical(v: Column) -> Column:
    """Normalised text of a version, NULL if it is none."""
    text = lambda n: n.cast("string")

    def written(g: Column) -> Column:
        letter = F.lower(F.substring(_part(g, 3), 1, 1))
        pre = F.when(letter == "a", "a").when(letter == "b", "b").when(letter.isNotNull(), "rc")
        return F.concat(
            F.when(_num(g, 1) > 0, F.concat(text(_num(g, 1)), F.lit("!"))).otherwise(""),
            F.array_join(F.transform(F.split(_part(g, 2), r"\."), lambda x: text(x.try_cast(NUM))), "."),
            F.coalesce(F.concat(pre, text(_num(g, 4))), F.lit("")),
            F.coalesce(F.concat(F.lit(".post"), text(_post(g).try_cast(NUM))), F.lit("")),
            F.when(_part(g, 8).isNotNull(), F.concat(F.lit(".dev"), text(_num(g, 9)))).otherwise(""),
            F.coalesce(F.concat(F.lit("+"), F.array_join(F.transform(F.split(F.lower(_part(g, 10)), "[-_.]"), lambda s: F.when(s.rlike(r"^\d+$"), text(s.try_cast(NUM))).otherwise(s)), ".")), F.lit("")),
        )

    return F.when(is_version(v), _let(_groups(v), written))


CLAUSE = r"^\s*(~=|===|==|!=|<=|>=|<|>)\s*(\S.*?)\s*$"


def specifier(spec: Column) -> Column:
    """Clauses of a specifier set; NULL if one can't be read, empty for the empty set."""
    cut = F.filter(F.transform(F.split(spec, ","), lambda s: F.trim(s)), lambda s: s != "")

    def clause(s: Column) -> Column:
        op, text = F.regexp_extract(s, CLAUSE, 1), F.regexp_extract(s, CLAUSE, 2)
        wild = op.isin("==", "!=") & text.endswith(".*")
        bare = F.when(wild, F.regexp_replace(text, r"\.\*$", "")).otherwise(text)
        good = (op == "===") | (is_version(bare) & ((op != "~=") | (F.size(release(bare)) >= 2)))
        return F.when(good, F.struct(op.alias("op"), bare.alias("v"), wild.alias("wild")))

    made = F.transform(cut, clause)
    return F.when(F.forall(made, lambda c: c.isNotNull()), made)


def _padded_prefix(parts: Column, n: Column) -> Column:
    zeros = F.array_repeat(F.lit(0).cast(NUM), n)
    return F.slice(F.concat(parts, zeros), F.lit(1), n)


def _clause_holds(c: Column, k: Column) -> Column:
    """``k``: full key, public key, release and text of the version."""
    full, public, parts = k["full"], k["public"], k["parts"]
    local = lambda x: F.size(x["l"]) > 0
    prerelease = lambda x: (x["pl"] < 3) | (x["d"] < NO_DEV)

    def holds(t: Column) -> Column:
        op, theirs, n = c["op"], t["key"], F.size(t["parts"])
        same_base = (public["e"] == theirs["e"]) & (public["r"] == theirs["r"])
        starts = (public["e"] == theirs["e"]) & (_padded_prefix(parts, n) == _padded_prefix(t["parts"], n))
        family = (public["e"] == theirs["e"]) & (_padded_prefix(parts, n - 1) == _padded_prefix(t["parts"], n - 1))
        equal = F.when(c["wild"], starts).when(local(theirs), full == theirs).otherwise(public == theirs)
        return (
            F.when(op == "===", F.lower(F.trim(k["text"])) == F.lower(c["v"]))
            .when(op == "==", equal)
            .when(op == "!=", ~equal)
            .when(op == ">=", public >= theirs)
            .when(op == "<=", public <= theirs)
            .when(op == "<", (full < theirs) & ~(~prerelease(theirs) & prerelease(public) & same_base))
            .when(op == ">", (full > theirs) & ~(~prerelease(theirs) & same_base & (((theirs["po"] < 0) & (public["po"] >= 0)) | local(full))))
            .otherwise((public >= theirs) & family)
        )

    return _let(F.struct(version_key(c["v"]).alias("key"), release(c["v"]).alias("parts")), holds)


def satisfies(v: Column, spec: Column) -> Column:
    """Whether a version meets a specifier set (pre-releases allowed).

    TRUE for a NULL set; NULL where the version or the set can't be read.
    """
    key = lambda k: F.struct(k.alias("full"), without_local(k).alias("public"), release(v).alias("parts"), v.alias("text"))
    held = _let(version_key(v), lambda full: _let(key(full), lambda k: F.forall(specifier(spec), lambda c: _clause_holds(c, k))))
    return F.when(spec.isNull(), F.lit(True)).when(is_version(v), held)


def _keyed(versions: Column) -> Column:
    """Readable versions with key, major and text."""
    made = F.transform(versions, lambda x: F.struct(version_key(x).alias("k"), F.get(release(x), F.lit(0)).alias("major"), x.alias("v")))
    return F.filter(made, lambda x: x["k"].isNotNull())


def newest(versions: Column) -> Column:
    return F.array_max(_keyed(versions))["v"]


def select_target(installed: Column, candidates: Column) -> Column:
    """Lowest candidate above the installed version, on its major if there is one there."""
    at = F.struct(version_key(installed).alias("k"), F.get(release(installed), F.lit(0)).alias("major"))

    def pick(here: Column) -> Column:
        above = F.filter(_keyed(candidates), lambda x: x["k"] > here["k"])
        return _let(above, lambda rows: F.coalesce(F.array_min(F.filter(rows, lambda x: x["major"] == here["major"]))["v"], F.array_min(rows)["v"]))

    return _let(at, pick)


def _absent(bound: Column) -> Column:
    return bound.isNull() | (bound == "")


def _in_range(key: Column, r: Column) -> Column:
    """Whether a version's key lies in one range; a bound that can't be read counts as affected."""
    low, fixed, last = r["introduced"], r["fixed"], r["last_affected"]
    unread = lambda b: ~_absent(b) & ~is_version(b)
    return (
        F.when(unread(low), True)
        .when(~_absent(low) & (key < version_key(low)), False)
        .when(~_absent(fixed), F.coalesce(key < version_key(fixed), F.lit(True)))
        .when(~_absent(last), F.coalesce(key <= version_key(last), F.lit(True)))
        .otherwise(True)
    )


def _affected(key: Column, ranges: Column) -> Column:
    return F.coalesce(F.exists(ranges, lambda r: _in_range(key, r)), F.lit(False))


def is_affected(v: Column, ranges: Column) -> Column:
    return _let(version_key(v), lambda k: _affected(k, ranges))


def backport(installed: Column, fixed: Column, ranges: Column, released: Column) -> Column:
    """Lowest unaffected release above the installed one on its major, where no fix is listed there."""
    at = F.struct(version_key(installed).alias("k"), F.get(release(installed), F.lit(0)).alias("major"))

    def pick(here: Column) -> Column:
        on_major = F.exists(_keyed(fixed), lambda x: x["major"] == here["major"])
        fit = F.filter(_keyed(released), lambda x: (x["major"] == here["major"]) & (x["k"] > here["k"]) & ~_affected(x["k"], ranges))
        return F.when((F.size(ranges) > 0) & ~F.coalesce(on_major, F.lit(False)), F.array_min(fit)["v"])

    return _let(at, pick)


REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*\(?([^;)]*)\)?\s*(?:;(.*))?$"


def requirement_on(requires: Column, name: Column) -> Column:
    """Constraint of a requirement list on a package: the first readable, matching, non-extra entry decides."""
    from .names import normalise

    read = F.transform(F.filter(requires, lambda r: r.rlike(REQUIREMENT)), lambda r: F.struct(normalise(F.regexp_extract(r, REQUIREMENT, 1)).alias("n"), F.trim(F.regexp_extract(r, REQUIREMENT, 2)).alias("s"), F.regexp_extract(r, REQUIREMENT, 3).alias("m")))
    hit = F.get(F.filter(read, lambda r: (r["n"] == normalise(name)) & ~F.contains(r["m"], F.lit("extra")) & ((r["s"] == "") | specifier(r["s"]).isNotNull())), F.lit(0))
    return F.nullif(hit["s"], F.lit(""))
