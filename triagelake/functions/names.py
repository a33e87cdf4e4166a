"""Scalar column builders for names, paths, severities and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity words and their order (unknown sorts lowest and is never filtered by rank).
SEVERITY_RANK = {"unknown": -1, "low": 0, "medium": 1, "high": 2, "critical": 3}
SEVERITY_WORDS = {"low": "low", "moderate": "medium", "medium": "medium", "high": "high", "critical": "critical"}
#: Directories that hold tests, and file names that are tests.
TEST_DIRS = ("test", "tests", "testing")
TEST_FILE = r"^(conftest\.py|test_.*|.*_test\.py)$"


def normalise(name: Column) -> Column:
    """PEP 503 name: runs of ``-_.`` become one hyphen, lower case."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def safe_key(key: Column) -> Column:
    """File-safe cache key of at most 120 characters."""
    return F.substring(F.regexp_replace(key, r"[^A-Za-z0-9._@-]", "_"), 1, 120)


def severity(word: Column) -> Column:
    """Severity word of a record; anything else, null included, is unknown."""
    table = F.create_map(*[F.lit(x) for kv in SEVERITY_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(word)), F.lit("unknown"))


def severity_rank(sev: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, sev), F.lit(-1))


def passes_floor(sev: Column, floor: Column) -> Column:
    """A null floor and an unknown severity always pass."""
    return floor.isNull() | (sev == "unknown") | (severity_rank(sev) >= severity_rank(floor))


def module_fqn(path: Column) -> Column:
    """Dotted module name of a path relative to its root; a package is its ``__init__``."""
    dotted = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


#: Fixed pattern: paths whose changes name no library code (unanchored at the file name on purpose).
SKIP_PATH = r"(^|/)(tests?|testing|dummyserver|docs?|examples?|benchmarks?)/|(^|/)(setup|conftest)\.py$|_test\.py$|test_[^/]*\.py$"


def repo_module(path: Column) -> Column:
    """Module of a repository path, empty for other files and skipped paths."""
    inner = F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"\.py$", "")
    dotted = F.regexp_replace(F.regexp_replace(inner, "/", "."), r"\.__init__$", "")
    return F.when(~path.endswith(".py") | path.rlike(SKIP_PATH), "").otherwise(dotted)


def is_test_path(path: Column) -> Column:
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in TEST_DIRS])) | F.element_at(parts, -1).rlike(TEST_FILE)


def prefixes(fqn: Column) -> Column:
    """Dotted prefixes of a name, longest first, the whole name included."""
    parts = F.split(fqn, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def module_splits(symbol: Column) -> Column:
    """(module, attribute) splits of a symbol, longest module first."""
    parts = F.split(symbol, r"\.")
    n = F.size(parts)
    made = F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), ".").alias("module"), F.array_join(F.slice(parts, i + 1, n), ".").alias("attribute")))
    return F.when(n >= 2, made).otherwise(F.array().cast("array<struct<module:string,attribute:string>>"))


#: One identifier: letters of any script, their marks and digits (UAX 31).
IDENTIFIER = r"[_\p{javaUnicodeIdentifierStart}][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}\u00B7\u0387]*"


def plausible_symbol(symbol: Column, heads: Column) -> Column:
    """At least two identifier parts and nothing else, the first among the distribution's import names."""
    return symbol.rlike(rf"\A{IDENTIFIER}(\.{IDENTIFIER})+\z") & F.array_contains(heads, F.substring_index(symbol, ".", 1))


def fetchable(url: Column) -> Column:
    return url.rlike(r"^https?://github\.com/[^/]+/[^/]+/commit/[0-9a-f]{7,40}$")


def display_id(ident: Column, aliases: Column) -> Column:
    """First alias that is a CVE, else the record's own id."""
    return F.coalesce(F.get(F.filter(aliases, lambda a: a.startswith("CVE-")), F.lit(0)), ident)


def summary_line(summary: Column, details: Column) -> Column:
    first = F.trim(F.get(F.split(details, "\n"), F.lit(0)))
    return F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.nullif(first, F.lit("")), F.lit("(no summary)"))


def shorten_path(path: Column, limit: int = 60) -> Column:
    return F.when(F.length(path) <= limit, path).otherwise(F.concat(F.lit("..."), F.right(path, F.lit(limit - 3))))
