"""Python source to rows: one Arrow-batched parse, everything after it relational."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import spread

#: Calls that can reach anything.
DYNAMIC_CALLS = frozenset(("getattr", "setattr", "eval", "exec", "__import__", "compile"))
DYNAMIC_TAILS = frozenset(("import_module", "__import__"))

PARSED = (
    "parse_ok boolean, definitions array<struct<fqn:string,kind:string,line:int>>, calls array<struct<caller:string,name:string,line:int>>,"
    " imports array<struct<module:string,name:string,alias:string,level:int>>, dynamic array<string>, bases array<struct<cls:string,base:string>>"
)

_STR, _INT = pa.string(), pa.int32()
#: ``PARSED`` in Arrow's terms.
FACTS = pa.struct(
    [
        ("parse_ok", pa.bool_()),
        ("definitions", pa.list_(pa.struct([("fqn", _STR), ("kind", _STR), ("line", _INT)]))),
        ("calls", pa.list_(pa.struct([("caller", _STR), ("name", _STR), ("line", _INT)]))),
        ("imports", pa.list_(pa.struct([("module", _STR), ("name", _STR), ("alias", _STR), ("level", _INT)]))),
        ("dynamic", pa.list_(_STR)),
        ("bases", pa.list_(pa.struct([("cls", _STR), ("base", _STR)]))),
    ]
)


def static_name(node: ast.AST) -> str | None:
    """Dotted text of a name or attribute chain."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def symbols(source: str | None, fqn: str) -> dict:
    """Facts of one module; ``parse_ok`` false (and nothing else) if it can't be parsed."""
    out: dict = {"parse_ok": False, "definitions": [], "calls": [], "imports": [], "dynamic": set(), "bases": []}
    try:
        tree = ast.parse(source if source is not None else "\0")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out | {"dynamic": []}
    out["parse_ok"] = True
    out["definitions"].append((fqn, "module", 1))
    todo: list[tuple[ast.AST, str, bool]] = [(n, fqn, False) for n in reversed(tree.body)]
    while todo:  # in source order: children go on top, last first
        node, scope, in_class = todo.pop()
        below: list[tuple[ast.AST, str, bool]] = []
        if isinstance(node, ast.ClassDef):
            name = f"{scope}.{node.name}"
            out["definitions"].append((name, "class", node.lineno))
            for base in node.bases:
                text = static_name(base)
                if text is None:
                    out["dynamic"].add(name)
                else:
                    out["bases"].append((name, text))
            outside = [*node.bases, *(k.value for k in node.keywords), *node.decorator_list]
            below = [(n, scope, in_class) for n in outside] + [(n, name, True) for n in node.body]
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            name = f"{scope}.{node.name}"
            out["definitions"].append((name, "method" if in_class else "function", node.lineno))
            outside = [*node.decorator_list, *node.args.defaults, *(d for d in node.args.kw_defaults if d is not None)]
            below = [(n, scope, in_class) for n in outside] + [(n, name, False) for n in node.body]
        else:
            if isinstance(node, ast.Call):
                text = static_name(node.func)
                if text is None:
                    out["dynamic"].add(scope)
                else:
                    if text in DYNAMIC_CALLS or text.rpartition(".")[2] in DYNAMIC_TAILS:
                        out["dynamic"].add(scope)
                    out["calls"].append((scope, text, node.lineno))
            elif isinstance(node, ast.Import):
                out["imports"] += [(None, a.name, a.asname, 0) for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out["imports"] += [(node.module, a.name, a.asname, node.level) for a in node.names]
            below = [(n, scope, in_class) for n in ast.iter_child_nodes(node)]
        todo += reversed(below)
    return out | {"dynamic": sorted(out["dynamic"])}


def facts(sources: pa.Array, names: list[str]) -> pa.Array:
    """Facts of many modules; no rows of Python objects for longer than a few hundred of them."""
    parts = [pa.array([symbols(s.as_py(), n) for s, n in zip(sources[i : i + 256], names[i : i + 256], strict=True)], FACTS) for i in range(0, len(sources), 256)]
    return pa.concat_arrays(parts) if parts else pa.array([], FACTS)


def parse_modules(modules: DataFrame) -> DataFrame:
    """``modules(project_id, origin, fqn, is_package, source)`` with the parsed facts for the source."""

    @F.arrow_udf(PARSED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for source, fqn in batches:
            yield facts(source, fqn.to_pylist())

    run = run.asNondeterministic()  # or a filter on ``parse_ok`` parses everything a second time, before the rows are spread
    rows = spread(modules.select("project_id", "origin", "fqn", "is_package", "source"), "project_id", "fqn")  # sources compress: few splits hold many
    return rows.select("project_id", "origin", "fqn", "is_package", run("source", "fqn").alias("p")).select("project_id", "origin", "fqn", "is_package", "p.*")


def definitions(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("project_id", "origin", F.col("fqn").alias("module"), "dynamic", F.explode("definitions").alias("d"))
    return rows.select("project_id", "origin", "module", "d.fqn", "d.kind", "d.line", F.array_contains("dynamic", F.col("d.fqn")).alias("dynamic"), F.element_at(F.split("d.fqn", r"\."), -1).alias("tail"))


def calls(parsed: DataFrame) -> DataFrame:
    return parsed.select("project_id", "origin", F.col("fqn").alias("module"), F.posexplode("calls").alias("pos", "c")).select("project_id", "origin", "module", "pos", "c.caller", "c.name", "c.line")


def bases(parsed: DataFrame) -> DataFrame:
    return parsed.select("project_id", "origin", F.col("fqn").alias("module"), F.explode("bases").alias("b")).select("project_id", "origin", "module", F.col("b.cls").alias("caller"), F.col("b.base").alias("name"))
