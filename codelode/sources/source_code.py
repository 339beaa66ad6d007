"""Symbols, imports, calls and routes of Python, JavaScript and TypeScript texts.

Each text is read once in an Arrow batch; a text that does not parse gives no
rows but one of kind ``error``, and never ends the job.  The rows are (path,
kind, name, detail, owner, start_line, end_line): ``symbol`` with its type in
detail and its class in owner, ``import`` with the module in name and the
imported names in detail, ``call`` with the callee in name and the enclosing
function in owner, ``route`` with method and path in detail and the handler in
name.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.sources.script_reader import METHODS, Row, script_rows
from codelode.staging import spread

SCHEMA = "repository_id string, path string, kind string, name string, detail string, owner string, start_line int, end_line int"
APPS = frozenset(["app", "router", "api"])
BLUEPRINTS = frozenset(["app", "blueprint", "bp", "api"])


def _routes(f: ast.FunctionDef | ast.AsyncFunctionDef) -> Iterator[Row]:
    for d in f.decorator_list:
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str)):
            continue
        owner = d.func.value.id if isinstance(d.func.value, ast.Name) else None
        path = d.args[0].value
        if d.func.attr in METHODS and (owner is None or owner in APPS):
            yield "route", f.name, f"{d.func.attr.upper()} {path}", "fastapi", f.lineno, f.end_lineno
        elif d.func.attr == "route" and (owner is None or owner in BLUEPRINTS):
            named = next((k.value for k in d.keywords if k.arg == "methods"), None)
            items = [e.value for e in named.elts if isinstance(e, ast.Constant)] if isinstance(named, (ast.List, ast.Tuple)) else ["GET"]
            for m in items:
                yield "route", f.name, f"{str(m).upper()} {path}", "flask", f.lineno, f.end_lineno


def python_rows(text: str) -> list[Row]:
    """Rows of one Python text; calls belong to the function they stand in."""
    out: list[Row] = []

    def visit(node: ast.AST, owner: str | None, function: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if isinstance(n, ast.FunctionDef):
                    out.append(("symbol", n.name, "method" if isinstance(node, ast.ClassDef) else "function", owner if isinstance(node, ast.ClassDef) else None, n.lineno, n.end_lineno))
                out.extend(_routes(n))
                for d in n.decorator_list:
                    visit(d, owner, function)
                visit(n, None, n.name)
            elif isinstance(n, ast.ClassDef):
                out.append(("symbol", n.name, "class", None, n.lineno, n.end_lineno))
                visit(n, n.name, function)
            elif isinstance(n, ast.Import):
                out.extend(("import", a.name, a.asname or a.name, None, n.lineno, None) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                if n.module:
                    out.append(("import", n.module, ",".join(a.name for a in n.names), None, n.lineno, None))
            else:
                if isinstance(n, ast.Call):
                    callee = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
                    if callee:
                        out.append(("call", callee, None, function, n.lineno, None))
                visit(n, owner, function)

    visit(ast.parse(text.removeprefix("﻿")), None, None)
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    warnings.simplefilter("ignore")
    for batch in batches:
        found: list[tuple] = []
        for rid, path, text in zip(*(batch.column(c).to_pylist() for c in ("repository_id", "path", "content"))):
            try:
                rows = python_rows(text) if path.lower().endswith(".py") else script_rows(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                rows = [("error", None, f"{type(e).__name__}: {e}"[:200], None, None, None)]
            found += [(rid, path, *r, i) for i, r in enumerate(rows)]
        cols = list(zip(*found)) or [()] * 9
        types = [pa.string()] * 6 + [pa.int32()] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=[p.split()[0] for p in (SCHEMA + ", seq int").split(", ")])


def analyse(files: DataFrame) -> DataFrame:
    """Rows of the supported files in (repository_id, path, content); a text stored twice for a file counts once.

    Every copy is parsed, and of the rows, numbered within their text, those of
    one copy are kept; texts are shuffled only where a scan has too few splits.
    """
    kept = files.select("repository_id", "path", "content").where(F.lower("path").rlike(r"\.(py|js|jsx|ts|tsx)$") & F.col("content").isNotNull())
    return spread(kept, "repository_id", "path").mapInArrow(_batches, SCHEMA + ", seq int").distinct().drop("seq")
