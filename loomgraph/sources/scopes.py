"""Scopes and symbols of Python files, and what a name means in a scope."""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.program import ancestors
from ..session import parallel


def symbols_of(code: str) -> list[tuple[int, int | None, str, str, str, int]]:
    """(scope, parent scope, scope kind, symbol, symbol kind, line); scope 0 is the module."""
    out: list[tuple[int, int | None, str, str, str, int]] = []
    count = 0

    def visit(node: ast.AST, scope: int, parent: int | None, kind: str) -> None:
        nonlocal count
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = "Class" if isinstance(child, ast.ClassDef) else "Function"
                out.append((scope, parent, kind, child.name, "Class" if inner == "Class" else "Method", child.lineno))
                count += 1
                own = count
                if inner == "Function":
                    a = child.args
                    out.extend((own, scope, inner, x.arg, "Parameter", child.lineno) for x in (*a.posonlyargs, *a.args, *a.kwonlyargs))
                visit(child, own, scope, inner)
                continue
            if isinstance(child, (ast.Import, ast.ImportFrom)):
                out.extend((scope, parent, kind, (x.asname or x.name).split(".")[0], "Import", child.lineno) for x in child.names)
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Store):
                out.append((scope, parent, kind, child.id, "Variable", child.lineno))
            visit(child, scope, parent, kind)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            visit(ast.parse(code), 0, None, "Global")
        except (SyntaxError, ValueError, RecursionError):
            return []
    return out


SCHEMA = "file_id bigint, scope int, parent int, scope_kind string, name string, kind string, line int"


def symbols(code_files: DataFrame) -> DataFrame:
    """The symbol table of the Python files (file_id, language, code), each (scope, name, kind) once at its first line."""

    def run(batches):
        for batch in batches:
            rows = [(file_id, *s) for file_id, code in zip(batch.column("file_id").to_pylist(), batch.column("code").to_pylist(), strict=True) if code for s in symbols_of(code)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    rows = parallel(code_files.where("language = 'python'").select("file_id", "code")).mapInArrow(run, SCHEMA)
    return rows.groupBy("file_id", "scope", "name", "kind").agg(F.min("parent").alias("parent"), F.min("scope_kind").alias("scope_kind"), F.min("line").alias("line"))


def resolved(table: DataFrame, uses: DataFrame) -> DataFrame:
    """Uses (file_id, scope, name) with the nearest enclosing scope that has the name; class scopes are passed by from inside."""
    key = lambda s: F.concat_ws(":", F.col("file_id").cast("string"), F.col(s).cast("string"))
    scopes = table.select("file_id", "scope", "parent", "scope_kind").distinct()
    up = ancestors(scopes.where("parent is not null").select(key("scope").alias("child"), key("parent").alias("parent")))
    reach = up.unionByName(scopes.select(key("scope").alias("node"), key("scope").alias("ancestor"), F.lit(0).alias("depth")))
    named = table.select(key("scope").alias("ancestor"), "scope_kind", "name", F.col("scope").alias("found_in"))
    hits = uses.withColumn("node", key("scope")).join(reach, "node").join(named, ["ancestor", "name"]).where("depth = 0 or scope_kind != 'Class'")
    rank = F.row_number().over(Window.partitionBy("file_id", "scope", "name").orderBy("depth"))
    best = hits.withColumn("rank", rank).where("rank = 1").select("file_id", "scope", "name", "found_in")
    return uses.join(best, ["file_id", "scope", "name"], "left")


def template_parts(text: str) -> list[tuple[str, str]]:
    """(`text` or `name`, value) of the parts of an f-string's contents; doubled braces are text."""
    out: list[tuple[str, str]] = []
    for m in re.finditer(r"\{\{|\}\}|\{([^{}!:]+)(?:![rsa])?(?::[^{}]*)?\}|[^{}]+", text):
        if m[1] is not None:
            out.append(("name", m[1].strip()))
        else:
            piece = {"{{": "{", "}}": "}"}.get(m[0], m[0])
            if out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + piece)
            else:
                out.append(("text", piece))
    return out


def split_functions(code: str, java: bool = False) -> list[tuple[str, list[str], str]]:
    """(name, parameters, body) of functions by indentation or braces, for text that no parser accepts."""
    out = []
    if java:
        for m in re.finditer(r"[\w<>\[\], ]+\s+(\w+)\s*\(([^()]*)\)\s*(?:throws [\w., ]+)?\{", code):
            if m[1] in ("if", "for", "while", "switch", "catch", "synchronized"):
                continue
            depth, at = 1, m.end()
            while at < len(code) and depth:
                depth += {"{": 1, "}": -1}.get(code[at], 0)
                at += 1
            out.append((m[1], [p.split()[-1] for p in m[2].split(",") if p.strip()], code[m.end() : at - 1 if not depth else at]))
        return out
    lines = code.split("\n")
    for i, line in enumerate(lines):
        m = re.match(r"([ \t]*)(?:async )?def (\w+)\s*\(([^)]*)\)?", line)
        if not m:
            continue
        body = []
        for later in lines[i + 1 :]:
            if later.strip() and len(later) - len(later.lstrip()) <= len(m[1]):
                break
            body.append(later)
        names = [p.split(":")[0].split("=")[0].strip(" *") for p in m[3].split(",")]
        out.append((m[2], [n for n in names if n], "\n".join(body)))
    return out
