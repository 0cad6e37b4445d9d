"""Fact rows of Python sources by the standard parser: syntax only, no types across files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SYMBOL = "uri string, symbol_id string, parent_id string, name string, kind int, line int, char int, signature string, doc string"
CALL = "uri string, caller_id string, callee string, line int"


def symbols_of(uri: str, source: str) -> Iterator[tuple]:
    """Classes (5), functions (12), methods (6) and module or class variables (13, 14 for upper case) of a source."""

    def visit(body: list[ast.stmt], parent: str | None, in_class: bool) -> Iterator[tuple]:
        for node in body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{parent or uri}::{node.name}"
                is_class = isinstance(node, ast.ClassDef)
                kind = 5 if is_class else 6 if in_class else 12
                head = f"class {node.name}" if is_class else f"def {node.name}({ast.unparse(node.args)})"
                yield uri, name, parent, node.name, kind, node.lineno - 1, node.col_offset + (6 if is_class else 10 if isinstance(node, ast.AsyncFunctionDef) else 4), head, ast.get_docstring(node)
                if is_class:
                    yield from visit(node.body, name, True)
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name):
                        yield uri, f"{parent or uri}::{target.id}", parent, target.id, 14 if target.id.isupper() else 13, target.lineno - 1, target.col_offset, target.id, None

    yield from visit(ast.parse(source).body, None, False)


def calls_of(uri: str, source: str) -> Iterator[tuple]:
    """Calls by name within each function or method."""

    def visit(body: list[ast.stmt], parent: str | None) -> Iterator[tuple]:
        for node in body:
            if isinstance(node, ast.ClassDef):
                yield from visit(node.body, f"{parent or uri}::{node.name}")
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = f"{parent or uri}::{node.name}"
                for x in ast.walk(node):
                    if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute)):
                        yield uri, own, x.func.id if isinstance(x.func, ast.Name) else x.func.attr, x.lineno - 1

    yield from visit(ast.parse(source).body, None)


def _table(files: DataFrame, make, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for uri, text in zip(frame["uri"], frame["text"], strict=True):
                try:
                    rows.extend(make(uri, text))
                except SyntaxError:
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.select("uri", "text").mapInPandas(run, schema)


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (uri, text); files that do not parse have none."""
    return _table(files, symbols_of, SYMBOL)


def python_calls(files: DataFrame) -> DataFrame:
    return _table(files, calls_of, CALL)
