"""Symbols in source files: definitions, references, signatures and spans of functions.

Python files are parsed by their own grammar; other languages are read by their blocks (``spans``).
Lines of tags are 0-based, lines of spans 1-based. Files that don't parse, are empty or of an unknown language give no rows.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import paths as P
from gneiss.operators import deps
from gneiss.sources import spans

TAGS = "path string, ord long, name string, kind string, tag string, line long"

def python_tree(content: str | None) -> ast.AST | None:
    try:
        return ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def python_tags(content: str | None) -> Iterator[tuple[str, str, str, int]]:
    """(name, kind, def or ref, 0-based line) in the order of lines."""
    tree = python_tree(content)
    out: list[tuple[int, int, str, str, str]] = []
    methods = {id(f) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body} if tree else set()
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, ast.ClassDef):
            out.append((n.lineno, n.col_offset, n.name, "class", "def"))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((n.lineno, n.col_offset, n.name, "method" if id(n) in methods else "function", "def"))
        elif isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
            if name:
                out.append((n.lineno, n.col_offset, name, "call", "ref"))
    for line, _, name, kind, tag in sorted(out):
        yield name, kind, tag, line - 1


def tags(contents: DataFrame) -> DataFrame:
    """contents(path, content) -> path, ord, name, kind, tag (def or ref), line (0-based)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, content in zip(b["path"], b["language"], b["content"], strict=True):
                found = python_tags(content) if language == "python" else (t[:4] for t in spans.tags_of(content, language))
                rows += [(path, i, *x) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "ord", "name", "kind", "tag", "line"])

    told = contents.select("path", "content", P.language(F.col("path")).alias("language")).where("language is not null and content is not null")
    return told.mapInPandas(run, TAGS)


def definition_spans(contents: DataFrame) -> DataFrame:
    """contents(path, content) -> path, name, kind, start, end of definitions, lines 1-based: Python by its grammar, other languages by their blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, content in zip(b["path"], b["language"], b["content"], strict=True):
                if language == "python":
                    tree = python_tree(content)
                    rows += [(path, n.name, "class" if isinstance(n, ast.ClassDef) else "function", n.lineno, n.end_lineno) for n in (ast.walk(tree) if tree else ()) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
                else:
                    rows += [(path, t.name, t.kind, t.line + 1, t.end + 1) for t in spans.tags_of(content, language) if t.tag == "def"]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "start", "end"])

    told = contents.select("path", "content", P.language(F.col("path")).alias("language")).where("language is not null and content is not null")
    return told.mapInPandas(run, "path string, name string, kind string, start long, end long")


def functions(contents: DataFrame) -> DataFrame:
    """contents(path, content) -> path, name, start, end of functions and methods, lines 1-based."""
    return definition_spans(contents).where("kind in ('function', 'method')").select("path", "name", "start", "end")


def python_imports(contents: DataFrame) -> DataFrame:
    """contents(path, content) -> path, target: modules of import statements anywhere in a file, relative ones with their dots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                tree = python_tree(content)
                for n in ast.walk(tree) if tree else ():
                    if isinstance(n, ast.Import):
                        rows += [(path, a.name) for a in n.names]
                    elif isinstance(n, ast.ImportFrom):
                        base = "." * n.level + (n.module or "")
                        rows += [(path, base)] if n.module else []
                        rows += [(path, f"{base}{'.' if n.module else ''}{a.name}") for a in n.names if a.name != "*"]
            yield pd.DataFrame(rows, columns=["path", "target"])

    return contents.where(P.language(F.col("path")) == "python").select("path", "content").mapInPandas(run, "path string, target string")


def signatures(contents: DataFrame) -> DataFrame:
    """Definitions with their parents: path, ord, name, kind, line, parent. Files without any give no rows."""
    return deps.parent_of(tags(contents).where("tag = 'def'")).select("path", "ord", "name", "kind", "line", "parent")


def import_dependencies(contents: DataFrame) -> DataFrame:
    """src, dst, weight of Python files that import others of the corpus."""
    met = deps.resolved_imports(python_imports(contents).distinct(), contents)
    return met.groupBy(F.col("path").alias("src"), F.col("candidate").alias("dst")).agg(F.count_distinct("target").cast("double").alias("weight"))


def call_dependencies(contents: DataFrame) -> DataFrame:
    """caller, callee, line: calls inside functions of names that some file defines."""
    t = tags(contents)
    references = t.where("tag = 'ref'").select("path", "name", (F.col("line") + 1).alias("line"))
    definitions = t.where("tag = 'def' and kind <> 'class'").select("path", "name").distinct()
    return deps.call_edges(references, definitions, functions(contents))
