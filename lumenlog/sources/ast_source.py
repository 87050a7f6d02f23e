"""Syntax trees of Python files as relations."""

from __future__ import annotations

import ast
import io
import os
import tokenize

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.ast import Decl
from .base import Source
from .fs import walk


def parse(file: str, text: str) -> dict[str, list[tuple]]:
    """Rows of each output for one file. The root is "0", child k of p is "p.k"; only leaves have text; lines count from 0."""
    lines = text.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line.encode()))
    out: dict[str, list[tuple]] = {k: [] for k in AstSource.outputs}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        tree = None
    raw = text.encode()

    def visit(node: ast.AST, name: str, parent: str | None, index: int, span: tuple[int, int, int, int]) -> None:
        if hasattr(node, "lineno") and hasattr(node, "end_lineno"):
            span = (starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset, node.lineno - 1, node.end_lineno - 1)
        children = [c for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop))]
        shown = None if children else raw[span[0] : span[1]].decode(errors="replace")
        out["ast_node"].append((file, name, parent, type(node).__name__, 1, shown))
        out["ast_span"].append((file, name, span[0], span[1]))
        out["ast_line"].append((file, name, span[2], span[3]))
        if parent is not None:
            out["ast_child"].append((file, name, index))
        for k, c in enumerate(children):
            visit(c, f"{name}.{k}", name, k, span)

    if tree is not None:
        visit(tree, "0", None, 0, (0, len(raw), 0, max(len(lines) - 1, 0)))
    for k, line in enumerate(lines):
        out["line"].append((file, "python", k, int(not line.strip()), k))
    return out


def comments(text: str) -> list[tuple[int, str]]:
    """Comments by line, for rules that count them."""
    try:
        return [(t.start[0] - 1, t.string) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError):
        return []


class AstSource(Source):
    """ast(root, ignore): five relations of the Python files below a folder; parsing runs on the executors."""

    outputs = {
        "ast_node": "file string, node string, parent string, kind string, named long, text string",
        "ast_span": "file string, node string, start long, end long",
        "ast_child": "file string, node string, idx long",
        "line": "file string, lang string, lineno long, blank long, gid long",
        "ast_line": "file string, node string, start_line long, end_line long",
    }
    keys = ("root", "grammars", "ignore")

    def batch(self, spark: SparkSession, wanted: dict[str, Decl]) -> dict[str, DataFrame]:
        root = self.setting("root", ".")
        rows = []
        for p in walk(root, self.listed("ignore")):
            if p.endswith(".py"):
                with open(os.path.join(root, p), encoding="utf-8", errors="replace") as f:
                    rows.append((p, f.read()))
        files = spark.createDataFrame(rows, "file string, text string").repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))
        names = [n for n in self.outputs if n in wanted or not wanted]
        return {n: files.mapInPandas(_maker(n), self.outputs[n]).select(*(F.col(c.split()[0]) for c in self.outputs[n].split(", "))) for n in names}


def _maker(output: str):
    columns = [c.split()[0] for c in AstSource.outputs[output].split(", ")]

    def run(batches):
        for batch in batches:
            rows = [r for file, text in zip(batch["file"], batch["text"], strict=True) for r in parse(file, text)[output]]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return run
