"""Files below a folder."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..lang.ast import Decl
from .base import Source


def ignored(rel: str, is_dir: bool, patterns: list[str]) -> bool:
    """Whether ignore-file patterns exclude a path; the last that matches decides."""
    out = False
    for raw in patterns:
        keep, p = raw.startswith("!"), raw.removeprefix("!")
        if p.endswith("/"):
            if not is_dir:
                continue
            p = p[:-1]
        anchored = "/" in p
        p = p.removeprefix("/")
        names = [rel] if anchored else [rel, os.path.basename(rel)]
        if any(fnmatch.fnmatchcase(n, p) for n in names):
            out = not keep
    return out


def walk(root: str, ignore: list[str]) -> Iterator[str]:
    """Paths below root with "/" between names: no hidden ones, none that .gitignore files or the patterns exclude."""
    rules: dict[str, list[str]] = {"": list(ignore)}
    for folder, dirs, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        own = list(rules.get(rel, []))
        if ".gitignore" in files:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                for line in (x.strip() for x in f):
                    if line and not line.startswith("#"):
                        neg, body = ("!", line[1:]) if line.startswith("!") else ("", line)
                        own.append(neg + (f"{rel}/{body.removeprefix('/')}" if rel and "/" in body.rstrip("/") else body))
        path = lambda n, rel=rel: f"{rel}/{n}" if rel else n
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not ignored(path(d), True, own))
        for d in dirs:
            rules[path(d)] = own
        for n in sorted(files):
            if not n.startswith(".") and not ignored(path(n), False, own):
                yield path(n)


class FsSource(Source):
    """fs(root, exts, ignore): files(path, ext) of a folder that the driver sees."""

    outputs = {"files": "path string, ext string"}
    keys = ("root", "exts", "ignore")

    def batch(self, spark: SparkSession, wanted: dict[str, Decl]) -> dict[str, DataFrame]:
        exts = {e.lstrip(".") for e in self.listed("exts")}
        rows = [(p, os.path.splitext(p)[1].lstrip(".")) for p in walk(self.setting("root", "."), self.listed("ignore"))]
        return {"files": spark.createDataFrame([r for r in rows if not exts or r[1] in exts], self.outputs["files"])}
