"""A repository's history as relations."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..lang.ast import Decl
from .base import Source

_FIELD, _RECORD = "\x1f", "\x1e"


class GitSource(Source):
    """git(root, max_commits): commits that HEAD reaches, their parents, and files changed against the first parent (A, M, D or R)."""

    outputs = {
        "commit": "id string, author string, email string, time long, message string",
        "commit_parent": "id string, parent string",
        "commit_file": "id string, file string, change string",
    }
    keys = ("root", "max_commits")

    def log(self, *options: str) -> str:
        limit = self.setting("max_commits", "20000")
        return subprocess.run(["git", "-C", self.setting("root", "."), "-c", "core.quotepath=off", "log", f"--max-count={int(limit)}", *options], capture_output=True, text=True, check=True, errors="replace").stdout

    def batch(self, spark: SparkSession, wanted: dict[str, Decl]) -> dict[str, DataFrame]:
        rows: dict[str, list[tuple]] = {n: [] for n in self.outputs}
        for record in self.log(f"--format={_RECORD}%H{_FIELD}%an{_FIELD}%ae{_FIELD}%at{_FIELD}%P{_FIELD}%B{_FIELD}", "--name-status", "-M", "--diff-merges=first-parent").split(_RECORD)[1:]:
            commit, author, email, time, parents, message, files = record.split(_FIELD, 6)
            rows["commit"].append((commit, author, email, int(time), message.strip()))
            rows["commit_parent"] += [(commit, p) for p in parents.split()]
            for line in files.strip("\n").split("\n"):
                parts = line.split("\t")
                if len(parts) >= 2:
                    rows["commit_file"].append((commit, parts[-1], parts[0][0]))
        return {n: spark.createDataFrame(r, self.outputs[n]) for n, r in rows.items() if n in wanted or not wanted}
