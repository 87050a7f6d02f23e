"""URL rules in a sorted digest array.

The rules' strings (host and path, like "example.org/es/") are kept with their
64-bit xxhash keys in one file: sorted keys, then verdicts and strings. Spark
ships the file to every executor; a worker memory-maps it, probes all of a
batch's candidate strings at once by binary search, and confirms every hit by
comparing the stored string, so colliding digests can't give a wrong verdict.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need

ALLOW, BLOCK = "allow", "block"
_HEADER = 4


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first "://", up to "/", "?", "#" or the end; A-Z lower-cased."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(F.locate("://", url) > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def build_index(rules: list[Rule], path: str) -> None:
    """Write the digest file: four counts, keys, host lengths, verdicts, string ends, string bytes, path lengths."""
    seen: dict[tuple[str, str], Rule] = {}
    for r in rules:
        if r.verdict not in (ALLOW, BLOCK):
            raise ValueError(f"a rule's verdict is {ALLOW} or {BLOCK}, not {r.verdict!r}")
        if seen.setdefault((r.host, r.path), r).verdict != r.verdict:
            raise ValueError(f"two verdicts for {r.text!r}")
    texts = [r.text.encode() for r in seen.values()]
    keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype="<u8")
    order = np.argsort(keys, kind="stable")
    held = [list(seen.values())[i] for i in order]
    blob = b"".join(r.text.encode() for r in held)
    path_sizes = np.array(sorted({len(r.path) for r in held}), dtype="<u8")
    with open(path, "wb") as f:
        np.array([len(held), len(path_sizes), len(blob), 0], dtype="<u8").tofile(f)
        keys[order].tofile(f)
        np.array([len(r.host.encode()) for r in held], dtype="<u8").tofile(f)
        np.array([r.verdict == ALLOW for r in held], dtype="<u8").tofile(f)
        np.cumsum([len(r.text.encode()) for r in held], dtype="<u8").tofile(f)
        path_sizes.tofile(f)
        f.write(blob)


class DigestIndex:
    """The memory-mapped file; find() answers for many (host, path) at once."""

    def __init__(self, path: str):
        size = os.path.getsize(path) // 8 * 8
        numbers = np.memmap(path, dtype="<u8", mode="r", shape=(size // 8,))
        n, sizes, blob, _ = map(int, numbers[:_HEADER])
        parts = np.split(numbers[_HEADER : _HEADER + 4 * n + sizes], [n, 2 * n, 3 * n, 4 * n])
        self.keys, self.host_bytes, self.allows, self.ends, self.path_sizes = parts
        self.blob = np.memmap(path, dtype=np.uint8, mode="r", offset=8 * (_HEADER + 4 * n + sizes), shape=(blob,)) if blob else np.zeros(0, np.uint8)

    def text(self, i: int) -> bytes:
        return self.blob[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def find(self, pairs: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """For each (host, path) the longest rule that fits, as (text, verdict); at equal length the longer host's."""
        rows, hosts, texts = [], [], []
        sizes = self.path_sizes.tolist()
        for row, (host, path) in enumerate(pairs):
            at = 0
            while True:
                suffix = host[at:]
                for k in sizes:
                    if k <= len(path):
                        rows.append(row)
                        hosts.append(len(suffix.encode()))
                        texts.append((suffix + path[:k]).encode())
                at = host.find(".", at) + 1
                if not at:
                    break
        best: list[tuple[int, int, int] | None] = [None] * len(pairs)
        digests = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype="<u8")
        low = np.searchsorted(self.keys, digests, side="left")
        high = np.searchsorted(self.keys, digests, side="right")
        for c in np.flatnonzero(low < high).tolist():
            for i in range(int(low[c]), int(high[c])):  # more than one only where digests collide
                if self.host_bytes[i] == hosts[c] and self.text(i) == texts[c]:
                    found = (len(texts[c]), hosts[c], i)
                    if best[rows[c]] is None or found > best[rows[c]]:
                        best[rows[c]] = found
        return [None if b is None else (self.text(b[2]).decode(), ALLOW if self.allows[b[2]] else BLOCK) for b in best]


def ship(spark: SparkSession, rules: list[Rule]) -> str:
    """Send the digest file to the executors; its name there."""
    with tempfile.TemporaryDirectory() as folder:
        made = os.path.join(folder, "rules")
        build_index(rules, made)
        with open(made, "rb") as f:
            name = f"url-rules-{hashlib.sha256(f.read()).hexdigest()[:24]}"
        sent = os.path.join(tempfile.gettempdir(), name)
        os.replace(made, sent)
    spark.sparkContext.addFile(sent)
    return name


_open: dict[str, DigestIndex] = {}


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """Every row's (id_col, host, path, rule, verdict); rule null where none fits, verdict then default.

    A rule fits its host and all subdomains, if the URL's path starts with the
    rule's; the longest wins. A null URL, or one without "://", has an empty
    host and path. Null and repeated ids pass through; other columns, whatever
    their names, are not read. No shuffle. No rules, or an empty table: all
    default, or no rows. The index is rules, not corpus: its file is shipped
    once to an executor and paged in by need, not held on any heap.
    """
    need(pages, id_col, url_col)
    name = ship(pages.sparkSession, rules)
    id_type = pages.schema[id_col].dataType.simpleString()
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))

    def run(batches):
        if name not in _open:
            _open[name] = DigestIndex(SparkFiles.get(name))
        index = _open[name]
        for batch in batches:
            found = index.find(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)))
            rule = pa.array([f and f[0] for f in found], type=pa.string())
            verdict = pa.array([f[1] if f else default for f in found], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [id_col, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")
