"""Facts files: no header, a one-byte delimiter, one relation in a file."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import SPARK_TYPES
from ..lang.ast import Decl


def facts_path(decl: Decl, folder: str) -> str:
    return os.path.join(folder, decl.path or f"{decl.name}.facts")


def read_facts(spark: SparkSession, decl: Decl, folder: str, delimiter: str = ",") -> DataFrame:
    """The file's rows. An empty line is skipped, an empty field is null, a row whose number can't be read is dropped, a row of another width is an error."""
    if len(delimiter.encode()) != 1:
        raise ValueError("the delimiter is one byte")
    path = facts_path(decl, folder)
    width = len(decl.columns)
    quoted = "\\Q" + delimiter + "\\E"
    lines = spark.read.text(path).where("value <> ''").select(F.split("value", quoted, -1).alias("p"), "value")
    told = F.concat(F.lit(f"{path}: a row of {decl.name} has "), F.size("p"), F.lit(f" fields, not {width}: "), F.substring("value", 1, 80))
    parts = lines.select(F.when(F.size("p") == width, F.col("p")).otherwise(F.raise_error(told).cast("array<string>")).alias("p"))
    cells, good = [], F.lit(True)
    for i, (name, kind) in enumerate(decl.columns):
        raw = F.nullif(F.get("p", F.lit(i)), F.lit(""))
        cell = raw if kind == "string" else F.trim(raw).try_cast(SPARK_TYPES[kind])
        if kind != "string":
            good = good & (raw.isNull() | cell.isNotNull())
        cells.append(cell.alias(name))
    return parts.where(good).select(*cells)
