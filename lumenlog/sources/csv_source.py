"""CSV files with a header row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import SPARK_TYPES
from ..lang.ast import Decl
from .base import Source


def guessed(cell: str | None) -> str:
    """A type from the first data row's cell."""
    for kind, parse in (("number", int), ("float", float)):
        try:
            value = parse(cell or "")
            if kind == "float" or -(2**63) <= value < 2**63:
                return kind
        except ValueError:
            pass
    return "string"


class CsvSource(Source):
    """csv(path, delimiter, types): cells that are empty or can't be read are null. A changed file is read again and the difference passed on."""

    outputs = {"rows": "the header's columns"}
    keys = ("path", "delimiter", "types")

    def batch(self, spark: SparkSession, wanted: dict[str, Decl]) -> dict[str, DataFrame]:
        path = self.setting("path")
        raw = spark.read.csv(path, sep=self.config.get("delimiter", ","), header=True, inferSchema=False, enforceSchema=False)
        if not raw.columns:
            raise ValueError(f"{path} has no header row")
        kinds = self.listed("types")
        if not kinds:
            first = raw.first()
            kinds = [guessed(first[i]) if first else "string" for i in range(len(raw.columns))]
        if len(kinds) != len(raw.columns) or any(k not in SPARK_TYPES for k in kinds):
            raise ValueError(f"types names {len(kinds)} of {', '.join(SPARK_TYPES)}; {path} has {len(raw.columns)} columns")
        cells = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in raw.columns]
        df = raw.select(*((x if k == "string" else F.trim(x).try_cast(SPARK_TYPES[k])).alias(n) for x, k, n in zip(cells, kinds, raw.columns, strict=True)))
        return {"rows": df}
