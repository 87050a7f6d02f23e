"""Parquet tables as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..lang.ast import Decl
from .base import Source


class ParquetSource(Source):
    """parquet(path): a table; columns are taken by name where the relation's are all there, so others aren't read."""

    outputs = {"rows": "the table's columns"}
    keys = ("path",)

    def batch(self, spark: SparkSession, wanted: dict[str, Decl]) -> dict[str, DataFrame]:
        return {"rows": spark.read.parquet(self.setting("path"))}
