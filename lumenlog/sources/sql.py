"""A SQL query as a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..lang.ast import Decl
from .base import Source


class SqlSource(Source):
    """sql(sql or sql_file, db): one query over the session's views and tables; db is a folder of Parquet tables to register first. Static."""

    outputs = {"rows": "the query's columns"}
    keys = ("db", "sql", "sql_file", "read_only")
    static = True

    def batch(self, spark: SparkSession, wanted: dict[str, Decl]) -> dict[str, DataFrame]:
        if db := self.config.get("db"):
            root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(db)
            for entry in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root):
                name = entry.getPath().getName()
                if name.endswith(".parquet"):
                    spark.read.parquet(entry.getPath().toString()).createOrReplaceTempView(name.removesuffix(".parquet"))
        if "sql_file" in self.config:
            query = "\n".join(r["value"] for r in spark.read.text(self.config["sql_file"]).collect())  # a query's text
        else:
            query = self.setting("sql")
        return {"rows": spark.sql(query)}
