"""Counted rows: state is (row, net count); a row is there while its count is over 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.base import DIFF

COUNT = "__count"


def empty_state(df: DataFrame) -> DataFrame:
    return df.limit(0).withColumn(COUNT, F.lit(0).cast("bigint"))


def applied(state: DataFrame, change: DataFrame) -> DataFrame:
    """State after a batch of changes, whose order doesn't matter."""
    columns = [c for c in state.columns if c != COUNT]
    both = state.select(*columns, F.col(COUNT).alias("n")).union(change.select(*columns, F.col(DIFF).cast("bigint").alias("n")))
    return both.groupBy(*columns).agg(F.sum("n").alias(COUNT)).where(F.col(COUNT) != 0)


def present(state: DataFrame) -> DataFrame:
    return state.where(F.col(COUNT) > 0).drop(COUNT)


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows that came (1) and went (-1) between two sets."""
    columns = new.columns
    both = new.withColumn(DIFF, F.lit(1)).union(old.withColumn(DIFF, F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum(DIFF).alias(DIFF)).where(F.col(DIFF) != 0)
