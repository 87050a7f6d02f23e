"""Folds over the last column, by the columns before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _reals(v: Column, pick, all_nan: float) -> Column:
    """The least or greatest that isn't NaN; only NaN gives an infinity."""
    return F.when(F.count(v) > 0, F.coalesce(pick(F.when(~F.isnan(v), v)), F.lit(all_nan)))


def folded(op: str, v: Column, kind: str) -> Column:
    """Null values are skipped. Whole sums are exact: beyond 64 bits a sum is null, an average is cut towards zero."""
    if op == "count":
        return F.count(v)
    if kind == "float":
        if op == "min":
            return _reals(v, F.min, float("inf"))
        if op == "max":
            return _reals(v, F.max, float("-inf"))
        return (F.sum(v) if op == "sum" else F.avg(v)) + F.lit(0.0)
    if op in ("min", "max"):
        return F.min(v) if op == "min" else F.max(v)
    total = F.sum(v.cast("decimal(19,0)"))
    if op == "sum":
        return total.try_cast("bigint")
    return F.call_function("div", total, F.nullif(F.count(v), F.lit(0).cast("bigint"))).try_cast("bigint")


def fold(df: DataFrame, op: str, kind: str) -> DataFrame:
    """One row for each key. A group of nulls only has a count of 0 and nothing else; no rows make no group."""
    *keys, last = df.columns
    v = F.col(last)
    out = df.groupBy(*keys).agg(folded(op, v, kind).alias(last), F.count(v).alias("\x00n"), F.count(F.lit(1)).alias("\x00m"))
    out = out.where(F.col("\x00m") > 0) if op == "count" else out.where(F.col("\x00n") > 0)
    return out.select(*keys, last)
