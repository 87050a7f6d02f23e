"""Results as text: CSV files, sizes and change lines."""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator
from decimal import Decimal

from pyspark.sql import DataFrame


def cell(value) -> str:
    """A cell as it is shown: NULL, floats without exponent or a trailing .0, inf and NaN."""
    if value is None:
        return "NULL"
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if math.isinf(value):
            return "inf" if value > 0 else "-inf"
        text = format(Decimal(repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    return str(value)


def lines(df: DataFrame) -> Iterator[str]:
    for row in df.toLocalIterator():
        yield ", ".join(map(cell, row))


def write_csv(results: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """<folder>/csvs/<relation>.csv, rows streamed through the driver a partition at a time, and size.txt; the sizes."""
    os.makedirs(os.path.join(folder, "csvs"), exist_ok=True)
    sizes = {}
    for name, df in results.items():
        sizes[name] = 0
        with open(os.path.join(folder, "csvs", f"{name}.csv"), "w", encoding="utf-8") as f:
            for line in lines(df):
                f.write(line + "\n")
                sizes[name] += 1
    with open(os.path.join(folder, "size.txt"), "w", encoding="utf-8") as f:
        f.writelines(f"{n}: {k}\n" for n, k in sizes.items())
    return sizes


def write_table(df: DataFrame, path: str) -> None:
    """A result of any size, written by the executors."""
    df.write.mode("overwrite").parquet(path)


def print_sizes(results: dict[str, DataFrame], say=print) -> dict[str, int]:
    sizes = {n: df.count() for n, df in results.items()}
    for n, k in sizes.items():
        say(f"{n}: {k}")
    return sizes


def change_lines(name: str, rows: Iterable[tuple[tuple, int]]) -> Iterator[str]:
    for row, diff in rows:
        yield f"{'+' if diff > 0 else '-'} {name}({', '.join(map(cell, row))})"
