"""The provider interface: named outputs with schemas, a batch view, and changes between two looks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.ast import Decl
from ..operators.fixpoint import settled

DIFF = "__diff"


class Source:
    """A provider's instance. outputs: schema strings by name; a source of any one relation has the name "rows"."""

    outputs: dict[str, str] = {}
    keys: tuple[str, ...] = ()
    static = False

    def __init__(self, config: dict[str, str]):
        unknown = sorted(set(config) - set(self.keys))
        if unknown:
            raise ValueError(f"{type(self).__name__} doesn't know {', '.join(unknown)}; its settings are {', '.join(self.keys)}")
        self.config = config
        self._last: dict[str, DataFrame] = {}

    def setting(self, key: str, default: str | None = None) -> str:
        value = self.config.get(key, default)
        if value is None:
            raise ValueError(f"{type(self).__name__} needs {key}")
        return value

    def listed(self, key: str, default: str = "") -> list[str]:
        return [x.strip() for x in self.config.get(key, default).split(",") if x.strip()]

    def batch(self, spark: SparkSession, wanted: dict[str, Decl]) -> dict[str, DataFrame]:
        """Frames of the outputs that are wanted; others aren't read."""
        raise NotImplementedError

    def changes(self, spark: SparkSession, wanted: dict[str, Decl]) -> dict[str, DataFrame]:
        """Rows with __diff 1 or -1 since the last look; the first look inserts all."""
        now = {n: settled(df) for n, df in self.batch(spark, wanted).items()}  # written: the source itself may change
        out = {}
        for name, df in now.items():
            old = self._last.get(name)
            out[name] = df.withColumn(DIFF, F.lit(1)) if old is None else reconciled(old, df)
        self._last = now
        return out


def reconciled(old: DataFrame, new: DataFrame) -> DataFrame:
    """The multiset difference between two snapshots; of equal ones it is empty."""
    return new.exceptAll(old).withColumn(DIFF, F.lit(1)).union(old.exceptAll(new).withColumn(DIFF, F.lit(-1)))
