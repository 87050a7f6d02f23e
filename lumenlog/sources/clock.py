"""The time as a relation of one row."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..lang.ast import Decl
from .base import Source


class ClockSource(Source):
    """clock(tick, fixed): now(iso, epoch), rounded down to tick seconds (60), or frozen at an ISO time."""

    outputs = {"now": "iso string, epoch long"}
    keys = ("tick", "fixed")

    def epoch(self) -> int:
        if "fixed" in self.config:
            told = datetime.fromisoformat(self.config["fixed"].replace("Z", "+00:00"))
            return int((told if told.tzinfo else told.replace(tzinfo=UTC)).timestamp())
        tick = int(self.setting("tick", "60"))
        return int(time.time()) // tick * tick

    def batch(self, spark: SparkSession, wanted: dict[str, Decl]) -> dict[str, DataFrame]:
        now = self.epoch()
        return {"now": spark.createDataFrame([(datetime.fromtimestamp(now, UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), now)], self.outputs["now"])}
