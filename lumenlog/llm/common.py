"""What the operators share: scratch tables, argument checks and small column helpers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on a local master whose session names no checkpoint folder, as in tests.
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints/lumenlog"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master without one, a default."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or DEFAULT_CHECKPOINT_DIR).rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more; other frames are left alone."""
    for table in tables:
        if path := getattr(table, "_scratch_path", None):
            jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def split_by(df: DataFrame, key: Column, wanted: DataFrame, most_bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose key may be among those of wanted (one column), and rows whose key isn't; a null key isn't.

    A filter of 16 bits for each wanted key, at most 2^most_bits, is joined by
    broadcast as rows of 64 bits (16 MB at the default's most). Only rows of the
    first part then need a shuffle; a full filter lets more pass, never fewer.
    """
    bits = min(most_bits, max(8, (16 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    at = place(F.col(wanted.columns[0]))
    words = wanted.select(F.shiftright(at, 6).alias("\x00word"), F.expr("1L").alias("one"), at.bitwiseAND(63).cast("int").alias("at"))
    words = words.groupBy("\x00word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("\x00bits"))
    spot = place(key)
    flagged = df.withColumn("\x00at", spot).join(F.broadcast(words), F.shiftright("\x00at", 6) == F.col("\x00word"), "left")
    may = key.isNotNull() & F.coalesce(F.expr("(shiftright(`\x00bits`, cast(`\x00at` & 63 as int)) & 1) = 1"), F.lit(False))
    own = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return flagged.where(may).select(*own), flagged.where(~may).select(*own)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
