"""The corpus pipeline: quality, near duplicates, repeated passages, packing. Each stage reads what the one before wrote.

All stages but the last return the columns of documents, whatever others the
table has beside doc_id and text. An empty table stays empty. Nulls, repeated
rows and very long texts: see each stage, and its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlog.llm import common, jaccard, packing, quality, substring
from lumenlog.llm.queries import table, tokenizer_path

#: No SQL for a trained classifier; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds sound; the others go. Rows are judged one by one; null and empty texts by their length alone."""
    kept = quality.select(docs, table(spark, sf_dir, "labels"), extra=["text", *_others(docs)])
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 similarity of five-word shingles, the one with the smallest id. Null and empty texts link with nothing and stay, as do rows without an id and repeated rows of a kept id."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages that stand earlier in the corpus, by id and place. Null texts stay null; rows that agree in id and text are cut alike."""
    return substring.dedup(docs, extra=_others(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as sequences of at most 2048 tokens; documents that have no text, or lost all of it, have nothing to pack. Null and repeated ids are packed row by row."""
    return packing.pack(docs.where("length(text) > 0"), tokenizer_path())


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.scratch(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
