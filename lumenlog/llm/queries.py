"""Queries over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, html_extract, jaccard, packing, quality, substring, topk, url_filter, warc

#: The rules of the URL query.
URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every document whose id is divisible by 50, by all its words."""
    docs = table(spark, sf_dir, "documents")
    return topk.search(docs, docs.where("doc_id % 50 = 0"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_nearest": op5_nearest,
    "op6_top_k": op6_top_k,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_url_filters": op10_url_filters,
}

ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
            CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM g""",
    "op10_url_filters": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        m AS (SELECT p.*, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS k
            FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
}
