"""Queries of the training-corpus operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwave.llm import chosen_path, compact_windows, decontam, langid, packing, pii, tiff, toxicity, url_filter, warc_zst
from siftwave.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URL looks more like the accepted than like the rejected ones."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.keep(pages, url_filter.fit(pages, *url_filter.seeded(pages)))


def op2_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as archives and read back, a row per record."""
    files = warc_zst.write(table(spark, sf_dir, "pages"))
    got = warc_zst.read(spark, files)
    return got.select(F.col("target_uri").alias("url"), "warc_type", "content_type", "content_length", F.col("payload").cast("string").alias("html"), "error")


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` rendered as TIFF files, a page per turn, and decoded."""
    got = tiff.pages(tiff.rendered(table(spark, sf_dir, "conversations")), "id", "tiff")
    text = F.rtrim(F.col("pixels").cast("string"), F.lit("\0"))
    return got.select(F.col("id").alias("conv_id"), "page", "width", "height", "samples", "bits", F.octet_length(text).cast("bigint").alias("n_bytes"), F.md5(text.cast("binary")).alias("digest"), "error")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share passages of 50 words or more: class, links, and where."""
    return compact_windows.repeats(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a near-duplicate: class, copies and links."""
    return chosen_path.classes(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with language and cosine."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).where("accepted").drop("accepted")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.flag(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_warc_reader": op2_warc_reader,
    "op3_tiff_pages": op3_tiff_pages,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_reader": """
        SELECT url, 'resource' AS warc_type, 'text/html' AS content_type, CAST(strlen(coalesce(html, '')) AS BIGINT) AS content_length,
               coalesce(html, '') AS html, CAST(NULL AS VARCHAR) AS error
        FROM pages WHERE url IS NOT NULL""",
    "op3_tiff_pages": """
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS page, 64 AS width,
               CAST(greatest(1, ceil(strlen(coalesce(text, '')) / 64.0)) AS INTEGER) AS height, 1 AS samples, 8 AS bits,
               CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS digest, CAST(NULL AS VARCHAR) AS error
        FROM conversations""",
}
