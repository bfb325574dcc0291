"""The contract queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc32_mod
    from .quality import score_quality, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return score_quality(docs.select("doc_id", held, "text"), model, keep=["doc_id", "held_out"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


#: Fixed values of the URL contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tree of files: source / language / id modulo 50 / id.  A document of under 200 characters that
    speaks of a license is named LICENSE, and of these every other one lies a folder higher."""
    from .license_scan import scan_licenses

    short = (F.char_length("text") < 200) & F.contains(F.lower("text"), F.lit("licens"))
    folder = F.when(~(short & (F.col("doc_id") % 2 == 0)) | short.isNull(), (F.col("doc_id") % 50).cast("string"))
    path = F.concat_ws("/", "source", "lang", folder, F.when(short, "LICENSE").otherwise(F.col("doc_id").cast("string")))
    files = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return scan_licenses(files, keep=["doc_id", "path"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_decontamination, op3_language, op4_packing, op5_topk, op6_suffix_dedup, op7_html, op8_url_filter, op9_license, op10_simhash)}
