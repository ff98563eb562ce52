"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.decontaminate import contaminated
from textmill.llm.html_extract import extract_pages
from textmill.llm.jaccard_join import jaccard_components
from textmill.llm.license_scan import scan_licenses
from textmill.llm.line_dedup import dedup_lines
from textmill.llm.mixing import mix
from textmill.llm.ngram_lm import score_held_out
from textmill.llm.oracles import ORACLE_SQL as ORACLE_SQL
from textmill.llm.quality_model import classify
from textmill.llm.quality_rules import quality_rules
from textmill.llm.suffix_dedup import dedup_suffixes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).drop("source")


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(_read(spark, sf_dir, "documents")).drop("perplexity")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(_read(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents")).drop("class_distance", "common_distance")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("distance")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("kept_md5"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_decontaminate, op3_ngram_lm, op4_jaccard_join, op5_suffix_dedup, op6_html_extract, op7_quality_rules, op8_line_dedup, op9_quality_model, op10_license_scan)
}

