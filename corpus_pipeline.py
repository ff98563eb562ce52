"""The training-data pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm._shared import shared_dir
from textmill.llm.decontaminate import decontaminated
from textmill.llm.jaccard_join import one_of_each
from textmill.llm.line_dedup import dedup_lines
from textmill.llm.mixing import mixed_rows
from textmill.llm.quality_rules import kept_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; one that loses all its words goes."""
    out = dedup_lines(docs).where("n_lines_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard similarity."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as it has copies."""
    return mixed_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express the MinHash, SimHash and rounding stages. Tests hold line dedup, near duplicates and decontamination against brute
#: force, the base rules of quality rules, too, and mixing by its targets, ids and expectations.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}_{name}")
        docs = spark.read.parquet(f"{at}/{i}_{name}")
    return docs
