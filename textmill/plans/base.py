"""What the registered queries share: the registry, tables, and SQL pieces that both engines read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

STOP = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "not", "no"]
PROTECTED = ["not", "no"]
#: One md5 order in both engines.
MD5 = "md5(concat_ws('|', CAST({0} AS VARCHAR), '42'))"
TOKENS = r"regexp_extract_all({0}, '[0-9]+(?:[.,][0-9]+)*|[A-Za-zÀ-ɏ]+|[^\s]')"
WORDS = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '')"
GRADED = "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def graded(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")


def lower_words(c: str = "text"):
    """White-space words, lowered; the split SQL can follow."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def r6(c, name: str):
    return F.round(c.cast("double") if not isinstance(c, str) else F.col(c).cast("double"), 6).alias(name)


def pair_texts(spark, d) -> DataFrame:
    """User turns with the assistant's reply."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = table(spark, d, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    return n.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


#: (conv_id, turn, question, answer) of user turns with the assistant's reply.
PAIRS = "(SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"
