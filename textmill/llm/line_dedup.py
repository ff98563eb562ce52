"""Line deduplication by a suffix array over line ids, built by distributed prefix doubling.

A document is a sequence of line ids; the corpus order is by doc_id, then by line. A line goes if it lies in a run of consecutive
lines that has min_words words at least and begins earlier in the corpus, too; the first copy of a run always stays. The
registered MIN_WORDS is 3: a repeated line of three words goes, one or two words (a list's "Yes.", a bare heading) only in a run.

Only suffixes that start with a repeated line can share anything. Prefix doubling sorts those into classes: round j names the first
2^j lines of a suffix by the names of their two halves, and only suffixes tied with another go on. A suffix needs to be
sorted to the depth at which its prefix has min_words words, no further: suffixes with the same name at that depth are an
interval of the suffix array with that longest common prefix at least, and the interval's earliest member is the copy to keep.
Every line of a maximal repeated run lies in such a shortest run that starts or ends at it (or that spans it), so the intervals'
later members together are exactly the runs to delete.

Rounds shuffle only tied suffixes, as (name, document, line). A very common line is one large group there; its members
meet in sums that tasks combine before the shuffle, and in joins whose other side holds one row per group. The groups with over
1 / HOT of the rows, HOT at most, are broadcast to their members, so these aren't dealt by the group at all.

Defined cases: null and empty texts come back as they are; lines are compared as bytes, without their \\n; lines without a
word go only inside a longer run; a document that loses all its lines gets an empty text; equal rows are one document and all
stay alike; rows with the same doc_id and other text are ordered by a hash of the text; a null doc_id comes first; columns
other than doc_id and text pass through, whatever their names ("n_lines_removed" gets underscores while docs has such a column).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm._bytes import Texts, chunks
from textmill.llm._shared import dropped, fresh, ready, union, written

MIN_WORDS = 3
HOT = 1000
LINES = "doc_id long, copy long, line int, name binary, words int"
_KEY = ["doc_id", "copy"]


def _key() -> tuple[Column, Column]:
    """What tells documents apart: doc_id, a null one as the smallest number, and a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64("text")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        t = Texts(batch.column(2))
        text, starts, ends = t.lines
        data = t.data.tobytes()
        names = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        words = np.searchsorted(t.words[0], ends) - np.searchsorted(t.words[0], starts)
        first = np.searchsorted(text, np.arange(t.n))
        at = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array((np.arange(len(text)) - first[text]).astype(np.int32)), pa.array(names, pa.binary()), pa.array(words.astype(np.int32))],
            names=["doc_id", "copy", "line", "name", "words"],
        )


def _shortest(min_words: int):
    """(document, line, size): for each line the shortest runs of min_words words that start or end at it."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, copy, lines in zip(b["doc_id"], b["copy"], b["lines"], strict=True):
                at = np.array([x["line"] for x in lines])
                sums = np.concatenate([[0], np.cumsum([x["words"] for x in lines])])
                piece = np.cumsum(np.append(True, np.diff(at) != 1))  # runs of tied lines without a gap
                end = np.searchsorted(sums, sums[:-1] + min_words)  # starts: the first end with enough words
                start = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1  # ends: the last start with enough
                k = np.arange(len(at))
                ok = (end <= len(at)) & (piece[np.minimum(end, len(at)) - 1] == piece)
                pairs = set(zip(k[ok].tolist(), end[ok].tolist(), strict=True))
                ok = (start >= 0) & (piece[np.maximum(start, 0)] == piece)
                pairs |= set(zip(start[ok].tolist(), (k[ok] + 1).tolist(), strict=True))
                out += [(doc, copy, int(at[i]), j - i) for i, j in pairs]
            yield pd.DataFrame(out, columns=["doc_id", "copy", "line", "size"])

    return runs


def _of_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "n") -> DataFrame:
    """rows joined with groups, one row per key with the group's size: the few large groups by broadcast, the others by shuffle."""
    groups = written(groups)
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = groups.where(F.col(size) * HOT > total).drop(size)  # fewer than HOT rows
    small = groups.where(F.col(size) * HOT <= total).drop(size)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(large), keys).unionByName(rest.join(small, keys))


def _tied(named: DataFrame) -> DataFrame:
    """The rows of (doc_id, copy, line, name) whose name another place has, too."""
    twice = named.groupBy("name").agg(F.min(F.struct(*_KEY, "line")).alias("a"), F.max(F.struct(*_KEY, "line")).alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("name", "n")
    return _of_groups(named, twice, ["name"])


def _at(level: DataFrame, shift: Column | int, name: str) -> DataFrame:
    return level.select(*_KEY, (F.col("line") - shift).alias("line"), F.col("name").alias(name))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, copy, line): the lines to delete, each once; doc_id and copy as in _key()."""
    spark = docs.sparkSession
    ready(spark)
    doc_id, copy = _key()
    lines = written(docs.select(doc_id.alias("doc_id"), copy.alias("copy"), "text").mapInArrow(_lines, LINES).distinct())
    tied = written(_tied(lines))
    dropped(spark, lines)
    runs = written(
        tied.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("line", "words"))).alias("lines")).mapInPandas(_shortest(min_words), "doc_id long, copy long, line int, size int")
    )
    deepest = runs.agg(F.max("size")).first()[0] or 0
    level, step, named = tied.select(*_KEY, "line", "name"), 1, []
    while step <= deepest:
        # runs of step to 2 * step - 1 lines are two windows of this round, which may overlap
        some = runs.where((F.col("size") >= step) & (F.col("size") < 2 * step))
        tail = F.col("line") + F.col("size") - step
        both = some.join(_at(level, 0, "head"), [*_KEY, "line"]).withColumn("at", tail)
        both = both.join(_at(level, 0, "tail").withColumnRenamed("line", "at"), [*_KEY, "at"])
        named.append(both.select(*_KEY, "line", "size", "head", "tail"))
        if 2 * step > deepest:
            break
        need = runs.where(F.col("size") >= 2 * step).select(*_KEY).distinct()
        double = level.join(need, _KEY, "left_semi").join(_at(level, step, "next"), [*_KEY, "line"])
        level = written(_tied(double.select(*_KEY, "line", F.unhex(F.md5(F.concat("name", "next"))).alias("name"))))
        step *= 2
    if not named:
        return runs.select(*_KEY, "line")
    every = written(union(named))
    here = F.struct(*_KEY, "line")
    run = ["size", "head", "tail"]
    first = every.groupBy(*run).agg(F.min(here).alias("first"), F.max(here).alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last")
    later = _of_groups(every, first, run).where(F.col("first") < here)
    return later.select(*_KEY, F.explode(F.sequence("line", F.col("line") + F.col("size") - 1)).alias("line")).distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text that is left, and n_lines_removed (int)."""
    doc_id, copy = _key()
    doc, twin, out, removed = (fresh(docs, x) for x in ("gone_doc", "gone_copy", "gone_lines", "n_lines_removed"))
    gone = repeated_lines(docs, min_words).groupBy(F.col("doc_id").alias(doc), F.col("copy").alias(twin)).agg(F.collect_set("line").alias(out))
    both = docs.join(gone, (doc_id == gone[doc]) & (copy == gone[twin]), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(out, i)), "\n")
    both = both.withColumn("text", F.when(F.col(out).isNull(), F.col("text")).otherwise(left))
    return both.withColumn(removed, F.coalesce(F.size(out), F.lit(0))).drop(doc, twin, out)
