"""Streaming forms of three operators: deduplication, slice metrics, cache upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from textmill.operators import metrics


def dedupe(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def windowed_scores(stream: DataFrame, time: str, truth: str, pred: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Accuracy and macro-F1 per tumbling window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), metrics.accuracy(truth, pred).alias("accuracy"), metrics.macro_f1(truth, pred).alias("macro_f1"))


def upsert(stream: DataFrame, cache, checkpoint: str) -> DataStreamWriter:
    """Appends every batch to a cache; a replayed batch only repeats entries, and of a key the latest counts."""
    return stream.writeStream.foreachBatch(lambda df, _: cache.put(df)).option("checkpointLocation", checkpoint)
