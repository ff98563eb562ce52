"""Vocabulary, document frequency, sparse and dense representations, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import similarity as S


def vocabulary(df: DataFrame, tokens: str, least: int = 2) -> DataFrame:
    """(word, n) of words with `least` counts or more."""
    return df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def numbered(vocab: DataFrame) -> DataFrame:
    """vocabulary with ids by count, then word."""
    return vocab.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1)


def keep_probability(vocab: DataFrame, sample: float = 1e-3) -> DataFrame:
    """(word, n, keep): how often a word is kept when frequent ones are thinned: (sqrt(f / sample) + 1) * sample / f of its share f, 1 at most."""
    total = vocab.agg(F.sum("n").alias("__total"))
    f = F.col("n") / F.col("__total")
    return vocab.crossJoin(total).select("word", "n", F.least(F.lit(1.0), (F.sqrt(f / sample) + 1) * sample / f).alias("keep"))  # one row on the right


def idf(df: DataFrame, tokens: str, least: int = 1) -> DataFrame:
    """(word, df, idf): ln((1 + N) / (1 + df)) + 1."""
    n = df.agg(F.count(F.lit(1)).alias("docs"))
    d = df.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    return d.crossJoin(n).select("word", "df", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row on the right


def coverage(df: DataFrame, tokens: str, vocab: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The share of tokens that the vocabulary has; out-of-vocabulary is the rest."""
    words = df.select(*keys, F.explode(tokens).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    known = words.join(vocab.select("word", F.lit(1).alias("__in")), "word", "left")
    return known.groupBy(*keys).agg((F.sum(F.when(F.col("__in") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage")).withColumn("oov", 1 - F.col("coverage"))


def tfidf(df: DataFrame, row: str, tokens: str, weights: DataFrame) -> DataFrame:
    """(row, word, w): counts times idf, each row of unit length."""
    own = df.select(row, F.explode(tokens).alias("word")).groupBy(row, "word").agg(F.count(F.lit(1)).alias("tf"))
    raw = own.join(weights.select("word", "idf"), "word").select(row, "word", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy(row).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, row).select(row, "word", (F.col("w") / F.col("norm")).alias("w"))


def sparse_top_k(queries: DataFrame, docs: DataFrame, q: str, d: str, k: int, block: int = 2_000, decimals: int = 6) -> DataFrame:
    """(q, d, score, rank): the k best documents of each query by dot product of (id, word, w) postings, ties by id.

    The queries go out in blocks of about `block`, which bounds what is broadcast; a task sums each of its documents against a block's
    postings and keeps the k best of every query. So common words cost arithmetic only: pairs are never rows, and no word is a
    shuffle's key. Only pairs that share a word are candidates.
    """
    from textmill.session import ship

    spark = docs.sparkSession
    ship(spark)
    first, key = queries.columns[0], docs.columns[0]
    blocks = max(1, -(-queries.select(first).distinct().count() // block))
    rows = docs.groupBy(F.col(key).cast("long").alias("d")).agg(F.collect_list("word").alias("words"), F.collect_list("w").alias("ws"))
    parts = []
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(first), F.lit(blocks)) == i).select(F.col(first).cast("long"), "word", "w").orderBy(first, "word").collect()
        if own:
            parts.append(rows.mapInPandas(_best_sparse(spark.sparkContext.broadcast(own), k, decimals), "q long, d long, score double"))
    if not parts:
        return spark.createDataFrame([], f"{q} long, {d} long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(q), F.col("d").alias(d), "score", "rank")


def _best_sparse(sent, k: int, decimals: int):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        ids, of = np.unique(np.array([r[0] for r in own], np.int64), return_inverse=True)
        lexicon = pd.Index(sorted({r[1] for r in own}))
        word = lexicon.get_indexer([r[1] for r in own])
        order = np.argsort(word, kind="stable")
        of, weight = of[order], np.array([r[2] for r in own])[order]
        at = np.searchsorted(word[order], np.arange(len(lexicon) + 1))  # the postings of each word
        score, found = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                some = batch.iloc[lo : lo + 512]
                rows = some["d"].to_numpy(np.int64)
                sizes = some["words"].map(len).to_numpy()
                w = lexicon.get_indexer(np.concatenate(some["words"].to_numpy()))
                x, row = np.concatenate(some["ws"].to_numpy()), np.repeat(np.arange(len(rows)), sizes)
                w, x, row = w[w >= 0], x[w >= 0], row[w >= 0]
                n = at[w + 1] - at[w]
                each = np.repeat(np.arange(len(w)), n)
                hit = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + at[w][each]
                cell = of[hit] * len(rows) + row[each]
                new = np.bincount(cell, weight[hit] * x[each], minlength=len(ids) * len(rows)).reshape(len(ids), -1)
                new = np.where(np.bincount(cell, minlength=new.size).reshape(new.shape) > 0, np.round(new, decimals), -np.inf)
                score, found = np.hstack([score, new]), np.hstack([found, np.broadcast_to(rows, new.shape)])
                top = np.lexsort((found, -score), axis=1)[:, :k]
                score, found = np.take_along_axis(score, top, 1), np.take_along_axis(found, top, 1)
        ok = np.isfinite(score)
        yield pd.DataFrame({"q": np.broadcast_to(ids[:, None], score.shape)[ok], "d": found[ok], "score": score[ok]})

    return best


def dense_top_k(queries: DataFrame, docs: DataFrame, vector: str, q: str, d: str, k: int, block: int = 10_000, decimals: int = 6) -> DataFrame:
    """(q, d, score, rank): exact nearest neighbours by cosine of a stated query set against all rows, itself left out.

    The queries go out in blocks of `block` vectors, which bounds what is broadcast; each task keeps the k best of every
    query in a block, so a block leaves k rows a query and task. Scores are rounded, ties go to the smaller id.
    """
    from textmill.session import ship

    spark = docs.sparkSession
    ship(spark)
    first, key = queries.columns[0], docs.columns[0]
    blocks = max(1, -(-queries.count() // block))
    parts = []
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(first), F.lit(blocks)) == i).select(first, vector).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), _unit(np.array([r[1] for r in rows], np.float64))))
        parts.append(docs.select(F.col(key).cast("long").alias("d"), F.col(vector).alias("v")).mapInPandas(_nearest(sent, k, decimals), "q long, d long, score double"))
    if not parts:
        return spark.createDataFrame([], f"{q} long, {d} long, score double, rank int")
    out = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(q), F.col("d").alias(d), "score", "rank")


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _nearest(sent, k: int, decimals: int):
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = sent.value
        score, found = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at : at + 512]
                own = some["d"].to_numpy(np.int64)
                new = np.round(vectors @ _unit(np.array(some["v"].tolist(), np.float64)).T, decimals)
                new[ids[:, None] == own[None, :]] = -np.inf
                score, found = np.hstack([score, new]), np.hstack([found, np.broadcast_to(own, new.shape)])
                best = np.lexsort((found, -score), axis=1)[:, :k]
                score, found = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
        ok = np.isfinite(score)
        yield pd.DataFrame({"q": np.broadcast_to(ids[:, None], score.shape)[ok], "d": found[ok], "score": score[ok]})

    return nearest


def margins(ranked: DataFrame, q: str) -> DataFrame:
    """(q, best, margin): the best score and its lead over the runner-up."""
    return ranked.groupBy(q).agg(F.max(F.when(F.col("rank") == 1, F.struct("score", *[c for c in ranked.columns if c not in (q, "score", "rank")]))).alias("best"), (F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias("margin"))


def mean_vector(df: DataFrame, keys: list[str], vector: str, size: int, weight: Column | None = None) -> DataFrame:
    """The mean (or weighted mean) vector of each key: one sum per dimension, combined before the shuffle."""
    w = weight if weight is not None else F.lit(1.0)
    sums = [F.sum(w * F.col(vector)[i].cast("double")).alias(f"s{i}") for i in range(size)]
    g = df.groupBy(*keys).agg(F.sum(w).alias("__w"), *sums)
    return g.select(*keys, F.array(*(F.col(f"s{i}") / F.col("__w") for i in range(size))).alias("vector"))


def document_vectors(df: DataFrame, row: str, tokens: str, vectors: DataFrame, size: int, weights: DataFrame | None = None) -> DataFrame:
    """Mean of word vectors, or their mean weighted by tf times idf; rows without a known word have none."""
    own = df.select(row, F.explode(tokens).alias("word")).groupBy(row, "word").agg(F.count(F.lit(1)).alias("tf"))
    own = own.join(vectors, "word")
    if weights is not None:
        own = own.join(weights.select("word", "idf"), "word")
    return mean_vector(own, [row], "vector", size, F.col("tf") * (F.col("idf") if weights is not None else F.lit(1.0)))


def context_pairs(tokens: Column, width: int) -> Column:
    """(center, context) of words at most `width` apart, as an array of structs."""
    n = F.size(tokens)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    near = lambda i: F.filter(F.sequence(F.greatest(i - width, F.lit(1)), F.least(i + width, n)), lambda j: j != i)
    pair = lambda i: F.transform(near(i), lambda j: F.struct(F.element_at(tokens, i).alias("center"), F.element_at(tokens, j).alias("context")))
    return F.when(n > 1, F.flatten(F.transform(at, pair))).otherwise(F.array().cast("array<struct<center:string,context:string>>"))


def nearest_words(vectors: DataFrame, word: str, n: int) -> DataFrame:
    one = vectors.where(F.col("word") == word).select(F.col("vector").alias("__v"))
    return vectors.where(F.col("word") != word).crossJoin(F.broadcast(one)).select("word", S.cosine(F.col("vector"), F.col("__v")).alias("cosine")).orderBy(F.desc("cosine"), "word").limit(n)  # one word's row
