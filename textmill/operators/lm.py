"""Set-based language models: character n-gram models, a two-model style classifier, naive Bayes; counts and joins only."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAD = "\u0002"


def windows(c: Column, order: int) -> Column:
    """(history, char) of every character, the text padded on the left: from shifted copies of its characters, linear in its length."""
    chars = F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    n = F.size(chars)
    padded = F.concat(F.array_repeat(F.lit(PAD), order - 1), chars)
    history = F.slice(padded, F.lit(1), n) if order > 1 else F.transform(chars, lambda x: F.lit(""))
    for k in range(1, order - 1):
        history = F.zip_with(history, F.slice(padded, F.lit(k + 1), n), lambda a, b: F.concat(a, b))
    return F.zip_with(history, chars, lambda h, x: F.struct(h.alias("history"), x.alias("char")))


def char_counts(df: DataFrame, text: str, order: int, keys: list[str] = ()) -> DataFrame:
    """(keys, history, char, n)."""
    return df.select(*keys, F.explode(windows(F.coalesce(F.col(text), F.lit("")), order)).alias("w")).groupBy(*keys, "w.history", "w.char").agg(F.count(F.lit(1)).alias("n"))


def char_lm(df: DataFrame, text: str, order: int = 4, k: float = 0.1, keys: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(counts with history totals, alphabet sizes): an add-k model per key; the alphabet is shared by all keys."""
    counts = char_counts(df, text, order, keys)
    totals = counts.groupBy(*keys, "history").agg(F.sum("n").alias("total"))
    return counts.join(totals, [*keys, "history"]), counts.agg(F.count_distinct("char").alias("alphabet"))


def char_lm_score(model: tuple[DataFrame, DataFrame], df: DataFrame, row: str, text: str, order: int = 4, k: float = 0.1, keys: list[str] = ()) -> DataFrame:
    """(row, keys, log_prob, typicality): mean natural log probability per character under each key's model, and its exponential; 0 for an empty text.

    Scoring joins (history, char) counted per row, so repeated characters are joined once.
    """
    counts, alphabet = model
    own = df.select(row, F.explode(windows(F.coalesce(F.col(text), F.lit("")), order)).alias("w")).groupBy(row, "w.history", "w.char").agg(F.count(F.lit(1)).alias("times"))
    if keys:
        own = own.crossJoin(F.broadcast(counts.select(*keys).distinct()))  # one row per class
    # one row per history, its characters' counts as a map no larger than the alphabet: a single join
    per = counts.groupBy(*keys, "history").agg(F.first("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("char", "n"))).alias("known"))
    scored = own.join(per, [*keys, "history"], "left").crossJoin(alphabet).withColumn("n", F.col("known")[F.col("char")])  # one row
    p = (F.coalesce("n", F.lit(0)) + k) / (F.coalesce("total", F.lit(0)) + k * F.col("alphabet"))
    g = scored.groupBy(row, *keys).agg((F.sum(F.log(p) * F.col("times")) / F.sum("times")).alias("log_prob"))
    rows = df.select(row).distinct()
    if keys:
        rows = rows.crossJoin(F.broadcast(counts.select(*keys).distinct()))
    out = rows.join(g, [row, *keys], "left")
    return out.select(row, *keys, F.coalesce("log_prob", F.lit(0.0)).alias("log_prob"), F.coalesce(F.exp("log_prob"), F.lit(0.0)).alias("typicality"))


def style_classifier(train: DataFrame, label: str, df: DataFrame, row: str, text: str, order: int = 4, k: float = 0.1) -> DataFrame:
    """(row, gap, pred): the gap of the models of class 1 and class 0; predicted 1 if it is over 0."""
    s = char_lm_score(char_lm(train, text, order, k, [label]), df, row, text, order, k, [label])
    gap = F.sum(F.when(F.col(label) == 1, F.col("log_prob")).otherwise(-F.col("log_prob")))
    return s.groupBy(row).agg(gap.alias("gap")).withColumn("pred", (F.col("gap") > 0).cast("int"))


def passage_score(answer: str, passage: str, order: int = 4, k: float = 0.1) -> float:
    """exp of the mean log probability of the answer under an add-k model of its own passage; 0 if either is empty."""
    if not answer or not passage:
        return 0.0
    counts: dict[str, Counter] = defaultdict(Counter)
    padded = PAD * (order - 1) + passage
    for i in range(len(passage)):
        counts[padded[i : i + order - 1]][padded[i + order - 1]] += 1
    alphabet = len(set(passage) | set(answer))
    padded, total = PAD * (order - 1) + answer, 0.0
    for i in range(len(answer)):
        h = counts.get(padded[i : i + order - 1], {})
        total += math.log((h.get(padded[i + order - 1], 0) + k) / (sum(h.values()) + k * alphabet))
    return math.exp(total / len(answer))


def passage_lm_score(order: int = 4, k: float = 0.1):
    """An Arrow UDF of passage_score: the model is of one row, so nothing could be shared."""

    @F.pandas_udf(T.DoubleType())
    def score(answer: pd.Series, passage: pd.Series) -> pd.Series:
        return pd.Series([passage_score(a or "", p or "", order, k) for a, p in zip(answer, passage, strict=True)], dtype="float64")

    return score


def naive_bayes(train: DataFrame, label: str, tokens: str, smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(word log likelihoods, class priors) of multinomial naive Bayes from counts."""
    words = train.select(label, F.explode(tokens).alias("word")).groupBy(label, "word").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = words.agg(F.count_distinct("word").alias("v"))
    classes = train.groupBy(label).agg(F.count(F.lit(1)).alias("docs"))
    sums = words.groupBy(label).agg(F.sum("n").alias("total"))
    all_docs = classes.agg(F.sum("docs").alias("all_docs"))
    prior = classes.join(sums, label, "left").crossJoin(vocabulary).crossJoin(all_docs)  # one row each
    prior = prior.select(label, F.log(F.col("docs") / F.col("all_docs")).alias("prior"), F.log(F.lit(float(smoothing)) / (F.coalesce("total", F.lit(0)) + smoothing * F.col("v"))).alias("unseen"), (F.coalesce("total", F.lit(0)) + smoothing * F.col("v")).alias("denominator"))
    # of a word with n counts only the difference to an unseen one is stored
    return words.join(F.broadcast(prior), label).select(label, "word", (F.log((F.col("n") + smoothing) / F.col("denominator")) - F.col("unseen")).alias("gain")), prior.select(label, "prior", "unseen")


def naive_bayes_predict(model: tuple[DataFrame, DataFrame], df: DataFrame, row: str, tokens: str) -> DataFrame:
    """(row, pred, margin); words that training doesn't know are left out."""
    gains, prior = model
    label = gains.columns[0]
    own = df.select(row, F.explode(tokens).alias("word")).groupBy(row, "word").agg(F.count(F.lit(1)).alias("times"))
    known = own.join(gains.select("word").distinct(), "word", "left_semi")
    n = known.groupBy(row).agg(F.sum("times").alias("words"))
    got = known.join(gains, "word").groupBy(row, label).agg(F.sum(F.col("gain") * F.col("times")).alias("gain"))
    cells = df.select(row).distinct().join(n, row, "left").crossJoin(F.broadcast(prior)).join(got, [row, label], "left")  # one row per class
    score = F.col("prior") + F.coalesce("words", F.lit(0)) * F.col("unseen") + F.coalesce("gain", F.lit(0.0))
    g = cells.withColumn("score", score).groupBy(row).agg(F.max_by(label, F.struct("score", label)).alias("pred"), F.array_sort(F.collect_list("score")).alias("s"))
    return g.select(row, "pred", F.when(F.size("s") > 1, F.element_at("s", -1) - F.element_at("s", -2)).otherwise(F.lit(0.0)).alias("margin"))
