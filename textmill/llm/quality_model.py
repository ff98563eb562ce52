"""Quality classifier by weak labels.

Heuristic labellers vote good (1), bad (0) or nothing (-1) on every document. Expectation-maximisation over the counts of the vote
patterns estimates how often each labeller is right, without any label, and gives every pattern a posterior. The posteriors
train a linear scorer over hashed byte trigrams, which then scores every document as a whole.

The pattern counts cover all documents; there are 3 ** labellers patterns at most, so they fit on the driver. The scorer
is fitted on the SAMPLE documents with the smallest hash of doc_id; SAMPLE is the bound. Its weights (2 ** BITS numbers) are broadcast.

Defined cases: null and empty texts get the labellers' verdict on no words and the scorer's bias; repeated rows are scored alike;
an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm._bytes import Texts, chunks
from textmill.llm._shared import ready, written
from textmill.llm.quality_rules import BINS, CLASSES, measure

SAMPLE = 4000
BITS = 14
LABELLERS = ("symbols", "capitals", "repeats", "lines", "function_words", "length", "word_length", "sentences")


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """The labellers' votes, one row per document, from the counts of quality_rules.measure()."""
    n = m["n_words"].astype(float)
    chars = np.maximum(1, m["word_chars"]).astype(float)
    kind = {c: m["classes"][:, i].astype(float) for i, c in enumerate(CLASSES)}
    some = np.maximum(1.0, n)
    rules = (
        (m["n_symbols"] / chars, None, 0.01, 0.04),
        (kind["upper"] / np.maximum(1, kind["upper"] + kind["lower"]), None, 0.15, 0.3),
        (m["n_repeat_words"] / some, None, 0.05, 0.2),
        (m["n_dup_lines"] / np.maximum(1, kind["line"] + 1), None, 0.01, 0.3),
        (1 - m["common"][:, : len(BINS)].sum(1) / some, n >= 30, 0.8, 0.93),
        (-n, None, -30, -10),
        (np.abs(chars / some - 6), n >= 10, 2.5, 5),
        (np.abs(kind["stop"] / some - 0.15), n >= 30, 0.12, 0.25),
    )
    out = np.full((len(n), len(rules)), -1, np.int8)
    for i, (value, where, good, bad) in enumerate(rules):
        where = np.ones(len(n), bool) if where is None else where
        out[where & (value <= good), i] = 1
        out[where & (value > bad), i] = 0
    return out


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = 3 ** np.arange(len(LABELLERS))
    for batch in chunks(batches, "text"):
        v = votes(measure(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(((v + 1) * code).sum(1), pa.int64())], names=["doc_id", "pattern"])


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, accuracy of each labeller when it votes, share of good) by EM.

    A labeller votes 1 with its own rate among good and among bad documents, given that it votes; what it abstains on tells nothing.
    """
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    yes, no = v == 1, v == 0
    post = (yes.sum(1) + 1.0) / (yes.sum(1) + 2.0 * no.sum(1) + 1.5)
    for _ in range(rounds):
        w1, w0 = counts * post, counts * (1 - post)
        prior = (w1.sum() + 1) / (counts.sum() + 2)
        rate = [((w[:, None] * yes).sum(0) + a) / ((w[:, None] * (yes | no)).sum(0) + a + b) for w, a, b in ((w1, 9.0, 1.0), (w0, 1.0, 1.0))]
        logs = [np.log(p) + (yes * np.log(r) + no * np.log(1 - r)).sum(1) for p, r in ((prior, rate[0]), (1 - prior, rate[1]))]
        post = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -60, 60)))
    w1, w0 = counts * post, counts * (1 - post)
    right = (w1[:, None] * yes + w0[:, None] * no).sum(0) / np.maximum(1e-9, (counts[:, None] * (yes | no)).sum(0))
    return post, right, float(prior)


def slots(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every byte trigram inside a text."""
    d = t.data.astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    text = np.repeat(np.arange(t.n), np.diff(t.off))
    same = text[:-2] == text[2:]
    return text[:-2][same], (h >> np.uint32(32 - BITS))[same].astype(np.int64)


def fit_scorer(texts: list[str | None], target: np.ndarray, steps: int = 150, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights of logistic regression on mean trigram weights, the bias last; both classes weigh the same."""
    t = Texts(pa.array(texts, pa.large_string()))
    text, slot = slots(t)
    key, count = np.unique(text * (1 << BITS) + slot, return_counts=True)
    text, slot = key >> BITS, key & ((1 << BITS) - 1)
    x = np.sqrt(count / np.maximum(1, np.bincount(text, count, minlength=t.n))[text])
    w, b, g2, gb = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8), 1e-8
    weight = np.where(target > 0.5, 0.5 / max(1.0, (target > 0.5).sum()), 0.5 / max(1.0, (target <= 0.5).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(text, w[slot] * x, minlength=t.n) + b, -30, 30)))
        e = (p - target) * weight
        g = np.bincount(slot, e[text] * x, minlength=1 << BITS) + decay * w
        g2 += g * g
        gb += e.sum() ** 2
        w -= rate * g / np.sqrt(g2)
        b -= rate * e.sum() / np.sqrt(gb)
    return np.append(w, b)


def score(t: Texts, w: np.ndarray) -> np.ndarray:
    """The probability of good for each text."""
    text, slot = slots(t)
    key, count = np.unique(text * (1 << BITS) + slot, return_counts=True)
    text, slot = key >> BITS, key & ((1 << BITS) - 1)
    x = np.sqrt(count / np.maximum(1, np.bincount(text, count, minlength=t.n))[text]) if len(text) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(np.bincount(text, w[slot] * x, minlength=t.n) + w[-1], -30, 30)))


def _scored(weights):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 18):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(Texts(batch.column(1)), weights.value))], names=["doc_id", "score"])

    return scored


def classify(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """doc_id, score (probability of good) and kept (score at least `least`) for every document."""
    spark = docs.sparkSession
    ready(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    voted = written(own.mapInArrow(_voted, "doc_id long, pattern long"))
    counts = voted.groupBy("pattern").count().toPandas().sort_values("pattern")  # one row per pattern
    if not len(counts):
        return own.select("doc_id", F.lit(0.0).alias("score"), F.lit(True).alias("kept"))
    posterior, _, _ = fit_labellers(counts["pattern"].to_numpy(), counts["count"].to_numpy().astype(float))
    table = spark.createDataFrame(pd.DataFrame({"pattern": counts["pattern"], "posterior": posterior}))
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    chosen = voted.join(table, "pattern").orderBy(order, "doc_id", "posterior").limit(sample).select("doc_id", "posterior")
    posteriors = {r[0]: r[1] for r in chosen.collect()}  # `sample` rows at most

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"doc_id": [], "text": []})]).sort_values(["doc_id", "text"])
        yield pd.DataFrame({"w": [fit_scorer(rows["text"].tolist(), rows["doc_id"].map(posteriors).to_numpy(float)).tolist()]})

    picked = own.where(F.col("doc_id").isin([k for k in posteriors if k is not None])).limit(sample).coalesce(1)
    w = np.array(picked.mapInPandas(fit, "w array<double>").first()[0])
    weights = spark.sparkContext.broadcast(w)
    return own.mapInArrow(_scored(weights), "doc_id long, score double").withColumn("kept", F.col("score") >= least)
