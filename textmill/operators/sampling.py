"""Splits, quotas, caps and orders. What is random elsewhere is the order of an md5 of key and seed here, the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str | Column, seed: int = 42) -> Column:
    """A sort key that stands for a random order."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", c.cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, group: str, strata: list[str], train: float = 0.7, dev: float = 0.15, seed: int = 42) -> DataFrame:
    """df with `split`; groups stay whole, each stratum is cut at int(train * n) and int((train + dev) * n) groups.

    Groups are ranked, not rows; a stratum is split over nothing but its own window.
    """
    g = df.groupBy(group).agg(*(F.min(s).alias(s) for s in strata))
    w = Window.partitionBy(*strata)
    at = F.row_number().over(w.orderBy(shuffled(group, seed), group)) - 1
    n = F.count(F.lit(1)).over(w)
    cut = lambda share: F.floor(n * F.lit(float(share)) + F.lit(1e-9))
    named = g.select(group, F.when(at < cut(train), "train").when(at < cut(train + dev), "dev").otherwise("test").alias("split"))
    return df.join(named, group)


def hash_split(key: str | Column, share: float, seed: int = 42) -> Column:
    """Whether a group falls in a share, without any sort."""
    return F.conv(F.substring(shuffled(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0 < share


def round_robin(df: DataFrame, subject: str, key: str, limit: int, cap: int | None = None, seed: int = 42) -> DataFrame:
    """Rows taken from subjects in turn until the limit, at most cap of each. Subjects are ranked apart; one sort takes the first `limit`."""
    turn = F.row_number().over(Window.partitionBy(subject).orderBy(shuffled(key, seed), key))
    d = df.withColumn("turn", turn)
    if cap is not None:
        d = d.where(F.col("turn") <= cap)
    return d.orderBy("turn", subject).limit(limit)


def subject_cap(counts: dict[str, int], share: float, rounds: int = 50) -> dict[str, int]:
    """How many of each subject stay if none may be over a share of the final total: a fixed point on the counts."""
    kept = dict(counts)
    for _ in range(rounds):
        most = int(share * sum(kept.values()))
        nxt = {s: min(n, max(most, 1)) for s, n in counts.items()}
        if nxt == kept:
            break
        kept = nxt
    return kept


def capped(df: DataFrame, subject: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """df with no subject over a share of what stays. One count per subject reaches the driver."""
    counts = {r[0]: r[1] for r in df.groupBy(subject).count().collect()}
    limits = df.sparkSession.createDataFrame(list(subject_cap(counts, share).items()), f"{subject} string, __cap long")
    turn = F.row_number().over(Window.partitionBy(subject).orderBy(shuffled(key, seed), key))
    return df.withColumn("__turn", turn).join(limits, subject).where("__turn <= __cap").drop("__turn", "__cap")


def quota_sample(df: DataFrame, cell: list[str], per_cell: int, pair: str, key: str, seed: int = 42) -> DataFrame:
    """per_cell rows of each cell, at most one of a pair: a pair offers one member, then cells are filled in order."""
    one = F.row_number().over(Window.partitionBy(pair).orderBy(shuffled(F.concat_ws("/", F.col(pair).cast("string"), F.col(key).cast("string")), seed), key))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(shuffled(key, seed + 1), key))
    return df.withColumn("__one", one).where("__one = 1").drop("__one").withColumn("__place", place).where(F.col("__place") <= per_cell).drop("__place")


def proportional_take(df: DataFrame, strata: list[str], size: int, key: str, seed: int = 42) -> DataFrame:
    """round(size * share) rows of each stratum, half to even."""
    w = Window.partitionBy(*strata)
    n, total = F.count(F.lit(1)).over(w), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    quota = counts.crossJoin(total).withColumn("__q", F.bround(F.lit(float(size)) * F.col("__n") / F.col("__total"))).drop("__n", "__total")  # one row on the right
    at = F.row_number().over(w.orderBy(shuffled(key, seed), key))
    return df.withColumn("__at", at).join(quota, strata).where("__at <= __q").drop("__at", "__q")


def benchmark_sample(df: DataFrame, condition: str, subject: str, key: str, quota: int, cap: int, seed: int = 42) -> DataFrame:
    """quota rows of each condition, first at most cap of a subject, then filled up with the rest."""
    turn = F.row_number().over(Window.partitionBy(condition, subject).orderBy(shuffled(key, seed), key))
    d = df.withColumn("__late", (turn > cap).cast("int"))
    place = F.row_number().over(Window.partitionBy(condition).orderBy("__late", shuffled(key, seed + 1), key))
    return d.withColumn("__place", place).where(F.col("__place") <= quota).drop("__late", "__place")


def paired_order(df: DataFrame, pair: str, key: str, seed: int = 42) -> DataFrame:
    """df with `position`: members of a pair fall in two halves by a coin, so no pair stands together and labels don't show."""
    half = F.row_number().over(Window.partitionBy(pair).orderBy(shuffled(key, seed), key))
    return df.withColumn("__half", half).withColumn("position", F.row_number().over(Window.orderBy("__half", shuffled(pair, seed + 1), pair, key))).drop("__half")


def batches(df: DataFrame, position: str = "position", size: int = 250, prefix: str = "item") -> DataFrame:
    """df with batch numbers from 1 and opaque ids by position."""
    return df.withColumn("batch", F.floor((F.col(position) - 1) / size) + 1).withColumn("item_id", F.format_string(f"{prefix}_%04d", F.col(position)))


def prefill(df: DataFrame, key: str, blind: float = 0.1, seed: int = 42) -> DataFrame:
    """df with `blind`: rows of which the annotator must not see the proposal."""
    return df.withColumn("blind", hash_split(key, blind, seed))
