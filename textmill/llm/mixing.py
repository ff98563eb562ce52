"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source wants target / size-of-source copies. Its whole copies are taken at once; the fraction left is a
probability. Two fractional documents play a round: words move from one to the other, in a random direction that keeps both
expectations, until one of them has 0 or 1 more copy. A round keeps the words of the pair, so a source's words stay near its
target. Blocks of a source play side by side, each leaves one fractional document at most, and those meet in the blocks of the
next level: a reduction tree. The last document of a source is rounded by its own probability.

The LARGE largest documents of a source are settled before the tree, the largest first: each gets its whole copies or one more
by its own probability, and the difference goes to the rest of its source as a change of their rate, as far as the rest can take
it (rates between 0 and the cap). So no document that is a big part of its source is left for the end, and the words taken
miss the target by less than one document that is not among them.

Blocks and the random numbers come from a hash of doc_id, source and text, the number of the copy among equal rows, and the seed, so
reruns and other clusters agree. A source, a doc_id or a null doc_id with any share of the rows is dealt over many blocks. Only
(key, doc_id, source, size) is shuffled, never a text.

Defined cases: a null or empty text has size 0 and takes nothing; a very long text is a document like any other; a null source
is a source of its own, the last; without any words all targets are 0; repeated rows are mixed as documents of their own;
doc_ids are 64-bit and may be null; an empty table gives none; other columns aren't read by mix(), and may have any name in
mixed_rows(), which calls the number of the copy "copy", with underscores appended while docs has such a column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm._shared import dropped, fresh, ranked, ready, union, words_count, written

BLOCK = 1 << 14
FAN = 64
LARGE = 16


def targets(sources: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """(source, source_size, target): shares by weight of all sizes, none above cap times its source.

    A level is the words per weight. It starts at all words over all weights; sources that it fills leave at their caps, which raises
    the level of the others, until none is above its cap: a few aggregates over one row per source, and no window over all of them.
    """
    order = [F.col("source").isNull(), F.col("source")]
    place = ranked(sources, order, "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = place.select("source", "source_size", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    level = -1.0
    while True:
        free = F.col("most") > level * F.col("weight")
        whole, capped, weigh = rows.agg(F.sum("source_size"), F.sum(F.when(~free, F.col("most"))), F.sum(F.when(free, F.col("weight")))).first()
        if not whole or not weigh:
            break
        new = (whole - (capped or 0.0)) / weigh
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(F.col("most"), F.lit(max(level, 0.0)) * F.col("weight")).cast("double").alias("target"))


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) from each key."""
    x = key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def pivot(size: list[int], p: list[float], u: list[float], last: bool) -> tuple[list[float], int]:
    """Plays the documents in order; (p with 0 and 1 except at the index, index of the fractional one left or -1).

    With `last` the one left is rounded by its own probability.
    """
    p, open_ = list(p), -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b = size[open_], size[i]
        up = min(a * (1.0 - p[open_]), b * p[i])  # words that can move to the open one
        down = min(a * p[open_], b * (1.0 - p[i]))  # and from it
        move = up if u[i] * (up + down) < down else -down
        x, y = p[open_] + move / a, p[i] - move / b
        x, y = (0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x), (0.0 if y < 1e-9 else 1.0 if y > 1 - 1e-9 else y)
        p[open_], p[i] = x, y
        open_ = open_ if 0.0 < x < 1.0 else i if 0.0 < y < 1.0 else -1
    if last and open_ >= 0:
        p[open_] = 1.0 if u[open_] < p[open_] else 0.0
        open_ = -1
    return p, open_


def settle(size: list[int], total: int, target: float, u: list[float], cap: float) -> tuple[list[int], float]:
    """Copies of the largest documents of a source, in order, and the rate of all others, so that the words taken come to target."""
    copies, rest, left = [], float(total), target
    for s, x in zip(size, u, strict=True):
        rate = min(cap, max(0.0, left / rest))
        rest -= s
        few = min(int(rate + 1e-12), int(cap))
        best = few + (x < rate - few)
        # the other choice, if the rest of the source can't make up for this one
        miss = {n: max(0.0, left - n * s - cap * rest, n * s - left) for n in (few, min(few + 1, int(cap)))}
        if miss[best] > 1e-9 * max(1.0, target):
            best = min(miss, key=lambda n: (miss[n], n != best))
        copies.append(best)
        left -= best * s
    return copies, min(cap, max(0.0, left / rest)) if rest > 0 else 0.0


def _settled(seed: int, cap: float):
    def settled(top: pd.DataFrame) -> pd.DataFrame:
        top = top.sort_values(["size", "key", "twin"], ascending=[False, True, True])
        u = _uniform(top["key"].to_numpy() + top["twin"].to_numpy(), seed * 64 + 63)
        copies, rate = settle(top["size"].tolist(), int(top["source_size"].iloc[0]), float(top["target"].iloc[0]), u.tolist(), cap)
        return pd.DataFrame({"at": top["at"], "key": top["key"], "twin": top["twin"], "copies": copies, "rate": rate})

    return settled


def _level(seed: int, level: int, last: bool):
    def play(block: pd.DataFrame) -> pd.DataFrame:
        # large documents first, so the one left at the end is small
        block = block.sort_values(["size", "key", "twin"], ascending=[False, True, True], kind="stable")
        u = _uniform(block["key"].to_numpy() + block["twin"].to_numpy(), seed * 64 + level)
        p, left = pivot(block["size"].tolist(), block["p"].tolist(), u.tolist(), last)
        block["p"] = p
        block["open"] = np.arange(len(block)) == left
        return block

    return play


def _mixed(docs: DataFrame, row: Column, seed: int, cap: float, weights: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): at (the number of a source), key (row, a hash), twin (from 0 among equal ones), doc_id, size, copies; and at, source, source_size, target."""
    ready(docs.sparkSession)
    sized = docs.select(row.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_count(F.col("text")).alias("size"))
    # equal rows meet in a count before they get numbers of their own
    sized = written(sized.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    per = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cap, weights)
    per = written(per.withColumn("at", F.xxhash64("source", F.col("source").isNull())))
    rows = sized.withColumn("at", F.xxhash64("source", F.col("source").isNull())).withColumn("twin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("at", "key", "twin", "doc_id", "size")
    largest = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("size"), "key", "twin"))
    top = rows.where("size > 0").withColumn("r", largest).where(F.col("r") <= LARGE).drop("r", "doc_id")
    done = written(top.join(per.drop("source"), "at").groupBy("at").applyInPandas(_settled(seed, cap), "at long, key long, twin long, copies long, rate double"))
    rates = done.groupBy("at").agg(F.first("rate").alias("rate"))
    wanted = rows.join(done.drop("rate"), ["at", "key", "twin"], "left").join(rates, "at", "left")
    whole = F.least(F.floor(F.col("rate") + 1e-12), F.lit(int(cap)))
    playing = F.col("copies").isNull() & (F.col("size") > 0)
    wanted = wanted.select("at", "key", "twin", "doc_id", "size", F.when(playing, whole).otherwise(F.coalesce("copies", F.lit(0))).cast("long").alias("whole"), F.when(playing, F.greatest(F.lit(0.0), F.col("rate") - whole)).otherwise(0.0).alias("p"))
    wanted = written(wanted)
    # who has no fraction doesn't play
    blocks = max(1, -(-wanted.where("p > 0").count() // BLOCK))
    out, level = [wanted.where("p <= 0").select("at", "key", "twin", "doc_id", "size", F.col("whole").alias("copies"))], 0
    names = "at long, key long, twin long, size long, whole long, p double, block long, open boolean"
    open_ = wanted.where("p > 0").drop("doc_id").withColumn("block", F.pmod(F.xxhash64("key", "twin"), F.lit(blocks)))
    played: list[DataFrame] = []
    while True:
        last = blocks == 1
        played.append(written(open_.groupBy("at", "block").applyInPandas(_level(seed, level, last), names)))
        if last:
            break
        blocks, level = -(-blocks // FAN), level + 1
        open_ = played[-1].where("open").drop("open").withColumn("block", F.floor(F.col("block") / FAN))
    ended = union([p.where("not open") for p in played]).select("at", "key", "twin", (F.col("whole") + F.round("p").cast("long")).alias("copies"))
    out.append(wanted.where("p > 0").select("at", "key", "twin", "doc_id", "size").join(ended, ["at", "key", "twin"]))
    dropped(docs.sparkSession, sized, done)
    return union(out), per


def mix(docs: DataFrame, seed: int = 0, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies times size) for every document."""
    rows, per = _mixed(docs, F.xxhash64(F.col("doc_id").cast("long"), "source", "text"), seed, cap, weights)
    return rows.join(per, "at").select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 0, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """The mix itself: each taken document as often as it has copies, with the columns of docs and `copy` (0, 1, ...).

    Rows that agree in every column are one row there, as often as all of them are taken.
    """
    key, n, twins, one = (fresh(docs, x) for x in ("mix_key", "mix_copies", "mix_twins", "mix_row"))
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    rows, _ = _mixed(docs, row, seed, cap, weights)
    taken = written(rows.groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(twins)).where(F.col(n) > 0))
    keyed = docs.withColumn(key, row)
    single = keyed.join(taken.where(F.col(twins) == 1).drop(twins), key)
    many = keyed.join(taken.where(F.col(twins) > 1).drop(twins), key)
    # equal rows meet before they are shuffled
    many = many.groupBy(key, n).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(one)).select(n, f"{one}.*")
    both = single.select(n, *(f"`{c}`" for c in docs.columns)).unionByName(many)
    return both.withColumn(fresh(docs, "copy"), F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))).drop(n)
