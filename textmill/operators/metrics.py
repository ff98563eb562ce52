"""Scores of predictions: confusion counts, F1, AUC with ties, slices, bootstrap by cluster, McNemar, kappa, thresholds.

Truth and prediction are columns of 0 and 1; the positive class is 1. Rows with a null in either are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _if(c: Column) -> Column:
    return F.count_if(c)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(truth: str, pred: str, label: int = 1) -> dict[str, Column]:
    """hit, false_alarm and missed of a label, as aggregates."""
    t, p = F.col(truth) == label, F.col(pred) == label
    return {"hit": _if(t & p), "false_alarm": _if(~t & p), "missed": _if(t & ~p)}


def precision_recall_f1(truth: str, pred: str, label: int = 1) -> dict[str, Column]:
    c = confusion(truth, pred, label)
    return {
        "precision": _ratio(c["hit"], c["hit"] + c["false_alarm"]),
        "recall": _ratio(c["hit"], c["hit"] + c["missed"]),
        "f1": _ratio(2 * c["hit"], 2 * c["hit"] + c["false_alarm"] + c["missed"]),
    }


def macro_f1(truth: str, pred: str) -> Column:
    return (precision_recall_f1(truth, pred, 0)["f1"] + precision_recall_f1(truth, pred, 1)["f1"]) / 2


def accuracy(truth: str, pred: str) -> Column:
    return _ratio(_if(F.col(truth) == F.col(pred)), F.count(F.lit(1)))


def _scored(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())


def _result(truth: str, pred: str, small: int) -> list[Column]:
    one, zero = precision_recall_f1(truth, pred, 1), precision_recall_f1(truth, pred, 0)
    return [
        F.count(F.lit(1)).alias("n"),
        macro_f1(truth, pred).alias("macro_f1"),
        accuracy(truth, pred).alias("accuracy"),
        one["f1"].alias("f1_correct"),
        zero["precision"].alias("precision_wrong"),
        zero["recall"].alias("recall_wrong"),
        zero["f1"].alias("f1_wrong"),
        (F.min(pred) == F.max(pred)).alias("collapsed"),
        (F.count(F.lit(1)) < small).alias("small"),
    ]


def evaluate(df: DataFrame, truth: str, pred: str, small: int = 60) -> DataFrame:
    """One row of scores; `collapsed`: one class only is predicted, `small`: too few rows to trust."""
    return _scored(df, truth, pred).agg(*_result(truth, pred, small))


def slice_by(df: DataFrame, truth: str, pred: str, keys: list[str], small: int = 60) -> DataFrame:
    """A row of scores for each value of each key, and one for all rows, in one pass."""
    d = _scored(df, truth, pred).select(*(F.col(k).cast("string").alias(k) for k in keys), truth, pred)
    long = d.select(truth, pred, F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *(F.struct(F.lit(k).alias("slice"), F.col(k).alias("value")) for k in keys))).alias("s"))
    return long.groupBy("s.slice", "s.value").agg(*_result(truth, pred, small))


def auc(df: DataFrame, truth: str, score: str, keys: list[str] = ()) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null if one class is missing.

    Rows are first counted per score, so the window runs over distinct scores, not rows.
    """
    d = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    per = d.groupBy(*keys, score).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("q"))
    below = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / 2.0)
    g = per.withColumn("won", won).groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return g.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("won") / (F.col("p") * F.col("q"))).alias("auc"))


def feature_aucs(df: DataFrame, truth: str, features: list[str]) -> DataFrame:
    """AUC and class means of each feature, from one unpivot."""
    long = df.select(truth, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("f")).select(truth, "f.feature", "f.x")
    means = long.groupBy("feature").agg(F.avg(F.when(F.col(truth) == 1, F.col("x"))).alias("mean_correct"), F.avg(F.when(F.col(truth) == 0, F.col("x"))).alias("mean_wrong"))
    return auc(long, truth, "x", ["feature"]).join(means, "feature")


def by_error_type(df: DataFrame, pair: str, truth: str, pred: str, kind: str, skip: str = "unlabeled") -> DataFrame:
    """For each type of wrong answer: pairs, the share caught, and macro-F1 over both members."""
    of_pair = F.max(F.when(F.col(truth) == 0, F.col(kind))).over(Window.partitionBy(pair))
    d = df.withColumn("__kind", of_pair).where(F.col("__kind").isNotNull() & (F.col("__kind") != skip))
    wrong = F.col(truth) == 0
    return d.groupBy(F.col("__kind").alias("error_type")).agg(F.count_if(wrong).alias("n"), _ratio(F.count_if(wrong & (F.col(pred) == 0)), F.count_if(wrong)).alias("caught"), macro_f1(truth, pred).alias("macro_f1"))


def _sweep(df: DataFrame, truth: str, score: str, grid: list[float], keep_low: bool, keys: list[str]) -> DataFrame:
    """macro-F1 at each threshold of the grid, from counts per score bin: no row is multiplied by the grid."""
    d = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    # the number of thresholds that the score passes (score >= t, or score <= t)
    places = F.array(*map(F.lit, grid))
    k = F.size(F.filter(places, lambda t: (F.col(score) <= t) if keep_low else (F.col(score) >= t)))
    bins = d.groupBy(*keys, k.alias("k")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("q"))
    cells = bins.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    passes = (F.lit(len(grid)) - F.col("k") <= F.col("i")) if keep_low else (F.col("i") < F.col("k"))
    s = lambda c, yes: F.sum(F.when(passes if yes else ~passes, F.col(c)).otherwise(0))
    g = cells.groupBy(*keys, "i").agg(s("p", True).alias("tp"), s("q", True).alias("fp"), s("p", False).alias("fn"), s("q", False).alias("tn"))
    f = lambda a, b, c: _ratio(2 * a, 2 * a + b + c)
    score_ = (f(F.col("tp"), F.col("fp"), F.col("fn")) + f(F.col("tn"), F.col("fn"), F.col("fp"))) / 2
    return g.select(*keys, F.element_at(places, F.col("i") + 1).alias("threshold"), score_.alias("macro_f1"))


def threshold_sweep(df: DataFrame, truth: str, score: str, grid: list[float] | None = None, keep_low: bool = False, keys: list[str] = ()) -> DataFrame:
    """(threshold, macro_f1) over the grid 0.05, 0.06 ... 0.95, or 0, 0.005 ... 1 where a low score means correct."""
    if grid is None:
        grid = [i / 200 for i in range(201)] if keep_low else [round(0.05 + i / 100, 2) for i in range(91)]
    return _sweep(df, truth, score, grid, keep_low, list(keys))


def tune_threshold(df: DataFrame, truth: str, score: str, **how) -> DataFrame:
    """The first best threshold."""
    return threshold_sweep(df, truth, score, **how).agg(F.max_by("threshold", F.struct("macro_f1", -F.col("threshold"))).alias("threshold"), F.max("macro_f1").alias("macro_f1"))


def draws(cluster: Column, replicate: Column, seed: int) -> Column:
    """How often a cluster is drawn in a replicate: Poisson(1) by the inverse of its distribution, from md5."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", cluster.cast("string"), replicate.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 4294967296.0
    edges, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        edges.append(round(total, 12))
    out = F.lit(0)
    for e in edges:
        out = out + F.when(u >= e, 1).otherwise(0)
    return out


def bootstrap(df: DataFrame, truth: str, pred: str, cluster: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(low, high): the 2.5 and 97.5 per cent replicates of macro-F1, resampling clusters, by index.

    Each cluster's four counts are summed once; replicates weigh counts, rows are never copied.
    """
    d = _scored(df, truth, pred)
    cell = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    per = d.groupBy(cluster).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    # clusters go to tasks as they lie; each replicate is a sum that tasks combine before the shuffle
    reps = per.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("m", draws(F.col(cluster), F.col("r"), seed)).where("m > 0")
    g = reps.groupBy("r").agg(*(F.sum(F.col(c) * F.col("m")).alias(c) for c in ("tp", "fp", "fn", "tn")))
    f = lambda a, b, c: _ratio(2 * F.col(a), 2 * F.col(a) + F.col(b) + F.col(c))
    scores = g.select(((f("tp", "fp", "fn") + f("tn", "fn", "fp")) / 2).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    at = lambda q: F.get("s", F.floor(F.size("s") * F.lit(q)).cast("int"))
    return scores.select(at(0.025).alias("low"), F.get("s", F.least(F.floor(F.size("s") * F.lit(0.975)).cast("int"), F.size("s") - 1)).alias("high"))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided sign test on the discordant counts."""
    n, k = b + c, min(b, c)
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n <= 1000 else math.erfc((abs(b - c) - 1) / math.sqrt(2 * n))


def mcnemar(df: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """(only_a, only_b, p): rows that one prediction alone gets right."""
    ok = lambda x: F.col(x) == F.col(truth)
    counts = df.agg(F.count_if(ok(a) & ~ok(b)).alias("only_a"), F.count_if(ok(b) & ~ok(a)).alias("only_b"))
    p = F.udf(lambda x, y: float(mcnemar_p(x, y)), "double")  # one row
    return counts.withColumn("p", p("only_a", "only_b"))


def kappa(df: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """Cohen's kappa of two raters (1 if chance agreement is 1), observed agreement and the number of items."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = d.groupBy(*keys, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("items"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    side = lambda c, n: cells.groupBy(*keys, F.col(c).alias("value")).agg(F.sum("n").alias(n))
    both = side("x", "nx").join(side("y", "ny"), [*keys, "value"])
    chance = both.groupBy(*keys).agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("chance"))
    out = total.join(chance, list(keys), "left") if keys else total.crossJoin(chance)
    e = F.coalesce("chance", F.lit(0.0)) / (F.col("items").cast("double") * F.col("items"))
    o = F.col("same") / F.col("items")
    return out.select(*keys, "items", o.alias("agreement"), F.when(e >= 1, F.lit(1.0)).otherwise((o - e) / (1 - e)).alias("kappa"))


def agreement_by(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"))


def summarise_seeds(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean and population deviation over runs."""
    return df.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.count(F.lit(1)).alias("runs"))


def leaderboard(df: DataFrame, model: str, score: str, hard: str) -> DataFrame:
    """Mean, sample deviation, mean hard score and runs of each model, best first."""
    return df.groupBy(model).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.avg(hard).alias("mean_hard"), F.count(F.lit(1)).alias("runs")).orderBy(F.desc("mean"), model)


def scoreboard(log: DataFrame, model: str, seed: str, position: str, score: str, hard: str) -> DataFrame:
    """The latest row of each model and seed, then means over seeds, ranked by the hard score."""
    last = log.groupBy(model, seed).agg(F.max_by(F.struct(score, hard), position).alias("r"))
    g = last.groupBy(model).agg(F.avg(f"r.{score}").alias(score), F.avg(f"r.{hard}").alias(hard), F.count(F.lit(1)).alias("seeds"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(hard), model)))


def length_distribution(df: DataFrame, size: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Percentiles by index (element int(n * share) of the sorted sizes) and the maximum, from counts per size."""
    per = df.where(F.col(size).isNotNull()).groupBy(size).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(size))
    per = per.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    pick = [F.min(F.when(F.col("upto") > F.floor(F.col("total") * s), F.col(size))).alias(f"p{round(s * 100)}") for s in shares]
    return per.agg(*pick, F.max(size).alias("max"))


def overlap_probe(df: DataFrame, truth: str, copied: str, level: str, warn_at: float = 0.70) -> DataFrame:
    """(value, n, macro_f1, warn) of the rule that an answer copied from its passage is right, over all rows and per level; `warn`: a string matcher nearly solves all of them."""
    s = slice_by(df, truth, copied, [level])
    return s.select("value", "n", "macro_f1", ((F.col("slice") == "all") & (F.col("macro_f1") >= warn_at)).alias("warn"))


def majority_prior(df: DataFrame, truth: str) -> DataFrame:
    """(majority, n, macro_f1) of always predicting the most common label, the smaller one of a tie."""
    per = df.where(F.col(truth).isNotNull()).groupBy(truth).agg(F.count(F.lit(1)).alias("n"))
    g = per.agg(F.max_by(truth, F.struct("n", -F.col(truth))).alias("majority"), F.max("n").alias("most"), F.sum("n").alias("n"))
    return g.select("majority", "n", (F.col("most") / (F.col("most") + F.col("n"))).alias("macro_f1"))


def baseline_table(df: DataFrame, truth: str, rules: dict[str, Column], slices: list[str]) -> DataFrame:
    """(model, slice, value, n, macro_f1, accuracy): every rule over all rows and over each value of the slices, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), c.cast("int").alias("p")) for k, c in rules.items()))).alias("m")
    d = df.select(truth, *(F.col(c).cast("string").alias(c) for c in slices), each).select(truth, *slices, "m.model", F.col("m.p").alias("__p"))
    parts = F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *(F.struct(F.lit(c).alias("slice"), F.col(c).alias("value")) for c in slices))
    long = d.select(truth, "model", "__p", F.explode(parts).alias("s"))
    return long.groupBy("model", "s.slice", "s.value").agg(F.count(F.lit(1)).alias("n"), macro_f1(truth, "__p").alias("macro_f1"), accuracy(truth, "__p").alias("accuracy"))
