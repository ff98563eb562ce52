"""Pairs of a correct and a wrong answer: pairing, deduplication, contradictions, difficulty, splits' leakage, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import similarity as S
from textmill.functions import text as X


def genuine_pairs(df: DataFrame, pair: str = "pair_id", label: str = "label") -> DataFrame:
    """Rows of pairs with exactly two members and both labels."""
    ok = df.groupBy(pair).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("m")).where("n = 2 and m = 2").select(pair)
    return df.join(ok, pair, "left_semi")


def pivot_pairs(df: DataFrame, value: list[str], pair: str = "pair_id", label: str = "label") -> DataFrame:
    """One row per pair: correct and wrong, as structs."""
    s = F.struct(*value)
    return df.groupBy(pair).agg(F.max(F.when(F.col(label) == 1, s)).alias("correct"), F.max(F.when(F.col(label) == 0, s)).alias("wrong"))


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in order. A minimum of structs, so tasks drop duplicates before the shuffle."""
    cols = df.columns
    rank = F.struct(*order)
    return df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*cols), rank).alias("__r")).select(*(F.col("__r")[c].alias(c) for c in cols))


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    cols = df.columns
    return df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__r")).select(*(F.col("__r")[c].alias(c) for c in cols))


def drop_contradictions(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Without any row whose key has both labels."""
    bad = contradictions(df, keys, label).select(*keys)
    return df.join(bad, keys, "left_anti")


def contradictions(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(label).alias("labels"), F.count(F.lit(1)).alias("n")).where("labels > 1")


def ordered_distinct(values: Column, key=lambda x: x, limit: int | None = None) -> Column:
    """Values of an array with distinct keys, the first of each kept."""
    keys = F.transform(values, key)
    firsts = F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), (F.array_position(keys, key(v)) == i + 1).alias("new"))), lambda s: s["new"])
    out = F.transform(firsts, lambda s: s["v"])
    return F.slice(out, 1, limit) if limit else out


def hardness(question: Column, answer: Column) -> Column:
    """The share of an answer's words that its question has."""
    return S.overlap_share(X.word_set(answer), X.word_set(question))


def difficulty(pairs: DataFrame, similar: float = 0.6) -> DataFrame:
    """pairs (context, correct.answer, wrong.answer) with `difficulty`: with a context, hard if the context holds both answers or neither; else hard if they are alike."""
    c, w = F.col("correct.answer"), F.col("wrong.answer")
    level = S.exact_in_passage(c, F.col("context")) == S.exact_in_passage(w, F.col("context"))
    alike = S.sequence_ratio(c, w) >= similar
    with_ctx, without = pairs.where(X.has_context(F.col("context"))), pairs.where(~X.has_context(F.col("context")) | F.col("context").isNull())
    pick = lambda cond: F.when(cond, "hard").otherwise("easy")
    return with_ctx.withColumn("difficulty", pick(level)).unionByName(without.withColumn("difficulty", pick(alike)))


def content_filter(pairs: DataFrame, question: str = "question", context: str = "context") -> DataFrame:
    """Without cloze gaps, stray vowel signs and questions with a run of six words of their context; `reason` tells the rule."""
    q, c = F.col(question), F.col(context)
    reason = F.when(q.rlike("_{2,}|\\.{4,}|…{2,}"), "cloze").when(q.rlike("(^|\\s)[\\u09BE-\\u09CC]"), "stray_sign").when(X.has_context(c) & S.has_verbatim_run(q, c), "verbatim")
    return pairs.withColumn("reason", reason)


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that more than one split has."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def pair_gap(df: DataFrame, pair: str, position: str) -> DataFrame:
    """The least distance between members of a pair."""
    before = F.lag(position).over(Window.partitionBy(pair).orderBy(position))
    return df.withColumn("__gap", F.col(position) - before).groupBy(pair).agg(F.min("__gap").alias("gap"))


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule is a condition that must hold, null breaks it."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def record_rules() -> dict[str, Column]:
    """The row-level invariants of a record."""
    label, kind, cond = F.col("label"), F.col("hallucination_type"), F.col("condition")
    enum = lambda c, *v: F.col(c).isin(*v)
    return {
        "label_1_is_none": (label == 1) == (kind == "none"),
        "no_context_is_empty": (cond != "no_context") | (F.coalesce("context", F.lit("")) == ""),
        "type_fits_condition": (kind.isin("none", "unlabeled")) | (cond != "no_context") | ~kind.isin("contradiction"),
        "id": F.col("id").rlike("^[a-z]+_[0-9]+(_[0-9]+)?$"),
        "condition": enum("condition", "has_context", "no_context"),
        "label": label.isin(0, 1),
    }


def gate(df: DataFrame, label: str = "label", condition: str = "condition", key: str = "id", pair: str = "pair_id", split: str = "split") -> DataFrame:
    """One row of corpus-level checks and whether all pass."""
    dup = df.groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_ids"))
    torn = leakage(df, pair, split).agg(F.count(F.lit(1)).alias("torn_pairs"))
    shares = df.agg(F.avg(label).alias("share_correct"), F.avg((F.col(condition) == "has_context").cast("int")).alias("share_context"))
    out = shares.crossJoin(dup).crossJoin(torn)  # one row each
    ok = F.col("share_correct").between(0.45, 0.55) & F.col("share_context").between(0.55, 0.65) & (F.col("duplicate_ids") == 0) & (F.col("torn_pairs") == 0)
    return out.withColumn("passed", ok)


def verdict(macro_f1: Column, gate_at: float = 0.6, clean_at: float = 0.55) -> Column:
    """CLEAN, BORDERLINE or ARTIFACTED from a shortcut probe's score."""
    return F.when(macro_f1 < clean_at, "CLEAN").when(macro_f1 < gate_at, "BORDERLINE").otherwise("ARTIFACTED")


def funnel(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, rows) of a chain of frames."""
    out = None
    for i, (name, df) in enumerate(steps):
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("position"), F.lit(name).alias("step"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def to_schema(raw: DataFrame) -> DataFrame:
    """Vendor rows (context, prompt_bn, response_bn, label, subject) as records with pair and member ids by content order."""
    ctx = F.when(X.has_context(F.col("context")), F.trim("context")).otherwise("")
    d = raw.withColumn("context", ctx).withColumn("question", F.trim("prompt_bn")).withColumn("candidate_answer", F.trim("response_bn"))
    d = d.withColumn("pair_key", F.sha2(F.concat_ws("␟", "subject", "context", "question"), 256))
    member = F.row_number().over(Window.partitionBy("pair_key").orderBy(F.desc("label"), "candidate_answer"))
    both = F.count_if(F.col("label") == 1).over(Window.partitionBy("pair_key")) * F.count_if(F.col("label") == 0).over(Window.partitionBy("pair_key")) > 0
    pair = F.concat(F.lit("pool_"), F.conv(F.substring("pair_key", 1, 14), 16, 10))
    return d.select(
        F.concat_ws("_", pair, member).alias("id"), pair.alias("pair_id"), both.alias("pair_complete"), "subject", F.when(F.col("context") == "", "no_context").otherwise("has_context").alias("condition"),
        "context", "question", "candidate_answer", "label", F.when(F.col("label") == 1, "none").otherwise("unlabeled").alias("hallucination_type"), X.script_ratio(F.col("candidate_answer")).alias("bengali_ratio"),
    )
