"""A record as a model's input: its parts within a token budget, the three formats, features, rules, what a reader is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import similarity as S
from textmill.functions import text as X
from textmill.operators.lm import passage_lm_score

# What a separator costs, the budget, the fuzzy rule's limit, the formats.
SEPARATOR_TOKENS = 3
BUDGET = 256
FUZZY = 0.405
FORMATS = ("F1", "F2", "F3")


def make_record(spark: SparkSession, question: str, answer: str, passage: str = "") -> DataFrame:
    """One typed-in record, without a label."""
    kind = "has_context" if passage.strip() else "no_context"
    return spark.createDataFrame([("typed_1", "typed_1", question, answer, passage, kind, "unknown", "unknown")], "id string, pair_id string, question string, candidate_answer string, context string, condition string, difficulty string, subject string")


def cut(c: Column, limit: Column) -> Column:
    """The first `limit` tokens, a number per row."""
    return F.trim(F.call_function("regexp_extract", c, F.concat(F.lit(rf"^\s*+(?:(?>{X.TOKEN})\s*+){{0,"), limit.cast("string"), F.lit("}+")), F.lit(0)))


def record_parts(df: DataFrame, budget: int = BUDGET, raw: bool = False, normalize: bool = True, length=X.count_tokens) -> DataFrame:
    """df with part_context, part_question, part_answer; only the passage is cut, to what question, answer and two separators leave."""
    tidy = (lambda c: F.coalesce(c, F.lit(""))) if raw else (lambda c: X.clean(c, normalize))
    d = df.withColumns({"part_question": tidy(F.col("question")), "part_answer": tidy(F.col("candidate_answer")), "part_context": tidy(F.col("context"))})
    room = F.greatest(F.lit(0), F.lit(budget - 2 * SEPARATOR_TOKENS) - length(F.col("part_question")) - length(F.col("part_answer")))
    return d.withColumn("part_context", F.when(length(F.col("part_context")) <= room, F.col("part_context")).otherwise(cut(F.col("part_context"), room)))


def formatted(parts: DataFrame, fmt: str = "F2") -> DataFrame:
    """parts with text_a and text_b: F1 question and answer; F2 all in one; F3 the passage apart. Without a passage all are F1."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
    qa = F.trim(F.concat_ws(" ", "part_question", "part_answer"))
    bare = F.col("part_context") == ""
    if fmt == "F1":
        a, b = qa, F.lit("")
    elif fmt == "F2":
        a, b = F.when(bare, qa).otherwise(F.trim(F.concat_ws(" ", "part_context", qa))), F.lit("")
    else:
        a, b = F.when(bare, qa).otherwise(F.col("part_context")), F.when(bare, F.lit("")).otherwise(qa)
    return parts.withColumn("text_a", a).withColumn("text_b", b)


def flat(a: Column, b: Column) -> Column:
    return F.when(b == "", a).otherwise(F.concat_ws(f" {X.SEP} ", a, b))


def token_list(parts: DataFrame, fmt: str = "F2", variant: str = "V1", **how) -> DataFrame:
    """parts with `tokens`: a separator between all parts, each part under the variant."""
    own = lambda c: X.preprocess(F.col(c), variant, **how)
    sep = F.array(F.lit(X.SEP))
    qa = F.concat(own("part_question"), sep, own("part_answer"))
    full = F.concat(own("part_context"), sep, qa)
    return parts.withColumn("tokens", qa if fmt == "F1" else F.when(F.col("part_context") == "", qa).otherwise(full))


def part_texts(parts: DataFrame, variant: str = "V1", **how) -> DataFrame:
    """parts with each part as its tokens joined by spaces."""
    return parts.withColumns({f"text_{p}": F.array_join(X.preprocess(F.col(f"part_{p}"), variant, **how), " ") for p in ("context", "question", "answer")})


def features(df: DataFrame, normalize: bool = True) -> DataFrame:
    """df with the similarity features of a record with itself; without a passage the fixed worst values.

    Rows with and without a passage are split first, so the Arrow functions see only rows that need them.
    """
    d = df.withColumns({"__a": X.clean(F.col("candidate_answer"), normalize), "__q": X.clean(F.col("question"), normalize), "__p": X.clean(F.col("context"), normalize)})
    n = F.length("__a")
    d = d.withColumns({
        "has_context": (F.col("__p") != "").cast("double"),
        "answer_len": n.cast("double"),
        "digit_share": F.when(n > 0, F.regexp_count("__a", F.lit("[0-9]")) / n).otherwise(F.lit(0.0)),
        "edit_question": S.normalised_best_match(F.col("__a"), F.col("__q")),
    })
    trimmed = F.rtrim("__a", F.lit("।. "))
    words = F.filter(X.tokenize(F.col("__a")), X.is_word_token)
    own = X.tokenize(F.col("__p"))
    with_passage = d.where(F.col("__p") != "").withColumns({
        "exact_in_passage": ((trimmed != "") & F.contains(F.col("__p"), trimmed)).cast("double"),
        "edit_passage": S.normalised_best_match(trimmed, F.col("__p")),
        "token_overlap": F.when(F.size(words) > 0, F.size(F.filter(words, lambda t: F.array_contains(own, t))) / F.size(words)).otherwise(F.lit(0.0)),
        "lm_passage": passage_lm_score()(F.col("__a"), F.col("__p")),
    })
    without = d.where(F.col("__p") == "").withColumns({"exact_in_passage": F.lit(0.0), "edit_passage": F.lit(1.0), "token_overlap": F.lit(0.0), "lm_passage": F.lit(0.0)})
    return with_passage.unionByName(without).drop("__a", "__q", "__p")


FEATURES = ["has_context", "answer_len", "digit_share", "edit_question", "exact_in_passage", "edit_passage", "token_overlap", "lm_passage"]


def rule_predictions(df: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """df of features with the baselines' predictions: always correct, found word for word, found nearly."""
    return df.withColumns({"always": F.lit(1), "exact": (F.col("exact_in_passage") == 1).cast("int"), "fuzzy": (F.col("edit_passage") <= fuzzy).cast("int")})


def evidence_rows(df: DataFrame, key: str) -> DataFrame:
    """A row per record and feature, with a sentence for the reader."""
    say = {
        "exact_in_passage": F.when(F.col("exact_in_passage") == 1, "the answer stands in the passage").otherwise("the answer does not stand in the passage"),
        "edit_passage": F.format_string("nearest passage text differs by %.0f%%", F.col("edit_passage") * 100),
        "token_overlap": F.format_string("%.0f%% of the answer's words are in the passage", F.col("token_overlap") * 100),
        "edit_question": F.format_string("differs from the question by %.0f%%", F.col("edit_question") * 100),
    }
    bare = F.col("has_context") == 0
    rows = [F.struct(F.lit(k).alias("feature"), F.col(k).alias("value"), F.when(bare & F.lit(k != "edit_question"), "no passage").otherwise(v).alias("text")) for k, v in say.items()]
    return df.select(key, F.explode(F.array(*rows)).alias("e")).select(key, "e.*")


def rule_verdicts(df: DataFrame, key: str, fuzzy: float = FUZZY) -> DataFrame:
    """(key, rule, verdict, why) of the two rules; without a passage neither can tell."""
    bare = F.col("has_context") == 0
    one = lambda name, ok, why: F.struct(F.lit(name).alias("rule"), F.when(bare, "cannot tell").when(ok, "correct").otherwise("wrong").alias("verdict"), F.when(bare, "no passage").otherwise(why).alias("why"))
    rows = F.array(one("exact", F.col("exact_in_passage") == 1, F.lit("word for word")), one("fuzzy", F.col("edit_passage") <= fuzzy, F.format_string("distance %.3f, limit %.3f", F.col("edit_passage"), F.lit(fuzzy))))
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def confidence_text(scale: Column, value: Column) -> Column:
    """A probability as per cent, a margin or a gap with its sign."""
    return F.when(scale == "probability", F.format_string("%.0f%% sure", F.greatest(value, 1 - value) * 100)).when(scale == "margin", F.format_string("margin %+.2f", value)).otherwise(F.format_string("gap %+.3f", value))


def invariant_to_order(df: DataFrame, tokens: str, key: str, seed: int = 0) -> DataFrame:
    """df with its tokens in another order, to test what a model reads of order."""
    return df.withColumn(tokens, X.shuffled_tokens(F.col(tokens), F.col(key), seed))


def describe(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows, pairs, shares and mean lengths of each split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("pair_id").alias("pairs"), F.avg("label").alias("share_correct"), F.avg((F.col("condition") == "has_context").cast("int")).alias("share_context"), F.avg(F.length("candidate_answer")).alias("mean_answer"))


def mix_report(df: DataFrame, key: str) -> DataFrame:
    """Rows and per cent of each value."""
    from pyspark.sql import Window

    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2))
