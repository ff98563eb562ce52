"""Annotation: votes, consensus, settled types, sheets' checks, judge replies, merging decisions into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import similarity as S
from textmill.functions.text import collapse_whitespace, normalized_cell

# The words of a label cell, and the types each condition allows.
LABEL_WORDS = {"correct": 1, "1": 1, "ok": 1, "right": 1, "true": 1, "wrong": 0, "0": 0, "incorrect": 0, "hallucinated": 0, "false": 0}
STRICT_WORDS = {"correct": 1, "wrong": 0}
INTRINSIC = ("entity", "numeric", "relational", "contradiction")
EXTRINSIC = ("fabricated", "overclaim")


def label_of(c: Column, words: dict[str, int] = LABEL_WORDS) -> Column:
    t = F.lower(F.trim(c))
    out = F.lit(None).cast("int")
    for v in set(words.values()):
        out = F.when(t.isin([w for w, x in words.items() if x == v]), v).otherwise(out)
    return out


def allowed_types(condition: Column) -> Column:
    return F.when(condition == "has_context", F.array(*map(F.lit, INTRINSIC))).otherwise(F.array(*map(F.lit, EXTRINSIC)))


def consensus(votes: DataFrame, item: str, judge: str, vote: str, threshold: float) -> DataFrame:
    """(item, value, agreement, accepted): the most common vote (first judge wins ties) over all judges, abstentions included."""
    judges = votes.groupBy(item).agg(F.count(F.lit(1)).alias("judges"))
    counts = votes.where(F.col(vote).isNotNull()).groupBy(item, vote).agg(F.count(F.lit(1)).alias("n"), F.min(judge).alias("first"))
    top = counts.groupBy(item).agg(F.min_by(F.struct(vote, "n"), F.struct(-F.col("n"), F.col("first"))).alias("t"))
    share = F.coalesce(F.col("t.n") / F.col("judges"), F.lit(0.0))
    return judges.join(top, item, "left").select(item, F.col(f"t.{vote}").alias("value"), share.alias("agreement"), (F.col("t").isNotNull() & (share >= threshold - 1e-9)).alias("accepted"))


def settle(votes: DataFrame, record: str, label: str, kind: str, condition: str) -> DataFrame:
    """(record, type, source) for a wrong answer that its annotators agree on, else a null type and the reason."""
    g = votes.groupBy(record, condition).agg(F.collect_set(kind).alias("types"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("wrong"), F.count_if(F.col(label) == 1).alias("right"), F.count_if(F.col(label).isNull()).alias("unsure"))
    one = (F.size("types") == 1) & (F.col("wrong") == F.col("n"))
    fits = F.array_contains(allowed_types(F.col(condition)), F.element_at("types", 1))
    reason = (
        F.when(one & fits, F.when(F.col("n") == 2, "double_annotated").otherwise("single_annotated"))
        .when(one, "type not valid for the condition")
        .when(F.col("wrong") == F.col("n"), "different types")
        .when(F.col("unsure") > 0, "unsure or unreadable")
        .when(F.col("right") == F.col("n"), "humans say correct")
        .otherwise("humans disagree")
    )
    return g.select(record, F.when(one & fits, F.element_at("types", 1)).alias("type"), reason.alias("source"))


def decide(df: DataFrame, settled: DataFrame, adjudicated: DataFrame, judged: DataFrame, record: str, label: str = "label") -> DataFrame:
    """df with type and type_source: definitional, adjudicated, settled by humans, by judges, or awaiting."""
    out = df.join(settled.select(record, F.col("type").alias("__s"), F.col("source").alias("__why")), record, "left")
    out = out.join(adjudicated.select(record, F.col("type").alias("__a")), record, "left").join(judged.select(record, F.col("type").alias("__j")), record, "left")
    kind = F.when(F.col(label) == 1, "none").otherwise(F.coalesce("__a", "__s", "__j", F.lit("unlabeled")))
    source = F.when(F.col(label) == 1, "definitional").when(F.col("__a").isNotNull(), "adjudicated").when(F.col("__s").isNotNull(), F.col("__why")).when(F.col("__j").isNotNull(), "llm").otherwise(F.coalesce("__why", F.lit("awaiting")))
    return out.select(*df.columns, kind.alias("hallucination_type"), source.alias("type_source"))


def exclusions(df: DataFrame, pair: str, reason: str) -> DataFrame:
    """(pair, exclusion_reason): a pair goes as a whole; its reasons, sorted, joined by +."""
    return df.where(F.col(reason).isNotNull()).groupBy(pair).agg(F.array_join(F.array_sort(F.collect_set(reason)), "+").alias("exclusion_reason"))


def derive_type(correct: Column, wrong: Column, condition: Column) -> Column:
    """numeric if both differ in numbers and there is a passage; fabricated if there is none and they are unlike; else ''."""
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9০-৯]+"), F.lit(0))
    a, b = collapse_whitespace(correct), collapse_whitespace(wrong)
    x, y = digits(a), digits(b)
    return F.when(condition == "has_context", F.when((F.size(x) + F.size(y) > 0) & (x != y), "numeric").otherwise("")).otherwise(F.when(S.sequence_ratio(a, b) < 0.9, "fabricated").otherwise(""))


def sheet_problems(sheet: DataFrame, mapping: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, problem) of a filled sheet against its mapping: unknown or repeated ids, label and type words, changed texts."""
    n = sheet.groupBy(item).agg(F.count(F.lit(1)).alias("__n"))
    known = mapping.select(item, "condition", *(F.col(c).alias(f"__{c}") for c in ("question", "answer")))
    d = sheet.drop("condition").join(n, item).join(known, item, "left")
    label, kind = label_of(F.col("your_label"), STRICT_WORDS), F.lower(F.trim(F.coalesce("your_type", F.lit(""))))
    rules = {
        "unknown item": F.col("__question").isNull(),
        "repeated item": F.col("__n") > 1,
        "label": label.isNull() & ~F.lower(F.trim("your_label")).isin("unsure", ""),
        "type of a correct answer": (label == 1) & ~kind.isin("", "none"),
        "type missing": (label == 0) & (kind == ""),
        "type and label swapped": F.lower(F.trim("your_label")).isin(*INTRINSIC, *EXTRINSIC),
        "type not allowed": (label == 0) & (kind != "") & ~F.array_contains(allowed_types(F.col("condition")), kind),
        "text changed": (normalized_cell(F.col("question")) != normalized_cell(F.col("__question"))) | (normalized_cell(F.col("answer")) != normalized_cell(F.col("__answer"))),
    }
    return d.select(item, F.explode(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))).alias("problem"))


def parse_reply(reply: Column, field: str, allowed: list[str]) -> Column:
    """struct(value, confidence) of a judge's reply: its JSON object if it has a valid one, else a bare word, else null and 0."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    value = F.lower(F.trim(F.get_json_object(body, f"$.{field}")))
    given = F.get_json_object(body, "$.confidence").try_cast("double") if hasattr(Column, "try_cast") else F.get_json_object(body, "$.confidence").cast("double")
    word = F.lit(None).cast("string")
    for a in reversed(allowed):
        word = F.when(reply.rlike(rf"(?i)\b{a}\b"), a).otherwise(word)
    ok = value.isin(allowed)
    has = F.get_json_object(body, "$.confidence").isNotNull()
    sure = F.when(has & given.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), given))).otherwise(F.lit(0.5))
    return F.struct(F.when(ok, value).otherwise(word).alias("value"), F.when(ok, sure).when(word.isNotNull(), 0.4).otherwise(0.0).alias("confidence"))


def order_swap(p_normal: Column, p_reverse: Column, threshold: float = 0.5) -> dict[str, Column]:
    """Of a judge's two prompt orders: the mean, the gap, and the label if both orders agree."""
    a, b = p_normal >= threshold, p_reverse >= threshold
    return {"p": (p_normal + p_reverse) / 2, "gap": F.abs(p_normal - p_reverse), "label": F.when(a == b, a.cast("int"))}


def prompt(context: Column, question: Column, answer: Column) -> Column:
    item = F.concat(F.lit("QUESTION:\n"), question, F.lit("\n\nCANDIDATE ANSWER:\n"), answer)
    return F.when(F.coalesce(context, F.lit("")) == "", item).otherwise(F.concat(F.lit("PASSAGE:\n"), context, F.lit("\n\n"), item))


def mock_judge(key: Column, allowed: list[str], seed: int = 0) -> Column:
    """A reply that key and seed fix; stands in for a model."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 7), 16, 10).cast("long")
    return F.to_json(F.struct(F.element_at(F.array(*map(F.lit, allowed)), (h % len(allowed) + 1).cast("int")).alias("verdict"), ((h % 50 + 50) / 100.0).alias("confidence")))


def progress(sheet: DataFrame, file: str = "file") -> DataFrame:
    done = F.coalesce(F.trim("your_label"), F.lit("")) != ""
    return sheet.groupBy(file).agg(F.count(F.lit(1)).alias("rows"), F.count_if(done).alias("done"))
