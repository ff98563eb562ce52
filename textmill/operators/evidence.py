"""Evidence from encyclopedic text and question banks: years, entities, domains, references, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import text as X

# Cues in the passages' wording.
BIRTH = "জন্ম|born"
FOUNDED = "প্রতিষ্ঠ|স্থাপিত|founded|established"
NOT_BIRTH = "শতবর্ষ|জন্মবার্ষিক"
HONORIFICS = ("শ্রী", "ড.", "ডঃ", "মৌলভী", "হযরত", "স্যার")
DOMAINS = (("bangladesh_law", "আইন|ধারা|অধ্যাদেশ|বিধিমালা|সংবিধান"), ("bangladesh_gov", r"সিটিজেন|নাগরিক\s*সেবা|চার্টার|সরকারি\s*সেবা"), ("bengali_news_2021_2024", r"সাম্প্রতিক|সংবাদ|মন্ত্রী|নির্বাচন|গত\s+বছর"))


def year_list(c: Column) -> Column:
    """Distinct years from 1000 to 2099, in order."""
    return F.array_distinct(F.regexp_extract_all(X.unify_digits(F.coalesce(c, F.lit(""))), F.lit(r"(?<!\d)(1\d{3}|20\d{2})(?!\d)"), F.lit(1)))


def predicate_sentence(c: Column, pattern: str, width: int = 900) -> Column:
    """The first sentence of the first `width` characters with a predicate; '' without one."""
    found = F.filter(F.split(F.substring(c, 1, width), r"[।!?\n]+"), lambda s: s.rlike(pattern))
    return F.coalesce(F.trim(F.get(found, F.lit(0))), F.lit(""))


def birth_year(c: Column) -> Column:
    """The year of a birth sentence; of a pair of calendars the Gregorian one."""
    years = year_list(c)
    late = F.filter(years, lambda y: y.cast("int") >= 1700)
    pick = F.when(c.contains("বঙ্গাব্দ") & (F.size(late) > 0), F.get(late, F.lit(0))).otherwise(F.get(years, F.lit(0)))
    return F.when(c.rlike(BIRTH) & ~c.rlike(NOT_BIRTH), pick)


def establishment_year(c: Column) -> Column:
    return F.when(c.rlike(FOUNDED), F.get(year_list(c), F.lit(0)))


def without_honorific(c: Column) -> Column:
    """An alias key: titles off the front."""
    return F.trim(F.regexp_replace(c, "^((" + "|".join(h.replace(".", "[.]") for h in HONORIFICS) + ")\\s*)+", ""))


def domain_hint(c: Column) -> Column:
    """The corpus a question points to by its wording; '' without a cue."""
    out = F.lit("")
    for name, pattern in reversed(DOMAINS):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def content_tokens(c: Column, stop: list[str] = ()) -> Column:
    """Distinct words of two characters or more of a lookup key, without stop words."""
    # the key comes from an Arrow function, which can't stand in a lambda: words are taken from it by patterns
    words = F.array_distinct(F.regexp_extract_all(X.lookup_key(c), F.lit(r"[^ ]{2,}"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def retrieval_terms(c: Column, stop: list[str] = ()) -> Column:
    """Unigrams and bigrams of the content words."""
    t = content_tokens(c, stop)
    return F.concat(t, X.word_ngrams(t, 2))


def references(df: DataFrame, banks: list[DataFrame], key: str, answers: str, limit: int | None = 12) -> DataFrame:
    """df with `references`: the answers of its key in all banks, distinct by canonical text, in bank order, at most `limit` shown; None: all.

    Answers with one canonical text are merged as rows before a key's are gathered, so a key with many of them costs no comparison of pairs.
    """
    every = []
    for i, b in enumerate(banks):
        rows = b.select(key, answers, F.monotonically_increasing_id().alias("__row"))
        every.append(rows.select(key, F.lit(i).alias("__bank"), "__row", F.posexplode(answers).alias("__at", "__text")))
    place = F.struct("__bank", "__row", "__at", "__text")
    canonical = F.lower(F.regexp_replace("__text", "\\s+", "")).alias("__canonical")
    firsts = reduce(DataFrame.unionByName, every).where(F.col("__text").isNotNull()).groupBy(key, canonical).agg(F.min(place).alias("__first"))
    if limit:
        nth = F.row_number().over(Window.partitionBy(key).orderBy("__first"))
        firsts = firsts.withColumn("__nth", nth).where(F.col("__nth") <= limit)
    shown = firsts.groupBy(key).agg(F.array_sort(F.collect_list("__first"))["__text"].alias("references"))
    return df.join(shown, key, "left").withColumn("references", F.coalesce("references", F.array().cast("array<string>")))


def domain_filtered(candidates: DataFrame, row: str, domain: str, hint: str) -> DataFrame:
    """Candidates of a row's hinted domain, or all of them if none has it or there is no hint."""
    same = (F.col(domain) == F.col(hint)).cast("int")
    any_ = F.max(F.coalesce(same, F.lit(0))).over(Window.partitionBy(row))
    return candidates.withColumn("__any", any_).where((F.col("__any") == 0) | (F.col(domain) == F.col(hint))).drop("__any")


def weighted_rerank(parts: dict[str, float]) -> Column:
    """A weighted sum of score columns."""
    out = F.lit(0.0)
    for c, w in parts.items():
        out = out + w * F.coalesce(F.col(c), F.lit(0.0))
    return out


def judge_prompts(df: DataFrame, key: str, question: str, answer: str, passage: str, limit: int = 1500) -> DataFrame:
    """Two prompts a record, with the options in both orders; the passage is compacted."""
    a, b = F.lit("A) correct\nB) wrong"), F.lit("A) wrong\nB) correct")
    body = F.concat(F.lit("Passage: "), X.compact(F.coalesce(F.col(passage), F.lit("")), limit), F.lit("\nQuestion: "), F.col(question), F.lit("\nAnswer: "), F.col(answer), F.lit("\n"))
    return df.select(key, F.explode(F.array(F.lit(False), F.lit(True))).alias("reverse"), body.alias("__b")).withColumn("prompt", F.concat("__b", F.when(F.col("reverse"), b).otherwise(a))).withColumn("prompt_hash", X.content_hash(F.col("prompt"))).drop("__b")


def two_way(logit_a: Column, logit_b: Column) -> Column:
    """The probability of A among two."""
    return 1 / (1 + F.exp(logit_b - logit_a))


def prefix_of(c: Column, prefixes: list[str]) -> Column:
    """The longest of the prefixes a word begins with; null without one."""
    out = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        out = F.when(F.startswith(c, F.lit(p)), p).otherwise(out)
    return out
