"""Edit distances, set and sequence similarities, answer equivalence."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.text import canonical_text, distinct_numbers, lookup_key, trim_answer, whitespace_tokens


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def best_match(needle: str, haystack: str) -> int:
    """The least edit distance of needle to any substring of haystack."""
    if not needle:
        return 0
    if not haystack:
        return len(needle)
    h = np.frombuffer(haystack.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(h) + 1, np.int64)  # the match may start anywhere
    step = np.arange(len(h) + 1)
    for i, ch in enumerate(np.frombuffer(needle.encode("utf-32-le"), np.uint32), 1):
        nxt = np.empty_like(row)
        nxt[0] = i
        nxt[1:] = np.minimum(row[:-1] + (h != ch), row[1:] + 1)
        row = np.minimum.accumulate(nxt - step) + step  # insertions run along the row
    return int(row.min())


@F.pandas_udf(T.IntegerType())
def best_match_distance(needle: pd.Series, haystack: pd.Series) -> pd.Series:
    return pd.Series([best_match(a or "", b or "") for a, b in zip(needle, haystack, strict=True)], dtype="int32")


def normalised_best_match(needle: Column, haystack: Column) -> Column:
    """Distance over the needle's length; 1 for an empty needle."""
    n = F.length(needle)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(1.0)).otherwise(best_match_distance(needle, haystack) / n)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _partial(a: str, b: str) -> float:
    small, large = sorted((a, b), key=len)
    if not small:
        return 0.0
    best = 0.0
    for block in difflib.SequenceMatcher(None, small, large, autojunk=False).get_matching_blocks():
        at = max(0, min(block.b - block.a, len(large) - len(small)))
        best = max(best, difflib.SequenceMatcher(None, small, large[at : at + len(small)], autojunk=False).ratio())
    return 100 * best


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_partial(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def token_set(a: str, b: str) -> float:
    """The best ratio among the sorted common words and the two sorted word sets."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    full = [" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x)]
    r = lambda p, q: 100 * difflib.SequenceMatcher(None, p, q, autojunk=False).ratio()
    return max(r(both, full[0]) if both else 0.0, r(both, full[1]) if both else 0.0, r(*full))


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def overlap_share(a: Column, b: Column) -> Column:
    """The share of the distinct words of a that b has, too."""
    n = F.size(F.array_distinct(a))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def text_similarity(a: Column, b: Column) -> Column:
    """The larger of the sequence ratio and the word Jaccard of the lookup keys, 0 to 1."""
    x, y = lookup_key(a), lookup_key(b)
    return F.greatest(sequence_ratio(x, y), jaccard(whitespace_tokens(x), whitespace_tokens(y)))


def answer_equivalence(a: Column, b: Column, similar: float = 0.92, contained: float = 0.55) -> Column:
    """Equal keys, or one in the other with enough of its length, or similar; never with other numbers."""
    x, y = canonical_text(a), canonical_text(b)
    same_numbers = F.array_sort(distinct_numbers(a)) == F.array_sort(distinct_numbers(b))
    short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    inside = (short > 0) & (F.contains(x, y) | F.contains(y, x)) & (short / long_ >= contained)
    return F.when((x == "") | (y == ""), False).otherwise((x == y) | same_numbers & (inside | (text_similarity(a, b) >= similar)))


def exact_in_passage(answer: Column, passage: Column) -> Column:
    """The answer without trailing stops stands in the passage."""
    a = trim_answer(answer)
    return (F.coalesce(passage, F.lit("")) != "") & (a != "") & F.contains(passage, a)


def context_support(answer: Column, passage: Column) -> Column:
    a = canonical_text(answer)
    return (a != "") & F.contains(canonical_text(passage), a)


def has_verbatim_run(question: Column, context: Column, words: int = 6) -> Column:
    """A run of `words` white-space words of the question stands in the context."""
    q = whitespace_tokens(question)
    padded = F.concat(F.lit(" "), F.array_join(whitespace_tokens(context), " "), F.lit(" "))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(q) - words + 1, F.lit(1))), lambda i: F.array_join(F.slice(q, i, words), " "))
    return (F.size(q) >= words) & F.exists(runs, lambda r: F.contains(padded, F.concat(F.lit(" "), r, F.lit(" "))))


def verbatim_run_length(question: Column, context: Column) -> Column:
    """The longest run of white-space words of the question that stands in the context."""

    @F.pandas_udf(T.IntegerType())
    def longest(q: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(q, c, strict=True):
            a, b = (a or "").split(), (b or "").split()
            m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
            out.append(m.size)
        return pd.Series(out, dtype="int32")

    return longest(question, context)


def one_substitution(a: Column, b: Column, pairs: list[tuple[str, str]]) -> Column:
    """Words of one length that differ in one place, by a confusable pair."""
    both = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, F.concat(F.least(x, y), F.greatest(x, y))))
    diff = F.filter(both, lambda x: x.isNotNull())
    return (F.length(a) == F.length(b)) & (F.size(diff) == 1) & F.element_at(diff, 1).isin(["".join(sorted(p)) for p in pairs])
