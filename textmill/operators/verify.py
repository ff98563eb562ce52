"""Deterministic verifiers of answers: word numerals, word formation, kinds of questions. A verdict is 1, 0 or null (no rule fits)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.text import ASCII_DIGITS, BENGALI_DIGITS, lookup_key

_DIGITS = str.maketrans(BENGALI_DIGITS, ASCII_DIGITS)

# Numerals 0 to 99 in order, scales, and the cues of the grammar's wording.
CARDINALS = (
    "শূন্য এক দুই তিন চার পাঁচ ছয় সাত আট নয় দশ এগারো বারো তেরো চৌদ্দ পনেরো ষোল সতেরো আঠারো উনিশ বিশ একুশ বাইশ তেইশ চব্বিশ পঁচিশ ছাব্বিশ সাতাশ আটাশ ঊনত্রিশ ত্রিশ একত্রিশ বত্রিশ তেত্রিশ চৌত্রিশ পঁয়ত্রিশ ছত্রিশ সাঁইত্রিশ আটত্রিশ "
    "ঊনচল্লিশ চল্লিশ একচল্লিশ বিয়াল্লিশ তেতাল্লিশ চুয়াল্লিশ পঁয়তাল্লিশ ছেচল্লিশ সাতচল্লিশ আটচল্লিশ ঊনপঞ্চাশ পঞ্চাশ একান্ন বাহান্ন তিপ্পান্ন চুয়ান্ন পঞ্চান্ন ছাপ্পান্ন সাতান্ন আটান্ন ঊনষাট ষাট একষট্টি বাষট্টি তেষট্টি চৌষট্টি পঁয়ষট্টি ছেষট্টি "
    "সাতষট্টি আটষট্টি ঊনসত্তর সত্তর একাত্তর বাহাত্তর তিয়াত্তর চুয়াত্তর পঁচাত্তর ছিয়াত্তর সাতাত্তর আটাত্তর ঊনআশি আশি একাশি বিরাশি তিরাশি চুরাশি পঁচাশি ছিয়াশি সাতাশি আটাশি ঊননব্বই নব্বই একানব্বই বিরানব্বই তিরানব্বই চুরানব্বই পঁচানব্বই ছিয়ানব্বই "
    "সাতানব্বই আটানব্বই নিরানব্বই"
).split()
SCALES = {"শত": 100, "শ": 100, "হাজার": 1000, "লক্ষ": 100_000, "লাখ": 100_000, "মিলিয়ন": 1_000_000, "কোটি": 10_000_000}
SAMAS = (
    ("পরস্পর", "ব্যতিহার বহুব্রীহি"),
    ("(নাই|নেই).*(যার|যাহার)|(যার|যাহার).*(নাই|নেই)", "নঞ বহুব্রীহি"),
    ("যার|যাহার", "বহুব্রীহি"),
    ("সমাহার", "দ্বিগু"),
    ("(^| )ও( |$)", "দ্বন্দ্ব"),
    ("ন্যায়$", "উপমিত কর্মধারয়"),
    ("ন্যায়", "উপমান কর্মধারয়"),
    ("(^| )ই( |$)", "রূপক কর্মধারয়"),
    ("চিহ্নিত", "মধ্যপদলোপী কর্মধারয়"),
    ("(^| )না( |$)", "নঞ তৎপুরুষ"),
    ("হইতে|থেকে", "পঞ্চমী তৎপুরুষ"),
    ("দ্বারা", "তৃতীয়া তৎপুরুষ"),
    ("জন্য", "চতুর্থী তৎপুরুষ"),
    ("অনুযায়ী|ব্যাপিয়া|পর্যন্ত|ধরিয়া", "অব্যয়ীভাব"),
    ("(^| )যে( |$)", "কর্মধারয়"),
    ("[^ ](ের|র) +[^ ]", "ষষ্ঠী তৎপুরুষ"),
    ("[^ ]ে +[^ ]", "সপ্তমী তৎপুরুষ"),
)
SIGNATURES = (
    ("full_form", "পূর্ণরূপ|full form"),
    ("when", "কখন|কবে|কত সালে|কোন সালে|তারিখে|সালটি"),
    ("where", "কোথায়|কোন জেলায়|কোন স্থানে"),
    ("who", "কে | কে|কার | কার|কাকে|কারা|ব্যক্তির নাম"),
    ("why", "কেন|কীভাবে|কিভাবে|কেমন করে"),
    ("quantity", "কতটি|কত জন|কতজন|কত ভাগ|শতকরা|পরিমাণ"),
    ("which", "কোনটি|কোন "),
)
TEMPORAL = "বর্তমান|এখন|সর্বশেষ|আজ|চলতি|current|latest"


def plain(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").translate(_DIGITS)


_NUMERALS = {unicodedata.normalize("NFKC", w): i for i, w in enumerate(CARDINALS)}
_SCALES = {unicodedata.normalize("NFKC", w): v for w, v in SCALES.items()}


def word_numbers(text: str | None) -> list[int]:
    """Numbers of a text, digits or words: "দুই হাজার পাঁচ" is 2005."""
    out: list[int] = []
    total, part, open_ = 0, 0, False
    for w in [*re.findall(r"[ঀ-৿]+|\d+", plain(text)), ""]:
        v = int(w) if w.isdigit() else _NUMERALS.get(w)
        if v is not None:
            if open_ and part and part % 100 == part:
                out.append(total + part)
                total = part = 0
            part, open_ = part + v, True
        elif w in _SCALES and open_:
            s = _SCALES[w]
            if s == 100:
                part = max(1, part) * 100
            else:
                total, part = total + max(1, part) * s, 0
        elif open_:
            out.append(total + part)
            total, part, open_ = 0, 0, False
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def semantic_numbers(c: pd.Series) -> pd.Series:
    return c.map(word_numbers)


def numbers_agree(gold: Column, response: Column) -> Column:
    """Every number of the gold answer stands in the response."""
    return F.size(F.array_except(semantic_numbers(gold), semantic_numbers(response))) == 0


def samas(c: Column) -> Column:
    """The class of a compound from its explicit analysis; '' if it isn't explicit. A chain of conditions, first match."""
    key = lookup_key(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?s)^[^:]*:", ""), F.lit(" ।")))
    out = F.lit("")
    for pattern, kind in reversed(SAMAS):
        out = F.when(key.rlike(unicodedata.normalize("NFKC", pattern)), kind).otherwise(out)
    return out


def samas_verdict(analysis: Column, answer: Column) -> Column:
    strip = lambda c: F.replace(F.replace(lookup_key(c), F.lit("সমাস"), F.lit("")), F.lit(" "), F.lit(""))
    kind = samas(analysis)
    return F.when(kind != "", (strip(kind) == strip(answer)).cast("int"))


def question_signature(c: Column) -> Column:
    padded = F.concat(F.lit(" "), lookup_key(c), F.lit(" "))
    out = F.lit("what")
    for name, pattern in reversed(SIGNATURES):
        out = F.when(padded.rlike(unicodedata.normalize("NFKC", pattern)), name).otherwise(out)
    return out


def temporal_question(c: Column) -> Column:
    return lookup_key(c).rlike(TEMPORAL)
