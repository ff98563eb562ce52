"""Cleaning, tokenising and normalising text, as Column functions planned by Catalyst.

Only what Spark has no built-in for (Unicode normal forms, HTML entities) runs as an Arrow UDF. Offsets and lengths are code
points. Null text is treated as empty unless a function says otherwise.
"""

from __future__ import annotations

import html
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scripts, digits, marks and token classes the operators must agree on.
BENGALI_DIGITS, ASCII_DIGITS = "০১২৩৪৫৬৭৮৯", "0123456789"
CITATION = r"\[[0-9০-৯]+\](?!\{)"
TOKEN = r"[ঀ-৿‌‍]+|[0-9]+(?:[.,][0-9]+)*|[A-Za-zÀ-ɏ]+|\S"
WORD_CHARS = r"[\p{L}\p{N}_]"
NULL_WORDS = ("", "[null]", "null", "none", "nan")
NEGATIONS = ("নি", "না")
VARIANTS = ("V0", "V1", "V2", "V3", "V4", "V2-demo")
SEP = "<SEP>"
SPACE = r"(?U)\s+"


def _form(kind: str):
    @F.pandas_udf(T.StringType())
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(kind, x))

    return form


def nfc(c: Column) -> Column:
    """Unicode NFC."""
    return _form("NFC")(c)


def nfkc(c: Column) -> Column:
    return _form("NFKC")(c)


def remove_citations(c: Column) -> Column:
    """Without [1] or [২], but not the [7] of \\sqrt[7]{n}."""
    return F.regexp_replace(c, CITATION, "")


def unify_digits(c: Column) -> Column:
    return F.translate(c, BENGALI_DIGITS, ASCII_DIGITS)


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean(c: Column, normalize: bool = True) -> Column:
    """Normal form, citations, digits, white space; null gives ''. Without `normalize` all of it stays in the JVM."""
    c = F.coalesce(c, F.lit(""))
    return collapse_whitespace(unify_digits(remove_citations(nfc(c) if normalize else c)))


def tokenize(c: Column) -> Column:
    """Words, numbers and single marks; joined they are the text without its spaces."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def whitespace_tokens(c: Column) -> Column:
    t = collapse_whitespace(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_set(c: Column, fixed: bool = False) -> Column:
    """Distinct lowered words; \\w without combining marks as in Python, or whole white-space words if `fixed`."""
    return F.array_distinct(whitespace_tokens(F.lower(c)) if fixed else F.regexp_extract_all(F.lower(c), F.lit(WORD_CHARS + "+"), F.lit(0)))


def count_tokens(c: Column) -> Column:
    return F.size(tokenize(c))


def remove_stopwords(tokens: Column, stop: list[str], protected: list[str] = ()) -> Column:
    drop = sorted(set(stop) - set(protected))
    return F.filter(tokens, lambda t: ~t.isin(drop)) if drop else tokens


def stem_word(word: Column, suffixes: list[str], known: Column, protected: list[str] = (), least: int = 3) -> Column:
    """Cuts the longest suffix that leaves a known word (`known`: an array) of `least` characters; protected words and negations stay."""
    out = F.lit(None).cast("string")
    for end in sorted(suffixes, key=len):  # the longest is tried first: it wraps the others
        cut = F.substring(word, F.lit(1), F.length(word) - len(end))
        out = F.when(F.endswith(word, F.lit(end)) & (F.length(word) - len(end) >= least) & F.array_contains(known, cut), cut).otherwise(out)
    keep = word.isin(list(protected)) if protected else F.lit(False)
    for end in NEGATIONS:
        keep = keep | F.endswith(word, F.lit(end))
    return F.when(keep | ~is_bengali_word(word), word).otherwise(F.coalesce(out, word))


def stem(tokens: Column, suffixes: list[str], known: Column, protected: list[str] = (), least: int = 3) -> Column:
    return F.transform(tokens, lambda t: stem_word(t, suffixes, known, protected, least))


def preprocess(c: Column, variant: str = "V1", stop: list[str] = (), protected: list[str] = (), suffixes: list[str] = (), known: Column | None = None, normalize: bool = True) -> Column:
    """The tokens of a variant: V0 white space; V1 clean and tokenise; V2 less stop words; V3 stemmed; V4 both; V2-demo unprotected."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; one of {VARIANTS}")
    if variant == "V0":
        return whitespace_tokens(c)
    t = tokenize(clean(c, normalize))
    if variant in ("V2", "V4"):
        t = remove_stopwords(t, stop, protected)
    if variant == "V2-demo":
        t = remove_stopwords(t, stop)
    if variant in ("V3", "V4"):
        t = stem(t, suffixes, known if known is not None else F.array().cast("array<string>"), protected)
    return t


def is_word_token(t: Column) -> Column:
    return t.rlike(r"[\p{L}\p{N}]")


def is_bengali_word(t: Column) -> Column:
    return t.rlike("^[\\u0980-\\u09FF]")


def has_context(c: Column) -> Column:
    """Neither null nor one of the words for nothing."""
    return c.isNotNull() & ~F.lower(F.trim(c)).isin(*NULL_WORDS)


def script_ratio(c: Column, script: str = r"[ঀ-৿]") -> Column:
    """Share of the letters that are of a script; 0 without letters."""
    letters = F.regexp_count(c, F.lit(r"\p{L}|\p{M}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(script)) / letters).otherwise(F.lit(0.0))


def code_mixing(c: Column) -> Column:
    """100 * (1 - largest script's share of the script words), two decimals; null without such words."""
    t = whitespace_tokens(c)
    count = lambda p: F.size(F.filter(t, lambda x: x.rlike(p)))
    n = [count("[\\u0980-\\u09FF]"), count("^[^\\u0980-\\u09FF]*[A-Za-z]")]
    total = n[0] + n[1]
    return F.when(total > 0, F.round(100 * (1 - F.greatest(*n) / total), 2))


def metadata_features(c: Column) -> dict[str, Column]:
    """Eleven surface features of a text."""
    n, words = F.length(c), whitespace_tokens(c)
    # what a text loses without some characters: a pass without a pattern
    count = lambda some: (n - F.length(F.translate(c, some, ""))).cast("long")
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    chars = F.aggregate(F.transform(words, F.length), F.lit(0), lambda a, x: a + x)
    return {
        "n_chars": n.cast("long"),
        "n_words": F.size(words).cast("long"),
        "n_digits": count(ASCII_DIGITS + BENGALI_DIGITS),
        "n_upper": count(upper),
        "n_latin": count(upper + lower),
        "n_commas": count(","),
        "n_stops": count(".।"),
        "n_questions": count("?"),
        "n_brackets": count("()[]"),
        "n_lines": (count("\n") + 1).cast("long"),
        "mean_word": F.when(F.size(words) > 0, chars / F.size(words)).otherwise(F.lit(0.0)),
    }


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x))


def clean_markup(c: Column) -> Column:
    """Entities, tags, markdown marks and citations removed."""
    c = F.regexp_replace(_unescape(F.coalesce(c, F.lit(""))), r"<[^>]+>", " ")
    return collapse_whitespace(remove_citations(F.regexp_replace(c, r"[*_`#]+", "")))


@F.pandas_udf(T.StringType())
def _lookup(s: pd.Series) -> pd.Series:
    digits = str.maketrans(BENGALI_DIGITS, ASCII_DIGITS)

    def one(x: str | None) -> str:
        x = unicodedata.normalize("NFKC", x or "").translate(digits).casefold()
        return " ".join("".join(" " if unicodedata.category(ch)[0] in "PZC" else ch for ch in x).split())

    return s.map(one)


def lookup_key(c: Column) -> Column:
    """NFKC, one kind of digits, case folded; punctuation, separators and controls as one space."""
    return _lookup(c)


def canonical_text(c: Column) -> Column:
    return F.replace(lookup_key(c), F.lit(" "), F.lit(""))


def option_key(c: Column) -> Column:
    """A key that keeps signs, operators and decimal points but no spaces, case or outer marks."""
    t = F.lower(unify_digits(F.coalesce(c, F.lit(""))))
    t = F.regexp_replace(F.translate(t, "−–×÷", "--*/"), SPACE, "")
    return F.regexp_replace(F.btrim(t, F.lit("।,;:!?'\"")), r"(?<!\d)[.](?!\d)|,(?=\d{2,3}\b)", "")


def trim_answer(c: Column) -> Column:
    """Without trailing full stops and spaces."""
    return F.rtrim(F.trim(c), F.lit("।. "))


def extract_numbers(c: Column) -> Column:
    """Signed numbers, decimals and fractions in order; whole ones without leading zeros or commas."""
    found = F.regexp_extract_all(unify_digits(F.coalesce(c, F.lit(""))), F.lit(r"[-+]?\d+(?:,\d{2,3})*(?:\.\d+)?(?:/\d+)?"), F.lit(0))
    plain = F.transform(found, lambda x: F.regexp_replace(F.ltrim(x, F.lit("+")), ",", ""))
    return F.transform(plain, lambda x: F.when(x.rlike(r"^-?\d+$"), F.regexp_replace(x, r"^(-?)0+(?=\d)", "$1")).otherwise(x))


def distinct_numbers(c: Column) -> Column:
    return F.array_distinct(extract_numbers(c))


def has_digit(c: Column) -> Column:
    return unify_digits(c).rlike(r"\d")


def strip_options(c: Column) -> Column:
    """A question without inline options like (ক) ... (খ) ... or a) ... b) ..."""
    at = F.regexp_instr(c, F.lit(r"(?s)\s*[(]?(?:ক|a|A)[).]\s.*?[(]?(?:খ|b|B)[).]\s"))
    return F.when(at > 0, F.rtrim(F.substring(c, F.lit(1), at - 1))).otherwise(c)


def quoted(c: Column) -> Column:
    """The first quoted piece; null without one."""
    return F.nullif(F.regexp_extract(c, "[‘'\"“]([^’'\"”]+)[’'\"”]", 1), F.lit(""))


def spelling_word(c: Column) -> Column:
    """A single word without outer marks; null if it isn't one."""
    w = F.btrim(F.trim(c), F.lit("।,.;:!?'\"‘’“”()"))
    return F.when((w != "") & ~w.rlike(SPACE), w)


def spreadsheet_safe(c: Column) -> Column:
    """White space collapsed, and a quote before what a spreadsheet would run."""
    t = collapse_whitespace(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), t)).otherwise(t)


def normalized_cell(c: Column) -> Column:
    """The reverse view for comparing cells: no leading quote, one kind of digits, no trailing stops."""
    return F.rtrim(F.ltrim(collapse_whitespace(unify_digits(F.coalesce(c, F.lit("")))), F.lit("'")), F.lit("।. "))


def compact(c: Column, limit: int, marker: str = " … ") -> Column:
    """At most `limit` characters: two thirds from the head, the rest from the tail."""
    head = limit * 2 // 3
    tail = max(0, limit - head - len(marker))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(marker), F.right(c, F.lit(tail))))


def cut_to_tokens(c: Column, limit: int) -> Column:
    """The first tokens of a text with their spacing; one pass of a pattern that never goes back."""
    return F.trim(F.regexp_extract(c, rf"^\s*+(?:(?>{TOKEN})\s*+){{0,{limit}}}+", 0))


def char_ngrams(word: Column, low: int, high: int) -> Column:
    """Character n-grams of a word padded with a space on both sides."""
    w = F.concat(F.lit(" "), word, F.lit(" "))

    def grams(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1)))
        return F.when(F.length(w) >= n, F.transform(at, lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(grams(n) for n in range(low, high + 1)))


def word_ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by spaces, from n shifted copies of the array: linear in its length even if `tokens` is an expression."""
    m = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    out = F.slice(tokens, F.lit(1), m)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(k + 1), m), lambda a, b: F.concat_ws(" ", a, b))
    return out


def shuffled_tokens(tokens: Column, key: Column, seed: int = 0) -> Column:
    """The tokens in an order that key and seed fix."""
    pairs = F.transform(tokens, lambda t, i: F.struct(F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"), F.lit(str(seed)))).alias("k"), t.alias("t")))
    return F.transform(F.array_sort(pairs), lambda p: p["t"])


def content_hash(*cols: Column, length: int = 20) -> Column:
    return F.substring(F.sha2(F.concat_ws("␟", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256), 1, length)


def lab_clean(c: Column) -> Column:
    """Tags out, letters only, lowered."""
    return collapse_whitespace(F.regexp_replace(F.regexp_replace(F.lower(c), r"<[^>]+>", " "), "[^a-z]", " "))
