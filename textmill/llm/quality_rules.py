"""Quality rules by distribution divergence.

Each document gets two histograms: of the character classes of its text and of the common words among its words. The
reference of a language is the mean histogram of its documents that pass the base rules, taken over all documents. A document
is rejected if its Jensen-Shannon distances to its language's reference are over limits: either distance alone over a high one,
or both over lower ones.

The minimum-length guard is the distance that a document of its number of counts would have if it were drawn from the reference
itself: it is taken off before a distance is compared, so a short text needs a larger one, and one of a few counts can't be
rejected by its histogram at all. A bin seldom met adds less to that noise than a common one, 1 / (8 n ln 2) at most.

Defined cases: a null or empty text has no words and fails the base rule on length; a null language is a language of its own
("und"); a language without any document that passes the base rules judges nothing; repeated rows are judged one by one;
other columns pass by untouched and may have any name, as results are keyed by the row's own doc_id only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm._bytes import _BYTE_LOWER, Texts, U, chunks, mix, spans_hash
from textmill.llm._shared import ready, written

#: Function words of the languages that have a list (fixed values); the bins of the common-word histogram.
COMMON_WORDS = {
    "en": "the of and a to in is was he for it with as his on be at by had that this are or an from not but they she which you we their has have were",
    "fr": "le la les de des du un une et en est que qui dans par pour au sur avec ne pas ce il elle sont aux ou plus se son sa ses tre",
    "de": "der die das und ist von den mit dem des ein eine zu auf sich nicht als auch es an er so wie bei aus nach im am um werden wird sie",
    "es": "el la los las de del y en que es un una por con para se su al lo como no más sus o este ha son ja le sin",
}
BINS = sorted({w for ws in COMMON_WORDS.values() for w in ws.split()})
#: Classes of bytes: lower-case, upper-case, digit, full stop/comma and the like, quotes and brackets, symbols, space, tab or control, line feed, start of a longer character, the rest.
CLASSES = ("lower", "upper", "digit", "stop", "mark", "symbol", "space", "control", "line", "wide", "other")
_CLASS = np.full(256, 10, np.uint8)
for _i, _chars in ((2, b"0123456789"), (3, b".,;:!?"), (4, b"'\"()-/"), (5, b"#*$%&|<>[]{}=+_@\\^`~"), (6, b" "), (7, bytes(range(0x20))), (8, b"\n")):
    _CLASS[list(_chars)] = _i
_CLASS[97:123], _CLASS[65:91], _CLASS[0xC0:] = 0, 1, 9
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STRIP = b".,;:!?\"'()"

FEATURES = "doc_id long, copy long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"


def _repeats(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries share (text, hash) with another one."""
    key = mix(h ^ mix(text.astype(U) + U(0x51ED)))
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow string column."""
    t = Texts(column)
    starts, ends = t.words
    tops = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(tops[ends] - tops[starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[t.data])])
    out = {"n_words": t.n_words, "word_chars": chars[t.word_off[1:]] - chars[t.word_off[:-1]], "n_symbols": symbols[t.off[1:]] - symbols[t.off[:-1]]}

    text, a, b = t.lines
    solid = np.concatenate([[0], np.cumsum(~t.space)])
    real = solid[b] > solid[a]
    text, h = text[real], spans_hash(t.data, a[real], b[real])
    same = _repeats(text, h)
    dup = np.zeros(t.n, np.int64)
    if same.any():
        pairs = np.stack([text[same].astype(U), h[same]], 1)
        dup = np.bincount(text[same], minlength=t.n) - np.bincount(np.unique(pairs, axis=0)[:, 0].astype(np.int64), minlength=t.n)
    out["n_dup_lines"] = dup

    text, run = t.windows(t.hashes, 5)
    covered = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(t.owner(5) >= 0)[_repeats(text, run)] if len(run) else np.zeros(0, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + 5, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    out["n_repeat_words"] = hit[t.word_off[1:]] - hit[t.word_off[:-1]]

    cell = np.repeat(np.arange(t.n), np.diff(t.off)) * len(CLASSES) + _CLASS[t.data]
    lead = (t.data & 0xC0) != 0x80
    out["classes"] = np.bincount(cell[lead], minlength=t.n * len(CLASSES)).reshape(t.n, len(CLASSES))

    # words without the marks around them, lowered, against the hashes of the common ones
    first, last = starts.copy(), ends.copy()
    mark = np.zeros(256, bool)
    mark[list(_STRIP)] = True
    if len(starts):
        first += mark[t.data[first]] & (last - first > 1)
        last -= mark[t.data[last - 1]] & (last - first > 1)
    h = spans_hash(t.data, first, last, _BYTE_LOWER)
    order = np.argsort(_bin_hashes())
    known = _bin_hashes()[order]
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    which = np.where(known[at] == h, order[at], len(BINS))
    owner = np.repeat(np.arange(t.n), t.n_words)
    out["common"] = np.bincount(owner * (len(BINS) + 1) + which, minlength=t.n * (len(BINS) + 1)).reshape(t.n, len(BINS) + 1)
    return out


def _bin_hashes() -> np.ndarray:
    if not hasattr(_bin_hashes, "got"):
        t = Texts([w for w in BINS])
        _bin_hashes.got = t.lower
    return _bin_hashes.got


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        m = measure(batch.column(batch.schema.get_field_index("text")))
        lists = {k: pa.ListArray.from_arrays(np.arange(0, m[k].size + 1, m[k].shape[1], dtype=np.int32), pa.array(m[k].ravel(), pa.int64())) for k in ("classes", "common")}
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *(pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), lists["classes"], lists["common"]],
            names=["doc_id", "copy", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"],
        )


def features(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts and both histograms; one pass over the whole texts."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_measured, FEATURES)


def _sum(counts: str) -> F.Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def references(measured: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): the mean histogram of the documents that pass the base rules; one row per language."""
    mean = lambda c, n: F.array(*(F.avg(F.col(c)[i] / F.col(f"{c}_sum")) for i in range(n))).alias(f"ref_{c}")
    return measured.where(~F.col("base_failed")).groupBy("lang").agg(mean("classes", len(CLASSES)), mean("common", len(BINS) + 1))


def js_distance(counts: str, ref: str) -> F.Column:
    """The Jensen-Shannon distance (base 2, 0 to 1) of a histogram to a reference; null without a reference or counts."""
    total = F.col(f"{counts}_sum")
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    term = F.zip_with(F.transform(counts, lambda x: x / total), ref, lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.when((total > 0) & F.col(ref).isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(term, F.lit(0.0), lambda a, x: a + x))))


def noise(counts: str, ref: str) -> F.Column:
    """The distance to a reference that sampling alone gives a histogram of as many counts; null without a reference or counts."""
    total = F.col(f"{counts}_sum").cast("double")
    bins = F.aggregate(ref, F.lit(0.0), lambda a, q: a + F.least(F.lit(1.0), 8 * math.log(2) * total * q))
    return F.when((total > 0) & F.col(ref).isNotNull(), F.sqrt(bins / (8 * math.log(2) * total)))


def verdicts(docs: DataFrame, alone: tuple[float, float] = (0.3, 0.2), both: tuple[float, float] = (0.08, 0.15)) -> DataFrame:
    """doc_id, copy (a hash of the text), the base counts, base_failed, kept, class_distance and common_distance of every document.

    Rejected are a class distance of over alone[0] more than twice its noise, a common-word distance of over alone[1] more than its
    noise, and a class distance of over both[0] more than its noise together with a common-word distance of over both[1] more than 0.7 of
    its noise. The features are written once to the shared
    folder, so the texts are read once; the references (a row per language) are joined back.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = written(features(docs).withColumns({"base_failed": base, "classes_sum": _sum("classes"), "common_sum": _sum("common")}))
    far = measured.join(references(measured), "lang", "left").withColumns({"class_distance": js_distance("classes", "ref_classes"), "common_distance": js_distance("common", "ref_common")})
    far = far.withColumns({"class_noise": noise("classes", "ref_classes"), "common_noise": noise("common", "ref_common")})
    over = lambda c, least, times=1.0: F.coalesce(F.col(f"{c}_distance") - times * F.col(f"{c}_noise") > least, F.lit(False))
    odd = over("class", alone[0], 2.0) | over("common", alone[1]) | over("class", both[0]) & over("common", both[1], 0.7)
    return far.select("doc_id", "copy", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "class_distance", "common_distance")


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """verdicts() without the hash of the text."""
    return verdicts(docs, **limits).drop("copy")


def kept_documents(docs: DataFrame, **limits) -> DataFrame:
    """docs without the documents that the rules reject."""
    bad = verdicts(docs, **limits).where("not kept").select(F.col("doc_id").alias("bad_doc"), F.col("copy").alias("bad_copy")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_doc"]) & (F.xxhash64(docs["text"]) == bad["bad_copy"]), "left_anti")
