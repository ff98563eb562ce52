"""License scans with MinHash bands over overlapping windows, on DataFrame functions only.

A window has as many words as a template and begins every eighth of that. Its 5-word shingles get HASHES MinHashes in BANDS bands
of ROWS; a window and a template of its size with one equal band are a candidate. A copy with 0.75 of a template's shingles
has a Jaccard similarity of 0.6 to it, and its nearest window 0.5 at least; there a band agrees with probability
1 - (1 - 0.5 ** 2) ** 24 = 0.999, for a verbatim copy always. The candidate's window, widened by a stride to both sides, must
then hold 0.75 of the template's shingles, counted exactly.

Windows without any keyword are skipped: the keywords are taken from the templates so that of each more shingles have one than
a match may miss, so nothing that could be verified is lost. Templates are a fixed list, so their bands are a small literal table; documents are
never shuffled.

Defined cases: null and empty texts, and texts of fewer than five words, hold no license; a document shorter than a template is one
window; repeated rows of a document give one result; other columns aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.license_texts import TEXTS

#: License notices and whole texts (fixed values): id and text.
TEMPLATES = {
    "agpl-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-line": "Released under the MIT License.",
    "mit-notice": 'Licensed under the MIT License. See LICENSE file in the project root for full license information.',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    **TEXTS,
}
SHINGLE, ROWS, BANDS = 5, 2, 24
HASHES = ROWS * BANDS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> list[str]:
    """words_of() in Python."""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans(UPPER, LOWER)))


def keywords_of(templates: dict[str, str], threshold: float) -> tuple[str, ...]:
    """Parts of words such that of each template over 1 - threshold of the shingles have one; () if letters can't give that.

    Long parts are preferred, as other texts have them less often; of these those that the most shingles still need.
    """
    sets = []
    for text in templates.values():
        w = _words(text)
        if len(w) >= SHINGLE:
            sets.append({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})
    out: list[str] = []
    open_ = [(s, threshold * len(s)) for s in sets]  # the shingles without a keyword, and what they must fall below
    for least in (6, 3, 1):
        while True:
            short = [s for s, most in open_ if len(s) >= most]
            count: dict[str, int] = {}
            for s in short:
                for shingle in s:
                    for part in {x for w in shingle for x in re.findall("[a-z]+", w) if len(x) >= least}:
                        count[part] = count.get(part, 0) + 1
            if not count:
                break
            best = min(count, key=lambda x: (-count[x], x))
            out.append(best)
            open_ = [({x for x in s if not any(best in w for w in x)}, most) for s, most in open_]
    return () if any(len(s) >= most for s, most in open_) else tuple(out)


KEYWORDS = keywords_of(TEMPLATES, 0.75)


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lowered."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def shingles_of(words: Column) -> Column:
    """The distinct 5-word shingles of an array of words; none for fewer words."""
    last = F.size(words) - SHINGLE
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))).otherwise(F.array().cast("array<string>"))


def hashes_of(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def lows_of(hashed: Column) -> Column:
    """The MinHashes: for each seed the least hash."""
    return F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda k: F.array_min(F.transform(hashed, lambda x: F.xxhash64(x, k))))


def bands_of(low: Column) -> Column:
    """A hash of each band of MinHashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *(F.get(low, b * ROWS + r) for r in range(ROWS))))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: the optimizer doesn't copy it into the lambdas that use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def has_keyword(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a text has any of the keywords; without keywords every text counts."""
    if not keywords:
        return text.isNotNull()
    text = F.lower(text)
    out = F.contains(text, F.lit(keywords[0]))
    for k in keywords[1:]:
        out = out | F.contains(text, F.lit(k))
    return out


def _windows(size: int) -> Column:
    """The windows of a size that hold a word with a keyword (their places are in `at`), each with its widened form."""
    stride = max(1, size // 8)
    last = F.greatest(F.size("words") - size, F.lit(0))
    # the starts on the grid, and the last one, from which a window reaches each place
    reach = lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - size + 1) / stride)).cast("int"), F.floor(p / stride).cast("int"))
    starts = F.array_distinct(F.transform(F.flatten(F.transform("at", reach)), lambda k: F.least(k * stride, last)))
    wide = lambda s: F.slice("words", F.greatest(s - stride, F.lit(0)) + 1, F.lit(size + stride) + F.least(s, F.lit(stride)))
    return F.transform(starts, lambda s: F.struct(F.lit(size).alias("size"), F.slice("words", s + 1, size).alias("own"), wide(s).alias("wide")))


def scan_licenses(docs: DataFrame, threshold: float = 0.75, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license_id, containment): the best match of each template that a document holds, over its whole text."""
    spark = docs.sparkSession
    templates = templates or TEMPLATES
    keywords = keywords_of(templates, threshold)
    known = spark.createDataFrame(list(templates.items()), "license_id string, text string")
    known = known.select("license_id", words_of(F.col("text")).alias("w")).select("license_id", F.size("w").alias("size"), shingles_of(F.col("w")).alias("template"))
    known = known.select("*", F.posexplode(bands_of(lows_of(hashes_of(F.col("template"))))).alias("band", "value"))
    sizes = sorted({len(_words(t)) for t in templates.values()})
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where(has_keyword(F.col("text"), keywords))
    cut = _once(some, "words", words_of(F.col("text"))).select("doc_id", "words").where(F.size("words") >= SHINGLE)
    at = _once(cut, "at", F.filter(F.transform("words", lambda w, i: F.when(has_keyword(w, keywords), i)), lambda i: i.isNotNull())).where(F.size("at") > 0)
    windows = at.select("doc_id", F.inline(F.flatten(F.array(*(_windows(n) for n in sizes)))))
    hashed = _once(windows, "hashed", hashes_of(shingles_of(F.col("own"))))
    banded = _once(hashed, "low", lows_of(F.col("hashed"))).select("doc_id", "size", "wide", F.posexplode(bands_of(F.col("low"))).alias("band", "value"))
    found = banded.join(F.broadcast(known), ["size", "band", "value"])
    share = F.size(F.array_intersect(shingles_of(F.col("wide")), "template")) / F.size("template")
    return found.select("doc_id", "license_id", share.alias("containment")).where(F.col("containment") >= threshold).groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"))
