"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and read by the workers from memory-mapped sorted hash arrays.

Training: tasks count the n-grams of their texts before anything is shuffled and deal them by a hash of their context, the words
before the last. So a bucket holds whole contexts: it writes the sorted keys and counts of its n-grams, and the totals of its contexts, to
a file in the shared folder. It sends on the suffixes of its n-grams, one word shorter, each with its number of distinct first words there;
as an n-gram is in one bucket only, their sums are the continuation counts of the next lower order, dealt by their own
contexts. Counts of an n-gram that starts with the begin mark are plain counts, as nothing precedes it. An order is done in PASSES passes over ranges of its buckets, whose shuffle
files go when their pass ends: that bounds the disk, and costs as many readings of the texts, or of the order above.

What is shuffled is packed: a block has a dictionary of its words, columns of numbers in it, sorted, and counts. Context totals are kept as
numbers of the distinct ones, since most contexts have one continuation.

Scoring: each worker maps the files (on a store without local paths it copies those it needs), and looks up a batch's distinct n-grams in
sorted order. What is gathered grows with the corpus, but no worker, nor the driver, loads it.

p(w | h) = max(a(hw) - D, 0) / A(h) + g(h) p(w | h'), with three discounts D per order from the counts of counts; below the
unigrams stands 1 / (V + 1) for each of the V training tokens and for any unknown one. An unseen context passes down.

Defined cases: null and empty texts are one end token; a very long text is counted and scored like any other; a null doc_id trains; repeated
rows count as often as they stand; without training text every probability is 1; discounts that the counts of counts can't give are 0.5,
1 and 1.5; other columns aren't read. Keys are hashes: 64 bits of
words, and of longer n-grams the upper 56. In a bucket of ten million n-grams two share a key with probability 0.001, and one that isn't
there is taken for another with 2e-10.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm._bytes import Texts, U, chunks, mix
from textmill.llm._shared import dropped, partitions, ready, shared_dir, union, written

ORDER = 3
BEGIN, END = U(0x0B0B0B0B0B0B0B0B), U(0x0E0E0E0E0E0E0E0E)
FLUSH = 2_000_000
#: Buckets per shuffle partition, unless these have under LEAST or over MOST bytes of the table: a bucket is what a worker holds at once.
SPLIT, LEAST, MOST = 4, 1 << 20, 1 << 26
#: Passes over the n-grams of the highest order, each over as many buckets, reading the texts; lower orders take twice as many. Only the
#: shuffle of one pass stands on disk.
PASSES = 4
STAGE = "kind int, bucket int, packed binary"
NEXT, STATS = 0, 1
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def ngram_key(words: list[np.ndarray]) -> np.ndarray:
    """A hash of word sequences given as columns."""
    h = mix(words[0] + U(len(words)))
    for w in words[1:]:
        h = mix(h * U(0x9E3779B97F4A7C15) + w)
    return h


def _planes(x: np.ndarray) -> bytes:
    """Small numbers as bytes, the lowest of all first: the upper ones are mostly 0 and pack to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def pack(kinds: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Rows of word numbers (kinds: their words), sorted as by grouped(), and their counts, compactly."""
    used, codes = np.unique(np.concatenate(columns), return_inverse=True)
    codes = codes.reshape(len(columns), -1)
    lead = codes[-2] if len(columns) > 1 else codes[0]  # ascending
    gaps = np.diff(kinds[used], prepend=U(0)).view(np.uint8).reshape(-1, 8).T  # as _planes, in 8 bytes
    parts = [gaps.tobytes(), _planes(np.diff(lead, prepend=0)), *(_planes(c) for k, c in enumerate(codes) if k != max(0, len(columns) - 2)), *(_planes(c) for c in counts)]
    head = np.array([len(used), len(lead)], np.int64).tobytes()
    raw = head + b"".join(parts)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpack(packed: bytes, n: int, counts: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    raw = np.frombuffer(pa.decompress(packed[8:], int(np.frombuffer(packed, np.int64, 1)[0]), "zstd"), np.uint8)
    used, rows = (int(x) for x in raw[:16].view(np.int64))
    kinds = np.cumsum(np.ascontiguousarray(raw[16 : 16 + 8 * used].reshape(8, used).T).view(U).ravel(), dtype=U)
    rest = np.ascontiguousarray(raw[16 + 8 * used :].reshape(n + counts, 4, rows).transpose(0, 2, 1)).view("<u4")[..., 0]
    lead = np.cumsum(rest[0], dtype=np.uint32)
    at = max(0, n - 2)
    columns = [*rest[1:n]]
    columns.insert(at, lead)
    return kinds, columns, [*rest[n:]]


def merged(parts: list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The unpacked blocks as one, over one dictionary."""
    kinds = np.unique(np.concatenate([p[0] for p in parts]))
    to = [np.searchsorted(kinds, p[0]).astype(np.uint32) for p in parts]
    columns = [np.concatenate([t[p[1][k]] for t, p in zip(to, parts, strict=True)]) for k in range(len(parts[0][1]))]
    return kinds, columns, [np.concatenate([p[2][k] for p in parts]) for k in range(len(parts[0][2]))]


def grouped(columns: list[np.ndarray], size: int, counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of word numbers under size with their summed counts (without any: how often each stands).

    Sorted by the context from its last word back, then by the last word.
    """
    turned = [*columns[-2::-1], columns[-1]] if len(columns) > 1 else columns
    bits = max(1, int(size - 1).bit_length())
    if bits * len(columns) <= 63:
        key = turned[0].astype(np.int64)
        for c in turned[1:]:
            key = key << bits | c
        order = np.argsort(key, kind="stable") if counts else None
        key = key[order] if counts else np.sort(key)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        rows = [key[first] >> (bits * (len(columns) - 1 - k)) & ((1 << bits) - 1) for k in range(len(columns))]
    else:
        order = np.lexsort(turned[::-1])
        turned = [c[order] for c in turned]
        new = np.arange(len(order)) == 0
        for c in turned:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        rows = [c[first] for c in turned]
    rows = [*rows[-2::-1], rows[-1]] if len(rows) > 1 else rows
    if not counts:
        return rows, [np.diff(np.append(first, len(columns[0])))]
    return rows, [np.add.reduceat(c[order], first, dtype=np.int64) for c in counts]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as ranges of the lower half of the hash."""
    return ((h & U(0xFFFFFFFF)) * U(buckets) >> U(32)).astype(np.int64)


def context_of(words: list[np.ndarray]) -> np.ndarray:
    """What an n-gram is dealt by: its context, or the word itself if it has none."""
    return ngram_key(words[:-1] or words)


def _dealt(kinds: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    to = bucket_of(context_of([kinds[c] for c in columns]), buckets)
    order = np.argsort(to, kind="stable")
    at = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(at)).tolist():
        some = order[at[b] : at[b + 1]]
        yield NEXT, b, pack(kinds, [c[some] for c in columns], [c[some] for c in counts])


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, words): the lowered words of each text, then END."""
    off = t.word_off + np.arange(t.n + 1)
    out = np.empty(off[-1], U)
    end = off[1:] - 1
    inner = np.ones(len(out), bool)
    inner[end] = False
    out[end] = END
    out[inner] = t.lower
    return off, out


def ngrams(off: np.ndarray, words: np.ndarray, n: int, begin=BEGIN) -> list[np.ndarray]:
    """For each token the n - 1 words before it (begin before the text) and itself, as columns."""
    place = np.arange(len(words)) - np.repeat(off[:-1], np.diff(off))
    columns = []
    for back in range(n - 1, 0, -1):
        w = np.full(len(words), begin, words.dtype)
        ok = place >= back
        w[ok] = words[np.flatnonzero(ok) - back]
        columns.append(w)
    return [*columns, words]


def _counted(n: int, buckets: int, low: int, high: int):
    """Counts the n-grams of the buckets from low to high - 1."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            kinds, codes = np.unique(np.concatenate([np.concatenate(c) for c in zip(*held, strict=True)]), return_inverse=True)
            columns, (count,) = grouped(list(codes.reshape(n, -1)), len(kinds), [])
            rows = list(_dealt(kinds, columns, [count, count], buckets))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "bucket", "packed"])

        for batch in chunks(batches, "text"):
            columns = ngrams(*tokens(Texts(batch.column(0))), n)
            to = bucket_of(context_of(columns), buckets)
            some = np.flatnonzero((to >= low) & (to < high))
            held.append([c[some] for c in columns])
            size += len(some)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return counted


#: What pyarrow calls the schemes that Spark writes with.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def _open(uri: str):
    """(file system, path) of a URI."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def _save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes the arrays as one Arrow file; a task that runs again replaces it as a whole."""
    fs, path = _open(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    table = pa.table({k: pa.LargeListArray.from_arrays([0, len(v)], pa.array(v)) for k, v in arrays.items()})
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table)
    fs.move(part, path)


_maps: dict[str, dict[str, np.ndarray] | None] = {}


def _load(uri: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, memory-mapped; None if there is none."""
    if uri not in _maps:
        fs, path = _open(uri)
        if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
            _maps[uri] = None
        elif fs.type_name == "local":
            _maps[uri] = _mapped(path)
        else:  # the copy has no name once it is mapped, so nothing is left of it
            fd, local = tempfile.mkstemp(prefix="ngram-")
            os.close(fd)
            pa.fs.copy_files(path, local, source_filesystem=fs, destination_filesystem=pa.fs.LocalFileSystem())
            _maps[uri] = _mapped(local)
            os.unlink(local)
    return _maps[uri]


def _mapped(path: str) -> dict[str, np.ndarray]:
    table = pa.ipc.open_file(pa.memory_map(path)).read_all()
    return {k: table.column(k).chunk(0).values.to_numpy() for k in table.column_names}


def _narrow(x: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Numbers in a byte each; those that need more stand apart, by place."""
    big = np.flatnonzero(x >= 255)
    return {name: np.minimum(x, 255).astype(np.uint8), name + "_at": big.astype(np.uint32), name + "_big": x[big].astype(np.int64)}


def _wide(table: dict[str, np.ndarray], name: str, k: np.ndarray) -> np.ndarray:
    """The numbers at places k."""
    out = table[name][k].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = table[name + "_big"][np.searchsorted(table[name + "_at"], k[big])]
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, ascending; a place of each; for each key its number among them)."""
    order = np.argsort(keys)
    ascending = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(new) - 1
    return ascending[new], order[new], where


def _split(key: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """The upper 56 bits of sorted hashes, as three arrays."""
    return {name: (key >> U(32)).astype(np.uint32), name + "_mid": (key >> U(16)).astype(np.uint16), name + "_low": (key >> U(8)).astype(np.uint8)}


def _find(table: dict[str, np.ndarray], column: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of ascending keys in a sorted column, whole or split."""
    own, last = table[column], len(table[column]) - 1
    if own.dtype == U:
        k = np.minimum(np.searchsorted(own, keys), last)
        return k, own[k] == keys
    want, rest = (keys >> U(32)).astype(np.uint32), (keys >> U(8)).astype(np.uint32) & 0xFFFFFF
    mid, low = table[column + "_mid"], table[column + "_low"]
    k = np.minimum(np.searchsorted(own, want), last)
    while True:  # few share the upper half
        same = own[k] == want
        here = mid[k].astype(np.uint32) << 8 | low[k]
        on = same & (here < rest) & (k < last)
        if not on.any():
            return k, same & (here == rest)
        k = k + on


def _tier(n: int, below_buckets: int, uri: str):
    """A bucket of n-grams (adjusted count, plain count): writes its file; what goes on to the lower order, and the statistics."""

    def tier(rows: pd.DataFrame) -> pd.DataFrame:
        b = int(rows["bucket"].iloc[0])
        kinds, columns, counts = merged([unpack(x, n, 2) for x in rows["packed"]])
        columns, (adjusted, plain) = grouped(columns, len(kinds), counts)
        del counts
        words = [kinds[c] for c in columns]
        out = []
        key = words[0] if n == 1 else ngram_key(words)
        order = np.argsort(key)
        arrays = {"key": key[order]} if n == 1 else _split(key[order], "key")
        arrays |= _narrow(adjusted[order], "adjusted")
        if n == 1:
            arrays |= _narrow(plain[order], "plain")
        else:
            new = np.arange(len(key)) == 0
            for c in columns[:-1]:
                new[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(new)
            sums = np.stack([np.add.reduceat(x, first) for x in (adjusted, (adjusted == 1).astype(np.int64), (adjusted == 2).astype(np.int64), (adjusted > 2).astype(np.int64))])
            _, which, kind, often = np.unique(ngram_key([x.astype(U) for x in sums]), return_index=True, return_inverse=True, return_counts=True)
            common = np.argsort(-often)  # the commonest get the numbers that take a byte
            which, kind = which[common], np.argsort(common)[kind]
            context = ngram_key([w[first] for w in words[:-1]])
            order = np.argsort(context)
            arrays |= _split(context[order], "context") | _narrow(kind[order], "sums") | {f"sum{k}": sums[k][which] for k in range(4)}
            tail, sums = grouped(columns[1:], len(kinds), [np.ones(len(key), np.int64), plain])
            more = np.where(kinds[tail[0]] == BEGIN, sums[1], sums[0])
            out += _dealt(kinds, tail, [more, sums[1]], below_buckets)
        _save(f"{uri}/{n}/{b}", arrays)
        stats = [int((adjusted == k).sum()) for k in (1, 2, 3, 4)] + [int((adjusted > 2).sum()), int(adjusted.sum()), int(plain.sum()), len(plain)]
        out.append((STATS, 0, np.array(stats, np.int64).tobytes()))
        return pd.DataFrame(out, columns=["kind", "bucket", "packed"])

    return tier


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [(1, n1, n2), (2, n2, n3), (3, n3, n4)]
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a and b else 0.5 * k for k, a, b in raw)  # type: ignore[return-value]


class Model:
    """Where a trained model lies and its global numbers."""

    def __init__(self, uri: str, order: int, buckets: dict[int, int], discounts: dict[int, tuple[float, float, float]], stats: list[int]):
        self.uri, self.order, self.buckets, self.discounts = uri, order, buckets, discounts
        one, two, _, _, more, self.continuations, self.n, self.v = stats
        self.rest = (discounts[1][0] * one + discounts[1][1] * two + discounts[1][2] * more) / max(1, self.continuations)

    def _discounted(self, n: int, a: np.ndarray) -> np.ndarray:
        d = self.discounts[n]
        return np.maximum(a - np.select([a > 2, a == 2, a == 1], [d[2], d[1], d[0]], 0.0), 0.0)

    def _lookup(self, n: int, context: np.ndarray, keys: np.ndarray, column: str, names: list[str]) -> list[np.ndarray]:
        """The values of keys, best ascending, 0 where there is none; context: what each is dealt by."""
        out = [np.zeros(len(keys), np.int64) for _ in names]
        to = bucket_of(context, self.buckets[n]).astype(np.min_scalar_type(self.buckets[n]))
        order = np.argsort(to, kind="stable")
        at = np.searchsorted(to[order], np.arange(self.buckets[n] + 1))
        for b in np.flatnonzero(np.diff(at)).tolist():
            table = _load(f"{self.uri}/{n}/{b}")
            if table is None:
                continue
            some = order[at[b] : at[b + 1]]
            k, hit = _find(table, column, keys[some])
            some, k = some[hit], k[hit]
            kind = _wide(table, "sums", k) if column == "context" else None
            for o, name in zip(out, names, strict=True):
                o[some] = _wide(table, name, k) if kind is None else table[name][kind]
        return out

    def score(self, off: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(plain count, base log10 probability, log10 probability) of each token."""
        own, _, where = distinct(words)
        back = where
        plain, adjusted = self._lookup(1, context_of([own]), own, "key", ["plain", "adjusted"])
        p = ((self._discounted(1, adjusted) / max(1, self.continuations)) + (self.rest if self.n else 1.0) / (self.v + 1))[back]
        base = np.log10((plain + 0.5) / (self.n + 0.5 * (self.v + 1)))[back]
        for n in range(2, self.order + 1):
            # the context of a token is the shorter n-gram that ends with the token before it
            own = np.append(own if n > 2 else ngram_key([own]), ngram_key([np.full(1, BEGIN)] * (n - 1)))
            at = np.roll(where, 1)
            at[off[:-1]] = len(own) - 1
            total, *kind = self._lookup(n, own, own, "context", ["sum0", "sum1", "sum2", "sum3"])
            weight = sum(d * x for d, x in zip(self.discounts[n], kind, strict=True)) / np.maximum(total, 1)
            context, total, weight = own[at], total[at], weight[at]
            own, some, where = distinct(ngram_key(ngrams(off, words, n)))
            (a,) = self._lookup(n, context[some], own, "key", ["adjusted"])
            p = np.where(total > 0, self._discounted(n, a)[where] / np.maximum(total, 1) + weight * p, p)
        return plain[back], base, np.log10(p)


def bucket_counts(texts: DataFrame, order: int) -> dict[int, int]:
    """Buckets of each order, from the size that Spark's catalog gives the table and the shuffle partitions; the lower orders have fewer,
    as each bucket sends a block to all of these."""
    spark = texts.sparkSession
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    some = SPLIT * partitions(spark)
    if size < 1 << 60:  # known
        some = max(1, min(some, size // LEAST), size // MOST)
    return {n: some if n == order else max(1, some // 6) for n in range(1, order + 1)}


def train(texts: DataFrame, order: int = ORDER, passes: int = PASSES) -> Model:
    """A model of the texts of a one-column DataFrame (text)."""
    spark = texts.sparkSession
    ready(spark)
    buckets = bucket_counts(texts, order)
    uri = f"{shared_dir(spark)}/ngram/{uuid.uuid4().hex}"
    texts = texts.select(F.col("text").cast("string").alias("text"))
    discounts, stats, old = {}, [0] * 8, []
    for n in range(order, 0, -1):
        parts = passes if n == order else 2 * passes  # no text is read again, so more passes cost little
        cuts = sorted({buckets[n] * k // parts for k in range(parts + 1)})
        done = []
        for low, high in pairwise(cuts):
            if n == order:
                stage = texts.mapInArrow(_counted(n, buckets[n], low, high), STAGE)
            else:
                stage = union(old).where((F.col("kind") == NEXT) & (F.col("bucket") >= low) & (F.col("bucket") < high))
            done.append(written(stage.groupBy("bucket").applyInPandas(_tier(n, buckets.get(n - 1, 1), uri), STAGE), release=True))
        dropped(spark, *old)
        rows = [np.frombuffer(r[0], np.int64) for r in union(done).where(F.col("kind") == STATS).select("packed").collect()]  # one row per bucket
        stats = np.sum(rows, axis=0).tolist() if rows else [0] * 8
        discounts[n] = discounts_of(*stats[:4])
        old = done
    dropped(spark, *old)
    return Model(uri, order, buckets, discounts, stats)


def _scored(model: Model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            off, words = tokens(Texts(batch.column(2)))
            plain, base, p = model.score(off, words)
            total = lambda x: pa.array(np.add.reduceat(x, off[:-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(off)), total((plain > 0).astype(np.int64)), total(base), total(p)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return scored


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score and perplexity of (doc_id, held_out, text)."""
    ready(docs.sparkSession)
    out = docs.select("doc_id", "held_out", "text").mapInArrow(_scored(model), SCORED)
    return out.withColumn("train_tokens", F.lit(model.n).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_held_out(docs: DataFrame, folds: int = 5, fold: int = 1, order: int = ORDER) -> DataFrame:
    """Scores all documents with a model of those whose crc32(doc_id as text) mod folds is not fold."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % folds == fold, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score_texts(split, train(split.where("not held_out").select("text"), order))
