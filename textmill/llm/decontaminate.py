"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item has a SimHash of BITS bits of its 5-word shingles, weighted by how often they occur. A document is read in
windows of the item's number of words, slid word by word; a window gets its SimHash from running sums of the shingles' bits.

The fingerprint is cut into blocks of BLOCK_BITS bits, and the items of a size are indexed by the value of each block. Two
fingerprints within RADIUS bits differ by NEAR bits at most in one block at least, as RADIUS < BLOCKS * (NEAR + 1); so the items whose block
value lies within NEAR bits of the window's, for any block, are all items in the radius. These are the candidates; those whose whole
fingerprint is within RADIUS are verified by the exact weighted-shingle (multiset) Jaccard similarity. Of random pairs a block lets 1.1 %
through, all blocks 16 %, and the radius none.

At the similarity limit of 0.75 the expected distance is 44 of 256 bits with a deviation of 6, so RADIUS 63 is three deviations away
and about one pair in a thousand exactly at the limit is missed, fewer above; a verbatim passage has distance 0.

Windows that share no shingle with any item of their size can't reach the limit and get no fingerprint. Fingerprints are made for SPAN
starts at a time, so memory depends on the longest item, not on the document.

The index of a block of the benchmark is broadcast. Its size is bounded: a benchmark of more than BLOCK_WORDS words is taken in
several blocks, one pass over the documents each. Documents are never shuffled.

Defined cases: null and empty texts match nothing; an item without words is left out; an item of fewer than five words is
one shingle, its whole sequence, and matches that sequence; a document shorter than an item is one window; items that are
equal all match; of equally similar windows the first is given; repeated rows match alike; doc_ids are 64-bit and may be null; an empty
benchmark gives an empty result; other columns aren't read, and pass through decontaminated() whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm._bytes import _SLOT, SHINGLE, Texts, U, chain, chunks, mix
from textmill.llm._shared import ready, union, words_count

BITS, BLOCK_BITS, NEAR = 256, 16, 3
BLOCKS = BITS // BLOCK_BITS
RADIUS = BLOCKS * (NEAR + 1) - 1
BLOCK_WORDS = 2_000_000
SPAN = 2048
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double, distance int"
_SEEN = 20


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each shingle."""
    raw = np.stack([mix(h ^ U(0xA5A5A5A5A5A5A5A5 * (k + 1) % 2**64)) for k in range(BITS // 64)], 1).view(np.uint8)
    return np.unpackbits(raw, axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def simhash(sums: np.ndarray) -> np.ndarray:
    """The fingerprints, as the values of their blocks, from the weighted sums of signs."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


class Blocks:
    """The block tables of the fingerprints of some items."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for k in range(BLOCKS):
            values, of = np.unique(prints[:, k], return_inverse=True)
            order = np.argsort(of, kind="stable")
            self.tables.append((values, order, np.searchsorted(of[order], np.arange(len(values) + 1))))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item): the pairs with a block within NEAR bits, each once."""
        pairs = []
        for k, (values, order, at) in enumerate(self.tables):
            own, where = np.unique(prints[:, k], return_inverse=True)
            a, b = np.nonzero(np.bitwise_count(own[:, None] ^ values[None, :]) <= NEAR)  # values, not pairs of windows and items
            if not len(a):
                continue
            by = np.argsort(where, kind="stable")
            lo = np.searchsorted(where[by], np.arange(len(own) + 1))
            n, m = lo[a + 1] - lo[a], at[b + 1] - at[b]
            each = np.repeat(np.arange(len(a)), n * m)
            inner = np.arange(len(each)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            pairs.append(by[lo[a][each] + inner // m[each]] * len(self.prints) + order[at[b][each] + inner % m[each]])
        pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return pair // max(1, len(self.prints)), pair % max(1, len(self.prints))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, distance): the pairs within RADIUS bits."""
        w, i = self.candidates(prints)
        far = np.bitwise_count(prints[w] ^ self.prints[i]).sum(1, dtype=np.int32)
        ok = far <= RADIUS
        return w[ok], i[ok], far[ok]


def jaccard(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


class Index:
    """The fingerprints of a block of items, by item size, with their block tables."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        t = Texts(texts)
        off, sh = t.shingles()
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.sizes: dict[int, dict] = {}
        owners: dict[int, set[int]] = defaultdict(set)
        groups = defaultdict(list)
        for i, n in enumerate(t.n_words.tolist()):
            if not n:
                continue
            own = sh[off[i] : off[i + 1]]
            if n < SHINGLE:
                self.short[n][int(own[0])].append(ids[i])
                continue
            groups[n].append((ids[i], own))
            for x in own.tolist():
                owners[x].add(n)
        for n, items in groups.items():
            prints = simhash(np.stack([signs(own).sum(0, dtype=np.int32) for _, own in items]))
            self.sizes[n] = {"ids": [i for i, _ in items], "blocks": Blocks(prints), "counts": [Counter(own.tolist()) for _, own in items]}
        self.known = np.array(sorted(owners), U)
        self.owners = [sorted(owners[int(x)]) for x in self.known]
        self.seen = np.zeros(1 << _SEEN, bool)
        self.seen[(self.known >> U(64 - _SEEN)).astype(np.int64)] = True
        self.short = {n: dict(x) for n, x in self.short.items()}

    def hits(self, run: np.ndarray) -> np.ndarray:
        """Positions in run that hold a shingle of an item."""
        at = np.flatnonzero(self.seen[(run >> U(64 - _SEEN)).astype(np.int64)]) if len(self.known) else np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.known, run[at]), max(0, len(self.known) - 1))
        return at[self.known[k] == run[at]] if len(at) else at

    def search(self, run: np.ndarray, hits: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
        """item -> (similarity, start, words, distance) of its best window in a document whose shingles are run."""
        found: dict[int, tuple[float, int, int, int]] = {}
        which = np.searchsorted(self.known, run[hits])
        of_size = defaultdict(list)
        for p, k in zip(hits.tolist(), which.tolist(), strict=True):
            for n in self.owners[k]:
                of_size[n].append(p)
        for n, at in of_size.items():
            m = min(n - SHINGLE + 1, len(run))  # shingles in a window
            reach = np.zeros(len(run) + 2, np.int32)  # starts of the windows that hold a hit
            at = np.array(at)
            np.add.at(reach, np.clip(at - m + 1, 0, len(run) - m), 1)
            np.add.at(reach, np.clip(at, 0, len(run) - m) + 1, -1)
            starts = np.flatnonzero(np.cumsum(reach) > 0)
            group = self.sizes[n]
            lo = 0
            while lo < len(starts):
                hi = int(np.searchsorted(starts, starts[lo] + SPAN))
                some = starts[lo:hi]
                sums = np.zeros((some[-1] - some[0] + m + 1, BITS), np.int32)
                np.cumsum(signs(run[some[0] : some[-1] + m]), axis=0, dtype=np.int32, out=sums[1:])
                prints = simhash(sums[some - some[0] + m] - sums[some - some[0]])
                for w, i, d in zip(*(x.tolist() for x in group["blocks"].within(prints)), strict=True):
                    s = int(some[w])
                    sim = jaccard(Counter(run[s : s + m].tolist()), group["counts"][i])
                    best = found.get(group["ids"][i])
                    if best is None or (sim, -s) > (best[0], -best[1]):
                        found[group["ids"][i]] = (sim, s, m + SHINGLE - 1, d)
                lo = hi
        return found


def leaks(ix: Index, t: Texts, threshold: float) -> Iterator[tuple[int, int, int, int, float, int]]:
    """(text, item, start, words, similarity, distance) of the best window of each text and item it leaks."""
    run = chain(t.lower, SHINGLE)
    owner = t.owner(SHINGLE)
    hits = ix.hits(run)
    hits = hits[owner[hits] >= 0]
    of = owner[hits]
    for d in np.unique(of).tolist():
        a, b = int(t.word_off[d]), int(t.word_off[d + 1]) - SHINGLE + 1
        for item, (sim, s, n, far) in ix.search(run[a:b], hits[of == d] - a).items():
            if sim >= threshold:
                yield d, item, s, n, sim, far
    for n, known in ix.short.items():
        run, owner = chain(t.lower, n) ^ _SLOT[61], t.owner(n)
        at = np.flatnonzero(np.isin(run, np.array(list(known), U)) & (owner >= 0))
        first: dict[tuple[int, int], int] = {}
        for p in at.tolist():
            for item in known[int(run[p])]:
                first.setdefault((int(owner[p]), item), p)
        for (d, item), p in first.items():
            yield d, item, p - int(t.word_off[d]), n, 1.0, 0


def _scan(index, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = list(leaks(index.value, Texts(batch.column(1)), threshold))
            if rows:
                text, *cols = zip(*rows, strict=True)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return scan


def _clean(index, threshold: float, at: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = np.zeros(batch.num_rows, bool)
            start = 0
            for part in chunks(iter([batch.select([at]).rename_columns(["text"])]), "text"):
                for d, *_ in leaks(index.value, Texts(part.column(0)), threshold):
                    bad[start + d] = True
                start += part.num_rows
            yield batch.filter(pa.array(~bad))

    return clean


def _indexes(benchmark: DataFrame) -> Iterator:
    """The indexes of the blocks of the benchmark, broadcast one after the other; a block has about BLOCK_WORDS words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    words = items.agg(F.sum(words_count(F.col("text")))).first()[0] or 0
    blocks = max(1, -(-int(words) // BLOCK_WORDS))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows]))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, distance): the best window of each document and item it leaks.

    A map over the documents; nothing is shuffled.
    """
    ready(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return union([own.mapInArrow(_scan(index, threshold), SCHEMA) for index in _indexes(benchmark)])


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """docs without the rows that leak a benchmark item: a filter over the rows, whatever their ids; nothing is shuffled."""
    ready(docs.sparkSession)
    at = docs.columns.index("text")
    for index in _indexes(benchmark):
        docs = docs.mapInArrow(_clean(index, threshold, at), docs.schema)
    return docs
