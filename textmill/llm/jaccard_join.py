"""N-gram Jaccard join with signature trees: documents link when their sets of 5-word shingles have a Jaccard similarity of 0.75.

Texts with equal words are one set. Sets are dealt into clusters, the roots of a forest: two sets share a root key (four MinHashes
of one of BANDS bands) or a chain of them. A pair at the limit of 0.75 misses all 64 keys with probability
(1 - 0.75 ** 4) ** 64 < 3e-11, a closer pair with far less; nothing else in the operator is inexact.

In a cluster a signature tree is built over the sets, ordered by size: each node holds the OR of its sets' token bitmaps, the range
of their sizes and the most tokens that share a bit in one set. The tree is traversed against itself; a pair of nodes is pruned
if its largest possible overlap (bits in both, and shared-bit tokens) is below the least overlap that its sizes need, or if all its sets
are linked already. Leaf pairs are verified on the sets themselves.

A cluster of more than BLOCK shingles is dealt over blocks. Each block has a tree of its own and a few hub sets that all blocks of the
cluster share, so near copies meet through the hubs. Sets outside the cluster's largest component then go, with their labels, to
every block, so each pair that may still link meets in one tree.

Defined cases: A-Z are lowered; a text of fewer than five words is one shingle, its whole sequence; null, empty and blank texts have an
empty set and link with nothing; rows with the same doc_id and other text are documents of their own, of which each may link; a null
doc_id comes first, and rows without one don't link for that; very long texts are whole sets; equal rows are one set; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm._bytes import LOWER, SHINGLE, Texts, U, chunks, distinct, mix
from textmill.llm._shared import components, dropped, fresh, partitions, ready, written

ROWS, BANDS = 4, 64
BLOCK = 4_000_000
HUBS = 32
LEAF, FAN = 8, 8
FIRST = -(2**63)
SCANNED = "doc_id long, copy long, digest binary, id long, n_shingles long, bucket int, packed binary"

_rng = np.random.default_rng(7)
_A, _B = (_rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1) for _ in range(2))


def digests(t: Texts) -> list[bytes]:
    """A digest of the word sequence of each text, A-Z lowered."""
    data = LOWER[t.data]
    keep = np.ones(len(data), bool)
    space = t.space
    data = np.where(space, np.uint8(32), data)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[t.off[1:-1][(t.off[1:-1] > 0) & (t.off[1:-1] < len(data))]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[t.off]
    raw = data[keep].tobytes()
    return [hashlib.md5(raw[a:b].strip(b" ")).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def root_keys(off: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """BANDS keys for each (non-empty) set."""
    low, high = (shingles & U(0xFFFFFFFF)).astype(np.uint32), (shingles >> U(32)).astype(np.uint32)
    least = np.empty((ROWS * BANDS, len(off) - 1), np.uint32)
    x, y = np.empty_like(low), np.empty_like(low)
    for k in range(ROWS * BANDS):
        np.multiply(low, _A[k], out=x)
        np.multiply(high, _B[k], out=y)
        np.bitwise_xor(x, y, out=x)
        np.minimum.reduceat(x, off[:-1], out=least[k])
    least = least.reshape(BANDS, ROWS, -1).astype(U)
    key = np.zeros(least.shape[::2], U)
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + least[:, r])
    return mix(key + np.arange(BANDS, dtype=U)[:, None]).T


def _scan(buckets: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        keys, ids, held = [], [], 0

        def out(**cols) -> pa.RecordBatch:
            n = len(next(iter(cols.values())))
            fields = {"doc_id": pa.int64(), "copy": pa.int64(), "digest": pa.binary(), "id": pa.int64(), "n_shingles": pa.int64(), "bucket": pa.int32(), "packed": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in fields.items()], names=list(fields))

        def flush() -> pa.RecordBatch:
            k, i = np.concatenate(keys), np.concatenate(ids)
            to = (k % U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            k, i, to = k[order], i[order], to[order]
            at = np.searchsorted(to, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(at))
            packed = [k[at[b] : at[b + 1]].tobytes() + i[at[b] : at[b + 1]].tobytes() for b in full]
            return out(bucket=full, packed=packed)

        for batch in chunks(batches, "text"):
            t = Texts(batch.column(2))
            names = digests(t)
            off, sets = distinct(*t.shingles())
            n = np.diff(off)
            own = np.array([int.from_bytes(x[:8], "little", signed=True) for x in names], np.int64)
            yield out(doc_id=batch.column(0), copy=batch.column(1), digest=names, id=own, n_shingles=n)
            if len(seen) > 200_000:
                seen.clear()
            fresh = []
            for i, x in enumerate(names):
                if n[i] and x not in seen:
                    seen.add(x)
                    fresh.append(i)
            if fresh:
                fresh = np.array(fresh)
                some = np.concatenate([sets[off[i] : off[i + 1]] for i in fresh])
                k = root_keys(np.concatenate([[0], np.cumsum(n[fresh])]), some)
                keys.append(k.ravel())
                ids.append(np.repeat(own[fresh], BANDS))
                held += k.size
            if held > 1_000_000:
                yield flush()
                keys, ids, held = [], [], 0
        if held:
            yield flush()

    return scan


def _roots(bucket: pd.DataFrame) -> pd.DataFrame:
    """Edges between sets of a bucket that share a key, thinned to one from each set to the smallest of those it is connected with."""
    k = np.concatenate([np.frombuffer(x, U, len(x) // 16) for x in bucket["packed"]])
    i = np.concatenate([np.frombuffer(x, np.int64, len(x) // 16, len(x) // 2) for x in bucket["packed"]])
    ids, i = np.unique(i, return_inverse=True)
    order = np.lexsort((i, k))
    k, i = k[order], i[order]
    first = np.append(True, k[1:] != k[:-1])
    hub = i[np.flatnonzero(first)][np.cumsum(first) - 1]
    hub, i = hub[hub != i], i[hub != i]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[hub], label[i])
        new = label.copy()
        np.minimum.at(new, hub, low)
        np.minimum.at(new, i, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"src": ids[label[own]], "dst": ids[own]})


class Forest:
    """Union-find over the sets of a tree; the smallest index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class Node:
    __slots__ = ("children", "extra", "high", "low", "sets", "signature", "uniform")

    def __init__(self, children: list, sets: list[int], signature: np.ndarray, low: int, high: int, extra: int):
        self.children, self.sets, self.signature, self.low, self.high, self.extra, self.uniform = children, sets, signature, low, high, extra, False


def build(sets: list[np.ndarray]) -> Node:
    """The signature tree over non-empty sorted sets."""
    size = [len(s) for s in sets]
    width = max(64, min(1 << 16, 1 << (2 * max(size) - 1).bit_length()))
    order = sorted(range(len(sets)), key=lambda i: (size[i], int(sets[i][0])))
    level = []
    for at in range(0, len(order), LEAF):
        own = order[at : at + LEAF]
        leaves = []
        for i in own:
            bits = np.zeros(width, bool)
            bits[(sets[i] & U(width - 1)).astype(np.int64)] = True
            packed = np.packbits(bits).view(U)
            leaves.append(Node([], [i], packed, size[i], size[i], size[i] - int(bits.sum())))
        level.append(_over(leaves))
    while len(level) > 1:
        level = [_over(level[at : at + FAN]) for at in range(0, len(level), FAN)]
    return level[0]


def _over(children: list[Node]) -> Node:
    signature = np.bitwise_or.reduce([c.signature for c in children])
    return Node(children, [i for c in children for i in c.sets[:1]], signature, min(c.low for c in children), max(c.high for c in children), max(c.extra for c in children))


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """The least intersection of sets of a and b elements whose Jaccard similarity is num / den or more."""
    return -(-num * (a + b) // (num + den))


def link(sets: list[np.ndarray], forest: Forest, num: int = 75, den: int = 100) -> int:
    """Joins in the forest all sets that link, by dual traversal; the number of pairs verified."""
    verified = 0
    if not sets:
        return 0

    def uniform(x: Node) -> bool:
        if not x.uniform:
            if x.children:
                root = forest.find(x.sets[0])
                x.uniform = all(uniform(c) and forest.find(c.sets[0]) == root for c in x.children)
            else:
                x.uniform = True
        return x.uniform

    def cross(x: Node, y: Node) -> None:
        nonlocal verified
        if uniform(x) and uniform(y) and forest.find(x.sets[0]) == forest.find(y.sets[0]):
            return
        if x.high * den < num * y.low or y.high * den < num * x.low:
            return
        need = least_overlap(x.low, y.low, num, den)
        if min(x.high, y.high) < need or int(np.bitwise_count(x.signature & y.signature).sum()) + min(x.extra, y.extra) < need:
            return
        if not x.children and not y.children:
            a, b = sets[x.sets[0]], sets[y.sets[0]]
            verified += 1
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both * den >= num * (len(a) + len(b) - both):
                forest.join(x.sets[0], y.sets[0])
        elif x.children and (not y.children or len(x.children) >= len(y.children)):
            for c in x.children:
                cross(c, y)
        else:
            for c in y.children:
                cross(x, c)

    def inside(x: Node) -> None:
        for c in x.children:
            inside(c)
        for i, c in enumerate(x.children):
            for d in x.children[i + 1 :]:
                cross(c, d)

    inside(build(sets))
    return verified


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, id, digest, label, text) ordered by task -> (src, dst): each set and the smallest of its component in the task."""
    task, held = None, {}

    def done() -> pa.RecordBatch:
        nodes = sorted(held)
        of = {x: i for i, x in enumerate(nodes)}
        forest = Forest(len(nodes))
        by_label = defaultdict(list)
        for x, (_, label) in held.items():
            if label is not None:
                by_label[label].append(of[x])
        for same in by_label.values():
            for b in same[1:]:
                forest.join(same[0], b)
        link([held[x][0] for x in nodes], forest)
        return pa.RecordBatch.from_arrays([pa.array([nodes[forest.find(i)] for i in range(len(nodes))], pa.int64()), pa.array(nodes, pa.int64())], names=["src", "dst"])

    for batch in chunks(batches, "text"):
        t = Texts(batch.column(4))
        off, sets = distinct(*t.shingles())
        names = digests(t)
        rows = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
        for i, (key, node, digest, label) in enumerate(rows):
            if key != task:
                if held:
                    yield done()
                task, held = key, {}
            if digest == names[i] and off[i + 1] > off[i]:
                held[node] = (sets[off[i] : off[i + 1]].copy(), label)
    if held:
        yield done()


#: What a set is fetched by, named, and checked by.
SET = ["node", "copy", "id", "digest"]


def _linked(docs: DataFrame, work: DataFrame) -> DataFrame:
    """(src, dst) from the trees of work, (task, *SET, label); the texts are fetched by doc_id and hash."""
    # always the same join: the work grows with the input, so it must not depend on its size
    own = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("node"), "copy", "text")
    texts = own.join(work.hint("merge"), ["node", "copy"]).select("task", "id", "digest", "label", "text")
    return texts.repartition("task").sortWithinPartitions("task").mapInArrow(_resolve, "src long, dst long").where("src <> dst")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, node (doc_id, a null one as FIRST), copy (a hash of the text), n_shingles, low (the smallest node reachable by links) and component of every row."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").cast("string").alias("text"))
    scanned = written(docs.mapInArrow(_scan(partitions(spark)), SCANNED))
    rows = scanned.where("digest is not null").select(F.coalesce("doc_id", F.lit(FIRST)).alias("node"), "doc_id", "copy", "digest", "id", "n_shingles")
    first_row = F.min(F.struct("node", "copy"))
    reps = written(rows.groupBy("digest").agg(first_row.alias("r"), F.first("id").alias("id"), F.first("n_shingles").alias("n_shingles")).where("n_shingles > 0").select("r.*", "id", "digest", "n_shingles"))
    edges = written(scanned.where("bucket is not null").select("bucket", "packed").groupBy("bucket").applyInPandas(_roots, "src long, dst long").distinct())
    roots = components(edges)
    dropped(spark, edges)
    members = written(reps.join(roots.withColumnRenamed("component", "cluster"), "id").select("cluster", *SET, "n_shingles"))
    dropped(spark, roots)
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / BLOCK).alias("blocks"))
    big = written(blocks.where("blocks > 1"))
    none = F.lit(None).cast("long").alias("label")
    if big.isEmpty():
        work = members.select(F.col("cluster").alias("task"), *SET, none)
        links = written(_linked(docs, work))
        final = links.select(F.col("dst").alias("id"), F.col("src").alias("component"))
    else:
        dealt = members.join(big, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = written(dealt.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks"))))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
        hub = F.when(F.pmod(F.xxhash64("digest", F.lit(1)), F.greatest(F.lit(1), F.col("blocks") * 16)) == 0, F.struct(F.xxhash64("digest", F.lit(2)), *SET))
        hubs = dealt.where("blocks > 1").groupBy("cluster", "blocks").agg(F.slice(F.sort_array(F.collect_set(hub)), 1, HUBS).alias("hubs"))
        hubs = hubs.select("cluster", "blocks", F.explode("hubs").alias("h")).select("cluster", *(F.col(f"h.{c}").alias(c) for c in SET), every)
        task = F.xxhash64("cluster", "block").alias("task")
        first = written(_linked(docs, dealt.select("cluster", "block", *SET).unionByName(hubs.select("cluster", "block", *SET)).distinct().select(task, *SET, none)))
        label = components(first)
        labelled = written(dealt.join(label.select("id", F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id")))
        sizes = labelled.where("blocks > 1").groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        loose = labelled.join(main, "cluster").where("label <> main").withColumn("part", F.pmod(F.xxhash64("digest", F.lit(3)), F.col("blocks")))
        spread = loose.select("cluster", *SET, "label", "part", every)
        parts = spread.select("cluster", "block", "part").distinct()
        own = labelled.where("blocks > 1").join(parts, ["cluster", "block"]).select("cluster", *SET, "label", "part", "block")
        task = F.xxhash64("cluster", "block", "part").alias("task")
        second = written(_linked(docs, own.unionByName(spread).distinct().select(task, *SET, "label")))
        final = components(first.unionByName(second)).select("id", "component")
    # a component is known by its smallest doc_id
    placed = reps.join(final, "id", "left").select("digest", "node", F.coalesce("component", "id").alias("component"))
    low = placed.groupBy("component").agg(F.min("node").alias("low"))
    by_digest = placed.join(low, "component").select("digest", "low", "component")
    return rows.join(by_digest, "digest", "left").select("doc_id", "node", "copy", "n_shingles", F.coalesce("low", "node").alias("low"), "component")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of every document."""
    return _grouped(docs).select("doc_id", "n_shingles", F.when(F.col("low") != FIRST, F.col("low")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the smallest doc_id, a null one first, and of texts
    with the same doc_id that with the smallest hash. Rows that agree in doc_id and text stay together, but of those without
    doc_id one stays; rows without words are in no group and stay."""
    node, copy, one = (fresh(docs, x) for x in ("group_node", "group_copy", "group_row"))
    members = written(_grouped(docs).where("n_shingles > 0").groupBy(F.col("node").alias(node), F.col("copy").alias(copy), "component").agg(F.count(F.lit(1)).alias("rows")))
    first = members.groupBy("component").agg(F.min(F.struct(node, copy)).alias("first"))
    extra = members.join(first, "component").where(F.struct(node, copy) != F.col("first")).select(node, copy)
    keyed = docs.withColumn(node, F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))).withColumn(copy, F.xxhash64("text"))
    left = keyed.join(extra, [node, copy], "left_anti")
    again = members.where((F.col(node) == FIRST) & (F.col("rows") > 1)).select(node, copy)
    if again.isEmpty():
        return left.select(*(f"`{c}`" for c in docs.columns))
    # rows without doc_id and of one text meet before they are shuffled
    rows = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    single = left.join(again, [node, copy], "left_semi").groupBy(node, copy).agg(F.first(rows).alias(one)).select(f"{one}.*")
    return left.join(again, [node, copy], "left_anti").select(*(f"`{c}`" for c in docs.columns)).unionByName(single)
