"""Removal of repeated byte strings with a suffix array: a byte goes if a SIZE-byte string over it also starts in a document with a
smaller doc_id.

1. Texts with equal bytes are one document, the one with the smallest doc_id; its copies go as a whole.
2. Of the suffixes only those that begin with the smallest hash among their next WINDOW successors are anchors; every SIZE-byte string
   has one at a place that its bytes alone decide. Anchors are dealt by hash, as 32 bits and a place. Those found in one
   document only can't lie in a repeat; most suffixes leave here. A wrong match of 32 bits only costs time.
3. Around each anchor that is left stands a context: all strings it is the anchor of. Contexts are dealt by anchor and get a
   suffix array by two-stage sorting: suffixes smaller than their successors are sorted directly; the others are induced by a scan over
   the buckets of first bytes, in order, in which each takes its place after its successor's. The common prefixes of adjacent suffixes
   then give the classes of equal strings, each with its smallest doc_id.
4. A document's strings with a smaller doc_id in their class are joined back to its text and cut out.

Hot groups: a task sends one entry of an anchor or context that several of its documents share, and the rest go on at once or are
decided on the spot; contexts of an anchor with more than HOT entries are dealt string by string, by their own bytes.

Defined cases: null is empty; texts under SIZE bytes lose nothing, even if they are copies; rows with the same doc_id never remove
each other's bytes, and if their texts differ each is cut by its own repeats (all places then carry a hash of the text beside the
doc_id); a null doc_id is smaller than all others, and all rows with one count as one document; texts are whole, matches never cross documents; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm._bytes import _BYTE, Texts, U, chunks, mix, spans_hash
from textmill.llm._shared import partitions, ready, written

SIZE = 50
GRAM = 20
WINDOW = SIZE - GRAM + 1
HOT = 20_000
FIRST = -(2**63)
FLUSH = 600_000
CONTEXT_BYTES = 6 << 20
#: Buckets per shuffle partition: a bucket is what a worker holds at once.
SPLIT = 4
_STEP = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every GRAM bytes along the last axis."""
    h1 = _BYTE[data]
    h2 = h1[..., :-1] * _STEP[0] + h1[..., 1:]
    h4 = h2[..., :-2] * _STEP[1] + h2[..., 2:]
    h4 ^= h4 >> U(29)
    h8 = h4[..., :-4] * _STEP[2] + h4[..., 4:]
    h16 = h8[..., :-8] * _STEP[3] + h8[..., 8:]
    h16 ^= h16 >> U(31)
    n = data.shape[-1] - GRAM + 1
    return mix(h16[..., :n] * _STEP[4] + h4[..., 16 : 16 + n])


def _deal(h: np.ndarray) -> np.ndarray:
    """What anchors are dealt by: other bits than those that choose them."""
    return mix(h ^ U(0x2545F4914F6CDD1D))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, first, last, hash): each anchor with the starts of the strings it is the anchor of; places in the buffer."""
    none = np.zeros(0, np.int64)
    if len(data) < SIZE:
        return none, none, none, none, none.astype(U)
    h = gram_hashes(data)
    low = (h & ~U(0xFFFFFFFF)) | np.arange(len(h), dtype=U)  # the leftmost of equal hashes
    step = 1
    while step * 2 <= WINDOW:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if WINDOW > step:
        low = np.minimum(low[: step - WINDOW], low[WINDOW - step :])
    place = (low & U(0xFFFFFFFF)).astype(np.int64)
    whole = np.zeros(len(place) + 1, np.int64)  # starts of strings inside a text
    n = np.diff(off)
    ok = n >= SIZE
    np.add.at(whole, off[:-1][ok], 1)
    np.add.at(whole, off[1:][ok] - SIZE + 1, -1)
    start = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    place = place[start]
    text = np.searchsorted(off, start, side="right") - 1
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])) if len(place) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return text[first], place[first], start[first], start[last], h[place[first]]


def _pack(*columns: np.ndarray) -> bytes:
    raw = b"".join(np.int64(c.nbytes).tobytes() + c.tobytes() for c in columns)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], int(np.frombuffer(packed, np.int64, 1)[0]), "zstd", asbytes=True)
    at, out = 0, []
    for kind in kinds:
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _batch(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    b, known, packed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(known, pa.bool_()), pa.array(packed, pa.binary())], names=["bucket", "known", "packed"])


DEALT = "bucket int, known boolean, packed binary"


def _split(to: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    at = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(at)).tolist():
        yield b, order[at[b] : at[b + 1]]


def _anchored(buckets: int):
    """Anchors of each task's documents, dealt by hash; those that two documents of the task share are known to be repeated."""

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}  # the smallest doc_id of a text so far: what a later copy with a smaller one has must go on, too
        held, size, turn = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal turn
            doc, tag, code, h = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((doc, h))
            hs, ds = h[order], doc[order]
            new = np.append(True, hs[1:] != hs[:-1])
            group = np.cumsum(new) - 1
            shared = np.zeros(group[-1] + 1, bool)
            shared[group[1:][(hs[1:] == hs[:-1]) & (ds[1:] != ds[:-1])]] = True
            known = np.zeros(len(h), bool)
            known[order] = shared[group]
            lead = np.zeros(len(h), bool)
            lead[order[new]] = True
            send = ~known | lead
            rows = []
            ids = np.flatnonzero(send)
            n = np.zeros(len(h), np.uint32)
            n[order[new]] = np.bincount(group)
            for b, some in _split(_bucket(h[ids], buckets), buckets):
                k = ids[some]
                rows.append((b, False, _pack(h[k].astype(np.uint32), doc[k], tag[k], code[k], known[k], np.where(known[k], n[k], 1).astype(np.uint32))))
            rest = np.flatnonzero(known)
            if len(rest):
                turn += 1
                rows.append(((turn * 7919 + int(doc[rest[0]])) % buckets, True, _pack(doc[rest], tag[rest], code[rest])))
            return _batch(rows)

        for batch in chunks(batches, "text", 1 << 18):
            t = Texts(batch.column(1))
            ids, tags = (np.array(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (0, 2))
            text, place, first, last, h = anchors(t.data, t.off)
            fresh = np.ones(t.n, bool)
            for i in range(t.n):
                d = hashlib.md5(t.raw(i)).digest()
                least = seen.get(d)
                fresh[i] = least is None or ids[i] < least
                if fresh[i]:
                    seen[d] = int(ids[i])
            if len(seen) > 200_000:
                seen.clear()
            if not fresh.all():
                ok = fresh[text]
                text, place, first, last, h = text[ok], place[ok], first[ok], last[ok], h[ok]
            if len(h):
                code = ((place - t.off[text]) << 16) | ((place - first) << 8) | (last - place + WINDOW)
                held.append((ids[text], tags[text], code, _deal(h)))
                size += len(h)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return anchored


REPEATED = "doc_id long, tag long, code long, hot boolean"


def _repeated(bucket: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, tag, code, hot): the anchors of a bucket that two documents have, and an own row for each with over HOT entries."""
    b = int(bucket["bucket"].iloc[0])
    out = [[*_unpack(x, np.int64, np.int64, np.int64)] for x in bucket["packed"][bucket["known"]]]
    hot = np.zeros(0, np.int64)
    parts = [_unpack(x, np.uint32, np.int64, np.int64, np.int64, bool, np.uint32) for x in bucket["packed"][~bucket["known"]]]
    if parts:
        h, doc, tag, code, known, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((doc, h))
        h, doc, tag, code, known, n = h[order], doc[order], tag[order], code[order], known[order], n[order]
        new = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(new) - 1
        hit = np.zeros(group[-1] + 1, bool)
        hit[group[known]] = True
        hit[group[1:][(h[1:] == h[:-1]) & (doc[1:] != doc[:-1])]] = True
        many = np.bincount(group, n) > HOT
        hot = h[new][many & hit].astype(np.int64) | b << 32
        ok = hit[group] & ~known
        out.append([doc[ok], tag[ok], code[ok]])
    doc, tag, code = (np.concatenate(c) for c in zip(*out, strict=True))
    zero = np.zeros(len(hot), np.int64)
    return pd.DataFrame({"doc_id": np.append(doc, zero), "tag": np.append(tag, zero), "code": np.append(code, hot), "hot": np.arange(len(doc) + len(hot)) >= len(doc)})


def suffix_array(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of data in the order of the SIZE bytes that follow them: all of starts, and those their order is induced from."""
    padded = np.concatenate([data, np.zeros(SIZE + 1, np.uint8)])
    cur, succ = padded[:-1], padded[1:]
    # a suffix is larger than its successor if the first byte unlike its successor is smaller than it; places fit in 32 bits
    turn = np.where(cur != succ, np.arange(len(cur), dtype=np.int32), np.int32(len(cur) - 1))
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    larger = (cur > succ)[turn]
    del turn
    direct = np.flatnonzero(~larger).astype(np.int32)
    down = direct[np.searchsorted(direct, starts.astype(np.int32))]  # the last place is direct, as the padding ends there
    need = np.zeros(len(padded) + 1, np.int32)
    np.add.at(need, starts, 1)
    np.add.at(need, down + 1, -1)
    need = np.cumsum(need, dtype=np.int32)[: len(cur)] > 0
    # first stage: sort the direct ones
    direct = np.flatnonzero(need & ~larger).astype(np.int32)
    more = np.concatenate([padded, np.zeros(SIZE, np.uint8)])  # a direct one may begin in the padding
    records = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(more, SIZE)[direct])
    direct = direct[np.argsort(records.view(f"S{SIZE}").ravel())]
    del records
    # second stage: scan the buckets; a successor stands in an earlier one, or in the same one nearer to the end of a run of equal bytes
    induced = np.flatnonzero(need & larger).astype(np.int32)
    del need, larger
    induced = induced[np.argsort(cur[induced], kind="stable")]
    edge = np.searchsorted(cur[induced], np.arange(257))
    cut = np.searchsorted(cur[direct], np.arange(257))
    rank = np.full(len(padded), -1, np.int32)
    out, made = [], 0

    def place(some: np.ndarray) -> None:
        nonlocal made
        rank[some] = np.arange(made, made + len(some), dtype=np.int32)
        made += len(some)
        out.append(some)

    for c in range(256):
        own = induced[edge[c] : edge[c + 1]]
        while len(own):
            ready_ = rank[own + 1] >= 0
            some = own[ready_]
            place(some[np.argsort(rank[some + 1])])
            own = own[~ready_]
        place(direct[cut[c] : cut[c + 1]])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in order but the first, how many of SIZE bytes it shares with the one before it."""
    windows = np.lib.stride_tricks.sliding_window_view(data, SIZE)
    out = np.empty(max(0, len(order) - 1), np.uint8)
    for at in range(0, len(out), 1 << 17):
        to = min(len(out), at + (1 << 17))
        differ = windows[order[at + 1 : to + 1]] != windows[order[at:to]]
        out[at:to] = np.where(differ.any(1), differ.argmax(1), SIZE)
    return out


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each start, equal for equal data[start : start + SIZE]: the intervals of a suffix array.

    data has SIZE bytes or more after every start.
    """
    order = suffix_array(data, starts)
    mine = np.zeros(int(order.max()) + 1, bool)
    mine[starts] = True
    order = order[mine[order]]
    number = np.zeros(len(mine), np.int64)
    number[order] = np.concatenate([[0], np.cumsum(common_prefixes(data, order) < SIZE)])
    return number[starts]


def decide(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, length: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc_id, tag, a, b): runs of starts a to b of strings that a document with a smaller doc_id of these contexts has, too.

    Context i is length[i] bytes of data, in order, from place first[i] of document doc[i].
    """
    at = np.concatenate([[0], np.cumsum(length)])
    n = length - SIZE + 1
    of = np.repeat(np.arange(len(doc)), n)
    starts = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + at[of]
    kind = classes(data, starts)
    least = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc[of])
    gone = np.flatnonzero(least[kind] < doc[of])
    if not len(gone):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    new = np.append(True, (gone[1:] != gone[:-1] + 1) | (of[gone[1:]] != of[gone[:-1]]))
    a = gone[new]
    b = gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1]
    c = of[a]
    return doc[c], tag[c], first[c] + starts[a] - at[c], first[c] + starts[b] - at[c]


def _contexts(buckets: int, hot_keys):
    """Contexts of (doc_id, text, codes, tag), dealt by anchor; equal contexts of a task are decided here but for the smallest doc_id."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal turn
            doc, tag, first, length, key, content, data = (np.concatenate(h) for h in zip(*held, strict=True))
            at = np.cumsum(length) - length
            order = np.lexsort((first, doc, content))
            new = np.append(True, content[order][1:] != content[order][:-1])
            owner = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            rows = []
            known = order[owner < doc[order]]
            if len(known):
                turn += 1
                rows.append(((turn * 7919 + int(doc[known[0]])) % buckets, True, _pack(doc[known], tag[known], first[known], first[known] + length[known] - SIZE)))
            send = np.sort(order[owner == doc[order]])
            for b, some in _split(_bucket(key[send], buckets), buckets):
                k = send[some]
                inside = np.repeat(at[k] - (np.cumsum(length[k]) - length[k]), length[k]) + np.arange(length[k].sum())
                rows.append((b, False, _pack(doc[k], tag[k], first[k], length[k], data[inside])))
            return _batch(rows)

        for batch in chunks(batches, "text", 1 << 19):
            t = Texts(batch.column(1))
            ids, tags = (np.array(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (0, 3))
            codes = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            off = codes.offsets.to_numpy()
            code = codes.values.to_numpy()[off[0] : off[-1]]
            text = np.repeat(np.arange(t.n), np.diff(off))
            place = (code >> 16) + t.off[text]
            first = place - (code >> 8 & 0xFF)
            last = place + (code & 0xFF) - WINDOW
            key = _deal(gram_hashes(t.data[place[:, None] + np.arange(GRAM)])[:, 0])
            hot = np.isin(_bucket(key, buckets) << 32 | (key & U(0xFFFFFFFF)).astype(np.int64), hot_keys.value)
            length = last - first + SIZE
            if hot.any():
                n = np.where(hot, last - first + 1, 1)
                of = np.repeat(np.arange(len(code)), n)
                shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                text, first = text[of], first[of] + shift
                length = np.where(hot[of], SIZE, length[of])
                key = np.where(hot[of], mix(spans_hash(t.data, first, np.minimum(first + SIZE, len(t.data)))), key[of])
            inside = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
            own = t.data[inside]
            at = np.cumsum(length) - length
            held.append((ids[text], tags[text], first - t.off[text], length, key, spans_hash(own, at, at + length), own))
            size += len(inside)
            if size >= CONTEXT_BYTES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return contexts


def _decided(bucket: pd.DataFrame) -> pd.DataFrame:
    out = [_unpack(x, np.int64, np.int64, np.int64, np.int64) for x in bucket["packed"][bucket["known"]]]
    parts = [_unpack(x, np.int64, np.int64, np.int64, np.int64, np.uint8) for x in bucket["packed"][~bucket["known"]]]
    if parts:
        out.append(decide(*(np.concatenate(c) for c in zip(*parts, strict=True))))
    doc, tag, a, b = (np.concatenate(c) for c in zip(*out, strict=True))
    return pd.DataFrame({"doc_id": doc, "tag": tag, "span": a << 32 | b})


RESULT = "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 22):
            t = Texts(batch.column(1))
            copy = batch.column(2).to_pylist()
            spans = batch.column(3).to_pylist()
            rows = []
            for i in range(t.n):
                raw = t.data[t.off[i] : t.off[i + 1]]
                n = len(raw)
                if copy[i] and n >= SIZE:
                    kept, removed, runs = b"", n, 1
                elif spans[i]:
                    s = np.array(spans[i], np.int64)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, s >> 32, 1)
                    np.add.at(edge, (s & 0xFFFFFFFF) + SIZE, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept, removed = raw[~gone].tobytes(), int(gone.sum())
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                else:
                    kept, removed, runs = raw.tobytes(), 0, 0
                rows.append((n, removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), *(pa.array(c, k) for c, k in cols)], names=[x.split()[0] for x in RESULT.split(", ")])

    return cut


def dedup_suffixes(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; `kept`, the bytes that are left, if asked for."""
    spark = docs.sparkSession
    ready(spark)
    buckets = SPLIT * partitions(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").isNull().alias("no_id"))
    digests = docs.where(F.octet_length("text") >= SIZE).select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.xxhash64("text").alias("tag"))
    several = digests.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b")
    # a doc_id says which text it is unless some doc_id has two
    one = several.isEmpty()
    docs = docs.withColumn("tag", F.lit(0).cast("long") if one else F.xxhash64("text"))
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = digests.join(least, "digest").where("doc_id > least").select("doc_id", (F.lit(0).cast("long") if one else F.col("tag")).alias("tag"), F.col("digest").alias("copy"))
    copies = written(copies.distinct())
    dealt = docs.select("doc_id", "text", "tag").mapInArrow(_anchored(buckets), DEALT)
    repeated = written(dealt.groupBy("bucket").applyInPandas(_repeated, REPEATED))
    # fewer than entries / HOT rows; as numbers, 8 bytes each
    hot = spark.sparkContext.broadcast(np.array([r[0] for r in repeated.where("hot").select("code").collect()], np.int64))
    key = ["doc_id", "tag"]
    same = F.col("copy") == F.unhex(F.md5("text"))
    codes = repeated.where("not hot").groupBy(key).agg(F.collect_set("code").alias("codes")).join(copies, key, "left")
    around = docs.join(codes, key).where(F.col("copy").isNull() | ~same).select("doc_id", "text", "codes", "tag")
    decided = written(around.mapInArrow(_contexts(buckets, hot), DEALT).groupBy("bucket").applyInPandas(_decided, "doc_id long, tag long, span long"))
    marks = decided.groupBy(key).agg(F.collect_list("span").alias("spans")).join(copies, key, "full")
    own = docs.join(marks, key, "left").select("doc_id", "text", (F.col("copy").isNotNull() & same).alias("copied"), "spans", "no_id")
    out = own.mapInArrow(_cut(with_text), RESULT).withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
    return out if with_text else out.drop("kept")
