"""Vectorised work on whole UTF-8 texts, shared by the operators of this subpackage.

A `Texts` holds the texts of one Arrow batch as one byte buffer with offsets, so words, lines, shingles and window hashes
of all its rows come out of a few NumPy passes and no Python object is made per word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLE = 5

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_BYTE_LOWER = _BYTE[LOWER]
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 2**64)
_MIX = [U(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_SLOT = _rng.integers(1, 2**63, 64, dtype=U) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * _MIX[0]
    x ^= x >> U(33)
    x *= _MIX[1]
    x ^= x >> U(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64, kept between calls."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, base, U)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, equal for equal bytes wherever they stand."""
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * powers(_STEP, len(data)), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(_BACK, len(data) + 1)[starts]
    return mix(h ^ ((ends - starts).astype(U) * _SLOT[60]))


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive values of h (len(h) - n + 1 of them)."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, U)
    for j in range(n):
        out += h[j : j + m] * _SLOT[j % 59] if j < 59 else mix(h[j : j + m] + U(j))
    return mix(out)


class Texts:
    """The texts of an Arrow string column."""

    def __init__(self, column: pa.Array | pa.ChunkedArray | list):
        if isinstance(column, list):
            column = pa.array(column, pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
        column = column.cast(pa.large_string()).fill_null("")
        self.n = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]

    def raw(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    def pieces(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs without a cut byte; no run crosses texts."""
        inside = ~cut
        first = inside.copy()
        first[1:] &= cut[:-1]
        last = inside.copy()
        last[:-1] &= cut[1:]
        edge = self.off[1:-1]
        edge = edge[(edge > 0) & (edge < len(inside))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @cached_property
    def space(self) -> np.ndarray:
        return SPACE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in the buffer."""
        return self.pieces(self.space)

    @cached_property
    def word_off(self) -> np.ndarray:
        """Text i has words word_off[i] to word_off[i + 1]."""
        return np.searchsorted(self.words[0], self.off)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_off)

    @cached_property
    def hashes(self) -> np.ndarray:
        """A hash of each word as it stands."""
        return spans_hash(self.data, *self.words)

    @cached_property
    def lower(self) -> np.ndarray:
        """A hash of each word with A-Z lowered."""
        return spans_hash(self.data, *self.words, _BYTE_LOWER)

    def windows(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of n words inside a text, in order."""
        run = chain(h, n)
        owner = self.owner(n)
        return owner[owner >= 0], run[owner >= 0]

    def owner(self, n: int) -> np.ndarray:
        """For each run of n words the text that holds all of it, or -1."""
        text = np.repeat(np.arange(self.n), self.n_words)
        if len(text) < n:
            return np.zeros(0, np.int64)
        return np.where(text[: len(text) - n + 1] == text[n - 1 :], text[: len(text) - n + 1], -1)

    def shingles(self, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, hashes): n-word shingles of each text, repeats included; of a shorter text its whole sequence as one."""
        text, run = self.windows(self.lower, n)
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < n))
        counts = np.bincount(text, minlength=self.n).astype(np.int64)
        counts[short] = 1
        off = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(off[-1], U)
        full = np.ones(off[-1], bool)
        full[off[short]] = False
        out[full] = run
        for i in short:
            a, b = self.word_off[i], self.word_off[i + 1]
            out[off[i]] = chain(self.lower[a:b], b - a)[0] ^ _SLOT[61]
        return off, out

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of every \\n-split line, empty ones too; an empty text has one empty line."""
        cut = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.off[:-1], cut + 1])
        text = np.concatenate([np.arange(self.n), np.searchsorted(self.off, cut, side="right") - 1])
        order = np.lexsort((starts, text))
        starts, text = starts[order], text[order]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        ends[-1:] = self.off[-1]
        last = np.append(text[1:] != text[:-1], True)[: len(text)]
        ends[last] = self.off[text[last] + 1]
        return text, starts, ends


def distinct(off: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each slice, with their offsets."""
    out, counts = [], np.zeros(len(off) - 1, np.int64)
    for i in range(len(counts)):
        x = np.sort(values[off[i] : off[i + 1]])
        if len(x):
            x = x[np.append(True, x[1:] != x[:-1])]
            out.append(x)
            counts[i] = len(x)
    return np.concatenate([[0], np.cumsum(counts)]), np.concatenate(out) if out else np.zeros(0, U)


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes of text, so that what is computed from one stays in the CPU's cache."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
