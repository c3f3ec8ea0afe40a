"""Text kernels that work on whole Arrow string buffers with numpy.

A column of texts arrives as one byte buffer with offsets; words, hashes and
n-grams are computed for all of them at once, in slices of half a megabyte so
that temporaries stay in cache and memory doesn't depend on the batch size.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))

#: Bytes of words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True
#: Bytes of whitespace-separated tokens.
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for k, base in enumerate((_P, _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: memory goes back when it sees fit
        return None


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; what they took goes back to the system when they end.

    Python workers outlive their tasks and share an executor's memory with the
    JVM, so what a task freed mustn't stay with the allocators.
    """
    yield from source
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def column(batch: pa.RecordBatch, i: int) -> pa.Array:
    a = batch.column(i)
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least; together they cover all rows."""
    n = len(texts)
    if not n:
        return
    sizes = np.nan_to_num(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    ends, lo = np.cumsum(sizes), 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, hi
        lo = hi


def buffer(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; a null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    ascii_only = False
    if lower:
        try:
            texts = pc.utf8_lower(texts)
        except pa.ArrowInvalid:  # not valid UTF-8: ASCII letters only
            ascii_only = True
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n, bufs = len(texts), texts.buffers()
    if n == 0 or bufs[2] is None or bufs[2].size == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64, count=n + 1, offset=texts.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]]
    return (_LOWER[data] if ascii_only else data), off - off[0]


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``table`` bytes within each text, and the runs' offsets by text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = table[data]
    brk = np.zeros(n + 1, bool)
    brk[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    start = np.flatnonzero(w & (~before | brk[:n]))
    end = np.flatnonzero(w & (~after | brk[1:])) + 1
    return start, end, np.searchsorted(start, off)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they are."""
    n = len(data)
    pw, ipw = powers(n + 1)
    cs = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:n], out=cs[1:])
    return mix((cs[end] - cs[start]) * ipw[start])


def run_hash(values: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run ``values[off[i]:off[i+1]]`` of 64-bit values, order included."""
    n = len(values)
    pw, ipw = powers(n + 1)
    cs = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values + np.uint64(seed)) * pw[:n], out=cs[1:])
    return mix((cs[off[1:]] - cs[off[:-1]]) * ipw[off[:-1]] + np.diff(off).astype(np.uint64))


def shingles(h: np.ndarray, tok_off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word k-grams of each text and their offsets; a text of fewer words has one, its whole sequence."""
    n_tok = np.diff(tok_off)
    count = np.where(n_tok >= k, n_tok - k + 1, np.minimum(n_tok, 1))
    off = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=off[1:])
    out = np.empty(off[-1], np.uint64)
    if not len(out):
        return out, off
    at = np.repeat(tok_off[:-1] - off[:-1], count) + np.arange(off[-1])
    short = np.repeat(n_tok < k, count)
    g = np.zeros(len(out), np.uint64)
    mult = np.uint64(0xD6E8FEB86659FD93)
    last = len(h) - 1
    for j in range(k):
        g = g * mult + h[np.minimum(at + j, last)]
    out[:] = mix(g)
    if short.any():
        whole = run_hash(h, tok_off, 77)
        doc = np.repeat(np.arange(len(count)), count)
        out[short] = whole[doc[short]]
    return out, off


def doc_of(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def sum_by(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each run, zero for an empty one."""
    cs = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=cs[1:])
    return cs[off[1:]] - cs[off[:-1]]


class IntTable:
    """Open-addressing map from distinct uint64 keys to their positions, for whole arrays at once."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, np.uint64)
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.EMPTY, np.uint64)
        self.pos = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == self.EMPTY
            self.pos[slot[free]] = left[free]
            won = free & (self.pos[slot] == left)
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _P) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is absent."""
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.pos[slot], np.int32(-1))
        more = np.flatnonzero((got != keys) & (got != self.EMPTY))
        slot = slot[more]
        while len(more):
            slot = (slot + 1) & self.mask
            got = self.keys[slot]
            want = keys[more]
            hit = got == want
            out[more[hit]] = self.pos[slot[hit]]
            go = ~hit & (got != self.EMPTY)
            more, slot = more[go], slot[go]
        return out


class Counter64:
    """Counts of uint64 values over many arrays, kept sorted."""

    def __init__(self, every: int = 1 << 22):
        self.every, self.pending, self.size = every, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            values, counts = np.unique(values, return_counts=True)
        self.pending.append((values, counts))
        self.size += len(values)
        if self.size > max(self.every, len(self.keys)):
            self.fold()

    def fold(self) -> None:
        if not self.pending:
            return
        k = np.concatenate([self.keys, *(p[0] for p in self.pending)])
        c = np.concatenate([self.counts, *(p[1] for p in self.pending)])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        self.keys, self.counts = k[first], np.add.reduceat(c, first) if len(k) else c
        self.pending, self.size = [], 0
