"""Word tables and rolling hashes of Arrow text batches, in numpy.

A chunk holds a run of whole texts.  Words are maximal runs of bytes outside a
separator table; as every separator is ASCII, cutting UTF-8 bytes equals cutting
code points.  All hashes are 64-bit and depend on the bytes alone, so they agree
between processes and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = (seeded(11, 256), seeded(12, 256))
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # both 5 modulo 8
_ROLL = (0xA0761D6478BD6425, 0xE7037ED1A0B428DD)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        steps = np.full(size, _U(base))
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of start .. start+len-1 for each pair."""
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    return np.arange(total) - np.repeat(first - starts, lens)


class Chunk:
    """Texts ``lo..hi`` of a string array as bytes, with their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self.n_docs = len(offsets) - 1
        n = len(data)
        inside = ~separators[self.data]
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:] = ~inside[:-1]
        last[:-1] = ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        first[offsets[:-1][full]] = True
        last[offsets[1:][full] - 1] = True
        self.starts = np.flatnonzero(inside & first)
        self.ends = np.flatnonzero(inside & last) + 1
        self.word_offsets = np.searchsorted(self.starts, offsets)
        self.word_offsets[-1] = len(self.starts)
        self.n_words = np.diff(self.word_offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def word_hashes(self, which: int = 0) -> np.ndarray:
        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, _U)
        begin = np.cumsum(lens) - lens
        within = np.arange(int(lens.sum())) - np.repeat(begin, lens)
        at = within + np.repeat(self.starts, lens)
        value = _BYTE[which][self.data[at]] * powers(_BASE[which], int(lens.max()))[within]
        return mix(np.add.reduceat(value, begin) + lens.astype(_U))

    def windows(self, hashes: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of k words within one text, and their hashes."""
        left = np.repeat(self.word_offsets[1:], self.n_words) - np.arange(len(hashes))
        at = np.flatnonzero(left >= k)
        return at, window_hashes(hashes, k, which)[at] if len(at) else np.zeros(0, _U)

    def doc_bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def window_hashes(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of ``hashes[i:i+k]`` for every i; the last k-1 entries mean nothing."""
    out = hashes.copy()
    base = _U(_ROLL[which])
    if k <= 8:
        for j in range(1, k):
            out *= base
            out[: len(out) - j] += hashes[j:]
        return mix(out)
    n = len(hashes)
    up = powers(_ROLL[which], n)
    down = powers(pow(_ROLL[which], -1, 1 << 64), n)
    total = np.zeros(n + 1, _U)
    np.cumsum(hashes * up, out=total[1:])
    out[: max(0, n - k + 1)] = (total[k:] - total[: n - k + 1])[: max(0, n - k + 1)] * down[: max(0, n - k + 1)]
    return mix(out)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets


def chunks(batch: pa.RecordBatch, column: str = "text", separators: np.ndarray = SPACE, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Chunk]]:
    """(first row, row after the last, chunk) over a batch; a chunk has about ``most`` bytes or one text."""
    data, offsets = string_buffers(batch.column(column))
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], separators, lower)
        lo = hi


def list_array(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lens) + 1, np.int32)
    np.cumsum(lens, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
