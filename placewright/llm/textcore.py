r"""Vectorised word splitting and hashing over Arrow string buffers.

A word is a maximal run of bytes outside ``\x20 \x09-\x0D``.  Hashes are
polynomial in Z/2^64 over per-byte random values and then mixed, so that one
cumulative sum gives the hash of any word, and a second one the hash of any
run of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93, "word2": 0xA0761D6478BD642F}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and its inverse powers, wrapping in 64 bits."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n + 1:
        base = _BASES[kind]
        size = max(n + 1, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64), salted."""
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def runs_hash(values: np.ndarray, kind: str = "word") -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers): hash of values[i:j] is (p[j] - p[i]) * inv[i]."""
    up, down = _power(kind, len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return prefix, down


def window_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str = "word", salt: int = 0) -> np.ndarray:
    prefix, down = runs_hash(values, kind)
    return mix((prefix[ends] - prefix[starts]) * down[starts], salt)


class Words:
    """Words of several texts: byte span, hash and the first word of each text."""

    __slots__ = ("data", "start", "end", "hash", "first", "counts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        n = len(data)
        self.data = data
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(len(offsets), np.int64)
            self.counts = np.zeros(len(offsets) - 1, np.int64)
            return
        word = ~SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | cut[1:n]
        stop = word
        stop[:-1] &= ~stop[1:] | cut[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        values = _BYTE[LOWER[data] if lower else data]
        self.hash = window_hash(values, self.start, self.end, "byte")
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.counts = np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of about SLICE_BYTES; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, buf[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def owner_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)
