"""Vectorised 64-bit hashes of words and word runs over UTF-8 bytes, for whole texts of any length.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z unless ``CASED`` is passed. Hashes depend on bytes only, so they are
the same in every task and on every machine. Two different words or runs share a hash with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD1342543DE82EF95)  # odd, so that it has an inverse modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _lower() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[ord("A") : ord("Z") + 1] += 32
    return low


CASED = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED))
_BYTE = CASED[_lower()]
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Powers:
    """Powers of the base and of its inverse, extended as longer texts arrive."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 12)
            self.up, self.down = (np.full(size, b, dtype=np.uint64) for b in (_BASE, _INVERSE))
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)


_POWERS = Powers()


def chunks(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of an Arrow column in slices of about ``size`` bytes: first row, bytes, and where each text begins and ends.

    A null has no bytes. A text longer than ``size`` is a slice of its own: nothing is cut.
    """
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def pieces(batch: pa.RecordBatch, column: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``size`` bytes of ``column``, in order; a longer text is a slice of its own."""
    for row, _, offsets in chunks(batch.column(column), size):
        yield batch.slice(row, len(offsets) - 1)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a slice of texts begins and ends."""
    word = _WORD[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of a slice of texts, in order, and the position of each text's first word (one more at the end)."""
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    starts, ends = word_bounds(raw, offsets)
    _POWERS.reach(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(table[raw] * _POWERS.up[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def run_hashes(words: np.ndarray, n: int, factor: int = 0xA0761D6478BD642F) -> np.ndarray:
    """A hash for each run of ``n`` words; the whole sequence as one run where there are fewer; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(factor) + words[k : k + len(out)]
    return mix(out)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text of a column the sorted distinct hashes of its runs of ``n`` words."""
    for _, raw, offsets in chunks(column):
        words, firsts = word_hashes(raw, offsets)
        runs = run_hashes(words, n) if len(words) >= n else None
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            yield np.unique(runs[a : b - n + 1] if b - a >= n else run_hashes(words[a:b], n))


def text_digest(values: np.ndarray) -> bytes:
    """128 bits that stand for a sorted array of hashes."""
    import hashlib

    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
