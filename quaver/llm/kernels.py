"""Vectorised text kernels shared by the Arrow-batch operators.

All of them work on the UTF-8 bytes of a whole Arrow batch at once: a batch is cut
into slices of about ``SLICE_BYTES`` of text, so the memory a task needs depends on
the slice (or on the longest single text) and not on the number of rows it reads.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR. Those
bytes never occur inside a multi-byte UTF-8 sequence, so byte runs and character
runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (the public splitmix64 one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream64(n: int, seed: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers; the same everywhere."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_COEF = stream64(256, 7)
_SHINGLE = stream64(64, 11) | np.uint64(1)


def _coefs(n: int) -> np.ndarray:
    return _COEF if n <= len(_COEF) else stream64(n, 7)


class Words:
    """The words of a slice of texts: hashes, and where each text's words begin and end."""

    __slots__ = ("data", "doc_start", "ends", "hashes", "offsets", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.data, self.offsets, self.hashes, self.starts, self.ends = data, offsets, hashes, starts, ends
        #: doc_start[i] : doc_start[i + 1] are the words of text i
        self.doc_start = np.searchsorted(starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc_start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the offset of each (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = True, breaks: bytes = b"") -> Words:
    """The words of each text; A-Z in lower case if asked; bytes of ``breaks`` separate words as well."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, offsets, np.zeros(0, np.uint64), z, z)
    ws = _WS[data]
    if breaks:
        more = np.zeros(256, dtype=bool)
        more[list(breaks)] = True
        ws = ws | more[data]
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here
    edge[offsets] = True
    begin = ~ws
    begin[1:] &= ws[:-1] | edge[1:-1]
    stop = ~ws
    stop[:-1] &= ws[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(starts):
        return Words(data, offsets, np.zeros(0, np.uint64), starts, ends)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        part = (data[~ws].astype(np.uint64) + np.uint64(1)) * _coefs(int(sizes.max()))[place]
        hashes = mix64(np.add.reduceat(part, first) ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return Words(data, offsets, hashes, starts, ends)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words of one text; of the whole text when it has fewer; none without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(k, n)
    with np.errstate(over="ignore"):
        total = np.full(n - size + 1, np.uint64(size) * np.uint64(0xD6E8FEB86659FD93))
        for j in range(size):
            total += words[j : n - size + 1 + j] * _SHINGLE[j]
        return mix64(total)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of text each; a longer text stands alone."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high
