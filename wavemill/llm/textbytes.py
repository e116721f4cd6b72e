"""Whole columns of text as one array of bytes, and hashes of its spans without a loop over words or characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd base and its inverse modulo 2**64, for two independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
CHUNK = 1 << 20


def fmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3, on arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Spans:
    """Hashes of spans of a byte array: prefix sums of table[byte] * base**i, shifted back to the span's start."""

    def __init__(self, which: int = 0):
        self.base = BASES[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.table = fmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[1 - which]))
        self.n = -1

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, CHUNK)
            up = np.full(self.n + 1, self.base, np.uint64)
            down = np.full(self.n + 1, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def prefix(self, b: np.ndarray) -> np.ndarray:
        self.grow(len(b))
        out = np.empty(len(b) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.table[b] * self.up[: len(b)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each b[start:end]. Length is mixed in by the caller where spans of several lengths meet."""
        return fmix((prefix[end] - prefix[start]) * self.down[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK, rows: int = 1 << 31):
    """(first row, last row + 1, bytes, offsets) over pieces of about `limit` bytes and `rows` rows at most, whole rows each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    raw, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, i + rows)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def lower(b: np.ndarray) -> np.ndarray:
    """A-Z as a-z; bytes of other letters stay."""
    return _LOWER[b]


def words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word `[^\\x20\\x09-\\x0D]+`; no word spans two rows."""
    if not len(b):
        return (np.empty(0, np.int64),) * 3
    full = ~_BLANK[b]
    first = full.copy()
    first[1:] &= ~full[:-1]
    last = full.copy()
    last[:-1] &= ~full[1:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(b))]
    first[inner] = full[inner]
    last[inner - 1] = full[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(spans: Spans, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans.span(spans.prefix(b), start, end) ^ fmix((end - start).astype(np.uint64))
