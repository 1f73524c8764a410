"""Vectorised word scanning and hashing of Arrow string columns.

Everything works on the UTF-8 bytes of a whole batch, a few megabytes at a
time, so a document costs no Python loop over its words.  Words are maximal
runs without the ASCII separators space, \\t, \\n, \\v, \\f and \\r; a null text
counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MASK = (1 << 64) - 1
#: Bytes that are hashed at a time.
BLOCK = 1 << 18
#: Numbers that are mixed, and windows of characters that are hashed, at a time: few enough to stay in a core's cache.
WINDOWS = 1 << 14
_BYTE_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD_BASE = (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)
#: Seeds of the random value given to each byte, one per hash lane.
_BYTE_SEED = (20240517, 77003911)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    if x.ndim == 1 and len(x) > WINDOWS:
        out = np.empty(len(x), dtype=np.uint64)
        for low in range(0, len(x), WINDOWS):
            out[low : low + WINDOWS] = mix(x[low : low + WINDOWS])
        return out
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            self.up, self.down = self._table(self.base, size), self._table(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTE_POWERS = tuple(_Powers(b) for b in _BYTE_BASE)
_WORD_POWERS = tuple(_Powers(b) for b in _WORD_BASE)
_BYTE_VALUES = tuple(np.random.default_rng(s).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in _BYTE_SEED)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty strings."""
    return raw(column.cast(pa.large_string()).fill_null(""))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some consecutive rows: byte spans, row of each word, first word of each row."""

    data: np.ndarray
    first_row: int
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # row r has words bounds[r]:bounds[r + 1]

    @property
    def n_rows(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.counts())

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of every word."""
        return span_hashes(self.data, self.starts, self.ends, lane)

    def windows(self, k: int, hashes: np.ndarray, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every run of k words inside one row."""
        n = len(self.starts)
        if n < k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        up, down = _WORD_POWERS[lane].upto(n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * up[:n], out=prefix[1:])
        last = np.repeat(self.bounds[1:] - k, self.counts())
        at = np.flatnonzero(np.arange(n) <= last)
        return at, mix((prefix[at + k] - prefix[at]) * down[at])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands; starts ascend.

    Goes through the bytes in blocks, so that what it holds beside the result
    grows with the longest span only.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + BLOCK, BLOCK))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a == b:
            continue
        low, high = int(starts[a]), int(ends[a:b].max())
        up, down = _BYTE_POWERS[lane].upto(high - low + 1)
        prefix = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[lane][data[low:high]] * up[: high - low], out=prefix[1:])
        begin = starts[a:b] - low
        out[a:b] = mix((prefix[ends[a:b] - low] - prefix[begin]) * down[begin])
    return out


def window_hashes(data: np.ndarray, heads: np.ndarray, k: int) -> np.ndarray:
    """The hash that span_hashes gives of the k characters from each one on, not mixed yet.

    heads are the first bytes of the characters, in ascending order.  The last
    k - 1 characters get hashes of fewer.
    """
    chars = _BYTE_VALUES[0][data]
    base = _BYTE_POWERS[0].upto(2)[0][1]
    if len(heads) < len(data):
        width = np.diff(np.append(heads, len(data)))
        up, _ = _BYTE_POWERS[0].upto(int(width.max(initial=1)) + 1)
        single, chars, power = chars, chars[heads], up[width]
        wide = np.flatnonzero(width > 1)
        for j in range(1, len(up) - 1):
            wide = wide[width[wide] > j]
            chars[wide] += single[heads[wide] + j] * up[j]
    out = np.zeros(len(chars), dtype=np.uint64)
    for low in range(0, len(out), WINDOWS):
        high = min(low + WINDOWS, len(out))
        own = chars[low + k - 1 : high + k - 1]
        out[low : low + len(own)] = own
        for j in range(k - 2, -1, -1):
            own = chars[low + j : high + j]
            part = out[low : low + len(own)]
            part *= base if len(heads) == len(data) else power[low + j : high + j]
            part += own
    return out


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop
        row = stop


def scan_words(column: pa.Array, piece_bytes: int = 1 << 20) -> Iterator[Words]:
    """The words of a string column, in pieces of about `piece_bytes`."""
    data, offsets = utf8(column)
    for row, stop in pieces(offsets, piece_bytes):
        part = data[offsets[row] : offsets[stop]]
        bounds = offsets[row : stop + 1] - offsets[row]
        word = ~_SEPARATOR[part]
        begins, closes = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < len(part))]
        begins[inner] = word[inner]
        closes[inner - 1] = word[inner - 1]
        starts = np.flatnonzero(begins)
        yield Words(part, row, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, bounds))


def row_sets(rows: np.ndarray, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending: (values, bounds of the rows).

    One sort by the row and the upper bits of the value; if two values differ
    in the lower bits alone, which is rare for hashes, a slower one by both.
    """
    bits = np.uint64(max(1, int(n_rows).bit_length()))
    key = rows.astype(np.uint64) << (np.uint64(64) - bits) | values >> bits
    order = np.argsort(key)
    if len(key) > 1:
        key, ordered = key[order], values[order]
        if ((key[1:] == key[:-1]) & (ordered[1:] < ordered[:-1])).any():
            order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[keep], values[keep]
    return values, np.searchsorted(rows, np.arange(n_rows + 1))
