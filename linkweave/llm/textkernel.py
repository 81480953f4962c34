"""Vectorised word hashing over Arrow string columns.

Texts are read as UTF-8 bytes straight from Arrow buffers and handled in
chunks of about one megabyte, so memory stays bounded whatever the batch size.
Hashes are 64 bits wide and depend only on a word's bytes, never on the batch,
the partition or the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every byte that is not white space belongs to a word.
NON_SPACE = ~_SPACE
#: Only ASCII letters, digits and bytes of non-ASCII characters belong to a word.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_rng = np.random.default_rng(20240607)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
#: Values of the bytes, without and with A-Z lower-cased.
EXACT, FOLDED = _BYTES, _BYTES[_LOWER]
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        size = 1 << max(20, int(n).bit_length())
        for k, base in enumerate((_P, _P_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together; a longer row is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


@dataclass
class Words:
    """Words of rows ``first`` to ``last``: hash, byte range, and each row's first word."""

    first: int
    last: int
    raw: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray

    def of(self, i: int) -> slice:
        """The words of row ``first + i``."""
        return slice(self.row[i], self.row[i + 1])


def words(column: pa.Array, inside: np.ndarray = NON_SPACE, values: np.ndarray = FOLDED) -> Iterator[Words]:
    """Words of each row in runs of rows; ``inside`` says which bytes form words."""
    raw, offsets = utf8(column)
    for first, last in chunks(offsets):
        low, high = int(offsets[first]), int(offsets[last])
        part, bounds = raw[low:high], offsets[first : last + 1] - low
        n = high - low
        if not n:
            none = np.zeros(0, np.int64)
            yield Words(first, last, part, none.astype(np.uint64), none, none, np.zeros(last - first + 1, np.int64))
            continue
        is_in = inside[part]
        begins, stops = is_in.copy(), is_in.copy()
        begins[1:] &= ~is_in[:-1]
        stops[:-1] &= ~is_in[1:]
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner] = is_in[inner]
        stops[inner - 1] = is_in[inner - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        up, down = _power_tables(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[part] * up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        yield Words(first, last, part, hashes, starts, ends, np.searchsorted(starts, bounds))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; fewer words make one run of all; none makes none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total *= np.uint64(_P)
        total += hashes[j : n - width + 1 + j]
    return mix(total)
