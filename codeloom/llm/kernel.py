"""Vectorised text kernels over Arrow string buffers.

A batch of texts is one byte buffer with offsets.  Words are maximal runs of
bytes other than 0x20 and 0x09-0x0D; since UTF-8 never uses those bytes inside
a longer character, this is the same as over code points.  Texts are taken in
slices of a few MB, so memory does not follow the batch, and a text is never
cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
#: Bytes of text at once where a worker's memory counts for more than few calls.
SMALL_SLICE = 1 << 19
U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20250101)).integers(1, 1 << 63, 256).astype(U) * U(2) + U(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U)
        self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, min(2 * len(self.up), SLICE + 1))
            up, down = np.full(size, _BASE & (2**64 - 1), dtype=U), np.full(size, _BASE_INV, dtype=U)
            up[0] = down[0] = 1
            with np.errstate(over="ignore"):
                self.up, self.down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


_kept: dict[object, object] = {}


def keep(key: object, make: Callable[[], object]) -> object:
    """A table that a Python worker keeps between tasks; it takes the place of any other."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what an operator before this one has kept in this worker."""
    _kept.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blobs(column: pa.Array) -> list[np.ndarray]:
    """uint64 views of the values of a binary column, without a copy of them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return [np.zeros(0, dtype=U)] * len(column)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return [np.frombuffer(data, dtype=U, count=(b - a) // 8, offset=a) for a, b in zip(offsets, offsets[1:], strict=False)]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts with at most ``most`` bytes, one text at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


@dataclass
class Words:
    """Words of some texts: byte ranges, 64-bit hashes, and first word of each text."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    """Words of the texts of one slice."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=U))
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = spans(data, start, end) if hashed else None
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), hashes)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from one running polynomial sum."""
    up, down = _POWERS.get(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
        return mix((total[end] - total[start]) * down[start])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n successive words."""
    if len(hashes) < n:
        return hashes[:0]
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            out = mix(out * U(0xD6E8FEB86659FD93)) + hashes[k : len(hashes) - n + 1 + k]
        return mix(out)
