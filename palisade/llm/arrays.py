"""Byte-level views of Arrow text columns, for operators that work on NumPy arrays inside tasks.

Texts are handled in slices of about SLICE bytes, so what a task holds beside its Arrow batch doesn't grow with a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: A random 64-bit value for each byte.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return free memory to the system, which Arrow's and the C library's allocators of an idle worker would hold on to."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what one has left behind is given back before the next."""
    for batch in batches:
        yield batch
        give_back()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def ranges(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``most`` bytes together; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mixed(a * _ODD + (b ^ (b >> np.uint64(29))) * _MIX_B)


#: Bytes whose words are hashed at once.
PIECE = 1 << 19
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, up to PIECE."""
    if not _powers:
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(PIECE, b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers


def words(data: np.ndarray, is_word: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the runs of bytes for which the table ``is_word`` holds; runs end at the sorted ``cuts``.

    Works through PIECE bytes at a time, and hashes runs over several pieces as others, so what is held beside ``data`` and the
    results doesn't grow.
    """
    none = np.zeros(0, np.int64)
    starts, stops, at_start, at_stop, inverse = [none], [none], [none.view(np.uint64)], [none.view(np.uint64)], [none.view(np.uint64)]
    up, down = powers()
    before, scale, unscale = np.zeros(1, np.uint64), 1, 1
    for lo in range(0, len(data), PIECE):
        part = data[lo : lo + PIECE]
        n = len(part)
        inside = is_word[part]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        begins[0] &= not (lo and is_word[data[lo - 1]])
        ends[-1] &= not (lo + n < len(data) and is_word[data[lo + n]])
        here = cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, lo + n)] - lo
        begins[here] = inside[here]
        last = cuts[np.searchsorted(cuts, lo, "right") : np.searchsorted(cuts, lo + n, "right")] - lo - 1
        ends[last] = inside[last]
        first, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[part] * up[:n], out=total[1:])
        factor = np.array([scale], np.uint64)
        starts.append(first + lo)
        stops.append(stop + lo)
        at_start.append(before + total[first] * factor)
        at_stop.append(before + total[stop] * factor)
        inverse.append(down[first] * np.array([unscale], np.uint64))
        before = before + total[-1:] * factor
        scale, unscale = scale * pow(_BASE, PIECE, 2**64) % 2**64, unscale * pow(_BASE, -PIECE, 2**64) % 2**64
    hashes = mixed((np.concatenate(at_stop) - np.concatenate(at_start)) * np.concatenate(inverse))
    return hashes, np.concatenate(starts), np.concatenate(stops)
