"""Whole Arrow batches of text as numpy arrays: words, lines and hashes without a Python loop over characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are expanded to arrays at once; a longer single text is still taken whole.
SLICE_BYTES = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(0, 2**64, 1 << 16, dtype=np.uint64) | np.uint64(1)
_TURN = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)

#: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len + 1 offsets of a string column, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of True that stay within one row."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each run's bytes; with lower, A-Z counts as a-z. Runs past 65,536 bytes reuse the place values, so all bytes count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    place &= 0xFFFF
    value = (_BYTE_LOWER if lower else _BYTE)[data]
    value *= _PLACE[place]
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * _PLACE[7])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of every word [^\\x20\\x09-\\x0D]+."""
    inside = ~SPACE[data]
    starts, ends, rows = spans(inside, offsets)
    return hash_spans(data, inside, starts, ends, lower), starts, ends, rows


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words, none."""
    hashes, _, _, rows = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    whole = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k if len(whole) else 0):
        whole += hashes[i : i + len(whole)] * _TURN[i]
    whole = mix(whole)
    out = []
    for r in range(n):
        c, at = int(count[r]), int(first[r])
        if c >= k:
            out.append(np.unique(whole[at : at + c - k + 1]))
        elif c:
            out.append(mix(np.sum(hashes[at : at + c] * _TURN[:c], keepdims=True) + _TURN[40 + c]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
