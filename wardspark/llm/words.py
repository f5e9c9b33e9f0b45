"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than space and tab to carriage return; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_NEAR = mix(np.arange(1 << 14, dtype=np.uint64))
_STEPS = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value begins (one more entry than values); nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and at which word each text begins (one more entry than texts); A-Z stay unless ``fold``."""
    data, offsets = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins, at = starts_of(solid, offsets)
    return hashed(data, solid, begins, at, fold), np.searchsorted(at, offsets)


def starts_of(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``solid`` bytes begin, none of which reaches across the start of a text: as a mask and as places."""
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(solid)]
    begins[edges] = solid[edges]
    return begins, np.flatnonzero(begins)


def hashed(data: np.ndarray, solid: np.ndarray, begins: np.ndarray, at: np.ndarray, fold: bool) -> np.ndarray:
    """The hash of each word that begins ``at``."""
    if not len(at):
        return np.zeros(0, np.uint64)
    low = (np.where((data >= 65) & (data <= 90), data | 32, data) if fold else data)[solid]
    ids = np.cumsum(begins)[solid] - 1  # the word of each byte
    place = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    index = ((np.arange(len(low)) - place[ids]) << 8) | low
    far = index >= len(_NEAR)
    value = _NEAR[np.where(far, 0, index)]
    if far.any():
        value[far] = mix(index[far].astype(np.uint64))
    return mix(np.add.reduceat(value, place))


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Of each text: the sorted distinct hashes of ``width`` words in a row; shorter texts are one shingle, empty ones none."""
    hashes, firsts = words(column)
    counts = np.diff(firsts)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(width):
            mixed += hashes[k : k + n] * _STEPS[k]
        mixed = mix(mixed)
    else:
        mixed = np.zeros(0, np.uint64)
    out = []
    for first, count in zip(firsts[:-1].tolist(), counts.tolist(), strict=True):
        if count >= width:
            out.append(np.unique(mixed[first : first + count - width + 1]))
        elif count:
            out.append(mix(np.array([(hashes[first : first + count] * _STEPS[:count]).sum(dtype=np.uint64) + np.uint64(count)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
