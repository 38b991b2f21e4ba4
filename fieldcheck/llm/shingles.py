"""Word shingles of whole texts as 64-bit hashes, many documents at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Separators are space and the control characters 9 to 13; A-Z count as a-z.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_PIECE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTER[65:91] = _LETTER[97:123]
PLACE = mixed(np.arange(1001, 2025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the column, and the position of each row's first word (one more at the end)."""
    data, offsets = text_buffer(column)
    low, high = int(offsets[0]), int(offsets[-1])
    data, offsets = data[low:high], offsets - low
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    apart = _SEPARATOR[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = ~apart
    begins[1:] &= apart[:-1] | first[1:n]
    starts = np.flatnonzero(begins)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _PIECE)))
        lo, hi = starts[at], starts[to] if to < len(starts) else n
        own = starts[at:to] - lo
        place = np.arange(hi - lo) - np.repeat(own, np.diff(np.append(own, hi - lo)))
        value = _LETTER[data[lo:hi]] * (PLACE[place & 1023] + ((place >> 10) << 1).astype(np.uint64))
        value[apart[lo:hi]] = 0
        hashes[at:to] = np.add.reduceat(value, own)
        at = to
    return mixed(hashes), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Per row the sorted distinct shingles of ``words`` words; of fewer words, the whole sequence as one."""
    h, begin = word_hashes(column)
    long = h[: max(0, len(h) - words + 1)].copy()
    for k in range(1, words):
        long = mixed(long * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(long)])
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(long[a : b - words + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = mixed(one * np.uint64(0xD6E8FEB86659FD93) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
