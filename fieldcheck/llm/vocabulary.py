"""Public tokenizer files, and cutting texts where their byte-level pre-tokenizer cuts.

A pre-token ends before a space that has no white space on either side, and the next one starts with it: every
alternative of the pre-tokenizer's pattern takes a space only as its first character or within a run of white space.
So the pieces between such spaces are tokenized one by one as they are within the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .shingles import PLACE, mixed, text_buffer


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: UTF-8 of white space beyond ASCII: last bytes by the bytes before them.
_WIDE = {b"\xc2": (0x85, 0xA0), b"\xe1\x9a": (0x80,), b"\xe2\x80": (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), b"\xe2\x81": (0x9F,), b"\xe3\x80": (0x80,)}
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(9, 14), *range(28, 33)]] = True
_BYTES = [mixed(np.arange(seed, seed + 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for seed in (5001, 7001)]
#: Bytes whose hashes are computed at once, and bytes of text whose pieces are looked up at once.
_STEP, _AT_ONCE = 1 << 20, 1 << 23


def gathered(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.Table]:
    """The batches in tables of some megabytes of text each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= _AT_ONCE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at rows that aren't empty, and at spaces without white space on either side."""
    space = _ASCII_SPACE[data]
    before, after = space.copy(), space.copy()  # whether white space ends, or begins, at a byte
    for head, tails in _WIDE.items():
        at = np.flatnonzero(data[: max(0, len(data) - len(head))] == head[0])
        for k in range(1, len(head)):
            at = at[data[at + k] == head[k]]
        at = at[np.isin(data[at + len(head)], tails)]
        after[at] = True
        before[at + len(head)] = True
    starts = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        starts[1:-2] = (data[1:-1] == 32) & ~before[:-2] & ~after[2:]
    rows = np.zeros(len(data) + 1, bool)
    rows[offsets] = True
    starts[1:] &= ~rows[:-1]  # the first byte of a row has nothing before it
    starts[:-1] &= ~rows[1:]  # its last byte nothing behind it
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(starts)


def _distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position of each distinct piece, number of its distinct piece for every piece), by two 64-bit hashes."""
    hashes = [np.empty(len(starts), np.uint64) for _ in _BYTES]
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _STEP)))
        lo, hi = starts[at], starts[to] if to < len(starts) else len(data)
        own = starts[at:to] - lo
        place = np.arange(hi - lo) - np.repeat(own, np.diff(np.append(own, hi - lo)))
        weight = PLACE[place & 1023] + ((place >> 10) << 1).astype(np.uint64)
        for h, table in zip(hashes, _BYTES, strict=True):
            h[at:to] = np.add.reduceat(table[data[lo:hi]] * weight, own)
        at = to
    one, two = hashes
    _, first, inverse = np.unique(one, return_index=True, return_inverse=True)
    if (two != two[first][inverse]).any():  # equal first hashes of different pieces
        _, first, inverse = np.unique(np.column_stack(hashes), axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel()


def encode_column(column: pa.Array, encode: Callable[[list[bytes]], list[bytes]]) -> Iterator[np.ndarray]:
    """Ids (uint32) of every row. ``encode`` gives the ids of distinct pieces, as bytes; null counts as empty.

    Each distinct piece of some megabytes of text is looked up once, the rest is array work.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets = text_buffer(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _AT_ONCE, "right")) - 1)
        data, own = text_buffer(column.slice(at, to - at))
        data, own = data[own[0] : own[-1]], own - own[0]
        at = to
        starts = _piece_starts(data, own)
        if not len(starts):
            yield from (np.zeros(0, np.uint32) for _ in own[1:])
            continue
        first, inverse = _distinct(data, starts)
        ends, raw = np.append(starts[1:], len(data)), data.tobytes()
        found = encode([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        size = np.array([len(f) for f in found]) // 4
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(found), "<u4")
        counts = size[inverse]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(begin[inverse] - upto[:-1], counts) + np.arange(upto[-1])]
        edge = upto[np.searchsorted(starts, own)]
        yield from (ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True))
