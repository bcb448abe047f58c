"""Byte spans of words: comparing them, joining them, merging intervals."""

from __future__ import annotations

import numpy as np

from .shared import PIECE_BYTES


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[at : at + length] equals b[to : to + length], for each row; lengths are above 0."""
    out, ends, begin = np.ones(len(lengths), bool), np.cumsum(lengths), 0
    while begin < len(lengths):
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] - lengths[begin] + PIECE_BYTES, "right")))
        own = lengths[begin:stop]
        first = np.cumsum(own) - own
        step = np.arange(int(own.sum())) - np.repeat(first, own)
        unequal = a[np.repeat(at[begin:stop], own) + step] != b[np.repeat(to[begin:stop], own) + step]
        out[begin:stop] = ~np.logical_or.reduceat(unequal, first)
        begin = stop
    return out


def expanded(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each element, and the elements first, first + 1, ... of each row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(rows))


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of n rows (in order), joined by one space within a row: bytes and row offsets."""
    lengths = ends - starts
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    room = lengths + ~last
    at = np.cumsum(room) - room
    out = np.full(int(room.sum()), 32, np.uint8)
    for a in range(0, len(starts), 1 << 16):
        which, source = expanded(starts[a : a + (1 << 16)], lengths[a : a + (1 << 16)])
        out[np.repeat(at[a : a + (1 << 16)] - starts[a : a + (1 << 16)], lengths[a : a + (1 << 16)]) + source] = data[source]
    offsets = np.zeros(n + 1, np.int64)
    np.add.at(offsets, rows + 1, room)
    return out, np.cumsum(offsets)


def stretches(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of set flags; none crosses a bound."""
    inner = bounds[(bounds > 0) & (bounds < len(flags))]
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1]
    last[:-1] &= ~flags[1:]
    first[inner] = flags[inner]
    last[inner - 1] = flags[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def merged(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the intervals of each row, in order."""
    if not len(rows):
        return rows, starts, ends
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    # every row gets a stretch of one line
    room = int(ends.max()) + 2
    reach = np.maximum.accumulate(rows * room + ends)
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:] * room + starts[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(rows)) - 1
    return rows[new], starts[new], reach[last] - rows[new] * room
