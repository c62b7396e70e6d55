"""Runs of bytes and their CRC-32, for all rows of a batch at once."""

from __future__ import annotations

import zlib

import numpy as np

#: CRC-32 of the bytes of longer runs is left to zlib, run by run.
LONG = 64


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


TABLE = _table()


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last+1 byte of each maximal run of bytes that are inside, and each row's first run (one more at the end)."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    return first, last, np.searchsorted(first, at)


def crc_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray, before: np.ndarray | int = 0) -> np.ndarray:
    """The unsigned CRC-32 of each span; `before` is that of the bytes which stand before the span."""
    size = last - first
    state = np.full(len(first), before, np.uint32) if np.isscalar(before) else before.astype(np.uint32)
    state = ~state
    order = np.argsort(-size, kind="stable")
    size, start, s = size[order], first[order], state[order]
    longer = int(np.searchsorted(-size, -LONG, "left"))  # these have more than LONG bytes
    for k in range(longer):
        s[k] = ~np.uint32(zlib.crc32(data[start[k] : start[k] + size[k]].tobytes(), int(~s[k])))
    ends = np.searchsorted(-size, -np.arange(LONG + 1), "left")  # how many have more than k bytes
    for k in range(LONG):
        m = int(ends[k])
        if m <= longer:
            break
        part = s[longer:m]
        s[longer:m] = TABLE[(part ^ data[start[longer:m] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty(len(s), np.uint32)
    out[order] = ~s
    return out
