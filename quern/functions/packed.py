"""Packed integer keys with counts: sorting, netting and compact coding in numpy."""

from __future__ import annotations

import numpy as np


def varint(values: np.ndarray) -> bytes:
    """LEB128 of unsigned integers."""
    v = values.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(7, 64, 7):
        more = v >= np.uint64(1 << k)
        if not more.any():
            break
        n += more
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    at = ends - n
    for k in range(int(n.max()) if len(v) else 0):
        has = n > k
        byte = (v[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[has] + k] = byte.astype(np.uint8) | np.where(n[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = (raw[starts] & 127).astype(np.uint64)
    size = ends - starts + 1
    for k in range(1, int(size.max())):
        has = size > k
        out[has] |= (raw[starts[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def net(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with summed counts (all one if None), zeros dropped."""
    if counts is None:
        keys = np.sort(keys)
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return keys[start], np.diff(np.append(start, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    sums = np.add.reduceat(counts, start) if len(start) else counts[:0]
    return keys[start][sums != 0], sums[sums != 0]


def encode(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    zigzag = (counts << 1) ^ (counts >> 63)
    return varint(np.diff(keys, prepend=0)), b"" if (counts == 1).all() else varint(zigzag)


def decode(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.cumsum(unvarint(keys).astype(np.int64))
    if not counts:
        return k, np.ones(len(k), np.int64)
    z = unvarint(counts).astype(np.int64)
    return k, (z >> 1) ^ -(z & 1)
