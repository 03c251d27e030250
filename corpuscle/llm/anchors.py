"""Anchors: positions chosen by content alone, so that equal long strings have the same ones.

Of every `windows` consecutive grams the one with the least hash is chosen, the leftmost of equals.
A string of windows + gram - 1 symbols therefore holds an anchor at a place that its symbols alone
decide, wherever the string stands; strings that occur twice share it. Each such string has exactly
one anchor, and the starts of an anchor's strings are consecutive.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Low bits of a key that hold the position, and the starts that are handled at once.
_BITS = 24
_BLOCK = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """The 64-bit hash of each run of `gram` codes (uint64), by doubling."""
    if len(codes) < gram:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        done, done_size, offset = None, 0, 0
        now, size, power = codes, 1, _BASE
        rest = gram
        while rest:
            if rest & 1:
                part = now[offset:]
                if done is None:
                    done = part
                else:
                    m = min(len(done), len(part))
                    done = done[:m] * power + part[:m]
                offset += size
                done_size += size
            rest >>= 1
            if rest:
                m = len(now) - size
                now = now[:m] * power + now[size : size + m]
                power = power * power
                size *= 2
        return mixed(done[: len(codes) - gram + 1])


def select(hashes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first start, last start) of each anchor: the starts whose string it stands for."""
    starts = len(hashes) - windows + 1
    if starts <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    chosen = np.empty(starts, np.int64)
    low = np.uint64((1 << _BITS) - 1)
    for at in range(0, starts, _BLOCK):
        n = min(_BLOCK, starts - at)
        m = n + windows - 1
        rows = -(-m // windows)
        keys = np.full(rows * windows, np.iinfo(np.uint64).max, np.uint64)
        keys[:m] = (hashes[at : at + m] & ~low) | np.arange(m, dtype=np.uint64)
        table = keys.reshape(rows, windows)
        left = np.minimum.accumulate(table, axis=1).ravel()
        right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen[at : at + n] = (np.minimum(right[:n], left[windows - 1 : windows - 1 + n]) & low).astype(np.int64) + at
    edge = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
    first = np.concatenate(([0], edge))
    return chosen[first], first, np.concatenate((edge, [starts])) - 1


def merge_spans(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans, as disjoint spans that don't touch."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], first[1:] > end[:-1]))
    return first[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]
