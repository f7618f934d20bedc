"""Suffix arrays in numpy: Larsson-Sadakane refinement, and common prefixes by Kasai's inequality."""

from __future__ import annotations

import numpy as np


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; zeros beyond the end."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        padded[: len(padded) - step] = (padded[: len(padded) - step] << np.uint64(shift)) | padded[step:]
    return padded[:n]


def suffix_array(data: np.ndarray, heads: np.ndarray | None = None) -> np.ndarray:
    """Positions of all suffixes of a byte array in ascending order.

    The first sort is by eight bytes.  Then, as Larsson and Sadakane have it, only groups of suffixes
    that still tie are sorted again, by the group of the suffix that starts h bytes later, and h doubles.
    """
    n = len(data)
    heads = words8(data) if heads is None else heads
    order = np.argsort(heads, kind="stable").astype(np.int64)
    firsts = np.ones(n, bool)
    firsts[1:] = heads[order[1:]] != heads[order[:-1]]
    group = np.maximum.accumulate(np.where(firsts, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    lasts = np.ones(n, bool)
    lasts[:-1] = firsts[1:]
    open_at = np.flatnonzero(~(firsts & lasts))
    h = 8
    while len(open_at):
        suffix = order[open_at]
        later = suffix + h
        # Suffixes that end within h bytes are smaller than the others, and the shorter the smaller.
        follow = np.where(later < n, rank[np.minimum(later, n - 1)] + n + 1, n - suffix)
        key = (rank[suffix].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[open_at] = suffix
        firsts = np.ones(len(key), bool)
        firsts[1:] = key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(firsts, np.arange(len(key)), 0))
        rank[suffix] = open_at[start]
        lasts = np.ones(len(key), bool)
        lasts[:-1] = firsts[1:]
        open_at = open_at[~(firsts & lasts)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, heads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the suffix before it in order (-1: none) and the bytes they share.

    Kasai's inequality: where both suffixes follow the same byte, the position before has the same
    neighbours one byte earlier, so the length is that one's less one.  Only the other positions are compared.
    """
    n = len(data)
    heads = words8(data) if heads is None else heads
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = np.zeros(n, bool)
    inner = np.flatnonzero((before > 0) & (at > 0))
    follows[inner] = (data[inner - 1] == data[before[inner] - 1]) & (before[inner - 1] >= 0)
    shared = np.zeros(n, np.int64)
    a = np.flatnonzero(~follows & (before >= 0))
    b, limit = before[a], n - np.maximum(a, before[a])
    length, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        live = live[length[live] < limit[live]]
        same = heads[a[live] + length[live]] == heads[b[live] + length[live]]
        done = live[~same]
        if len(done):
            differ = heads[a[done] + length[done]] ^ heads[b[done] + length[done]]
            for byte in range(7):
                length[done] += (differ >> np.uint64(56 - 8 * byte)) == 0
        live = live[same]
        length[live] += 8
    shared[a] = np.minimum(length, limit)
    start = np.maximum.accumulate(np.where(follows, -1, at))
    return before, np.where(before >= 0, shared[start] - (at - start), 0)
