"""Greedy string tiling of two word sequences with running Karp-Rabin hashes."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

#: Fixed values of the rolling hash: an odd base, arithmetic modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


class Rolling:
    """Hashes of all windows of any length of one sequence, by prefix sums."""

    def __init__(self, ids: np.ndarray, power: np.ndarray):
        self.power, self.n = power, len(ids)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power[:len(ids)], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        if length > self.n:
            return np.zeros(0, np.uint64)
        starts = self.n - length + 1
        return (self.sums[length:] - self.sums[:-length]) * self.power[len(self.power) - 1 - np.arange(starts)]


def _open_windows(marked: np.ndarray, length: int) -> np.ndarray:
    if length > len(marked):
        return np.zeros(0, bool)
    taken = np.concatenate(([0], np.cumsum(marked)))
    return taken[length:] == taken[:-length]


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (pattern start, text start, length) of at least ``least`` words. The longest
    match of unmarked words is marked first, again and again; ids below 1 in
    ``text`` are breaks that match nothing. The search length starts at the
    longest possible and halves down to ``least``; a match longer than twice
    the search length restarts the search there."""
    n, m = len(pattern), len(text)
    if min(n, m) < least or least < 1:
        return []
    power = powers(max(n, m) + 1)
    roll_p, roll_t = Rolling(pattern, power), Rolling(text, power)
    done_p, done_t = pattern < 1, text < 1
    tiles: list[tuple[int, int, int]] = []
    search = max(least, min(n, m))
    while True:
        matches = _matches(pattern, text, roll_p, roll_t, done_p, done_t, search)
        longest = -matches[0][0] if matches else 0
        if longest > 2 * search:
            search = longest
            continue
        while matches:
            length, t, p = heappop(matches)
            length = -length
            free = ~(done_p[p:p + length] | done_t[t:t + length])
            if free.all():
                done_p[p:p + length] = True
                done_t[t:t + length] = True
                tiles.append((p, t, length))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= search:  # what earlier tiles have left of this match
                    heappush(matches, (a - b, t + a, p + a))
        if search > 2 * least:
            search //= 2
        elif search > least:
            search = least
        else:
            return sorted(tiles)


def _matches(pattern, text, roll_p, roll_t, done_p, done_t, search) -> list[tuple[int, int, int]]:
    """A heap of (-length, text start, pattern start) of the maximal matches of at least ``search`` unmarked words."""
    open_p, open_t = _open_windows(done_p, search), _open_windows(done_t, search)
    at_p, at_t = np.flatnonzero(open_p), np.flatnonzero(open_t)
    if not len(at_p) or not len(at_t):
        return []
    hash_p, hash_t = roll_p.windows(search)[at_p], roll_t.windows(search)[at_t]
    by_hash: dict[int, list[int]] = {}
    for h, p in zip(hash_p.tolist(), at_p.tolist()):
        by_hash.setdefault(h, []).append(p)
    hits = np.isin(hash_t, hash_p)
    n, m, out = len(pattern), len(text), []
    for h, t in zip(hash_t[hits].tolist(), at_t[hits].tolist()):
        for p in by_hash[h]:
            if p and t and not done_p[p - 1] and not done_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # the match starts further left
            room = min(n - p, m - t)
            same = (pattern[p:p + room] == text[t:t + room]) & ~done_p[p:p + room] & ~done_t[t:t + room]
            length = room if same.all() else int(same.argmin())
            if length >= search:  # equal hashes of unequal words end here
                out.append((-length, t, p))
    heapify(out)
    return out
