"""Enhanced suffix arrays of a batch of byte strings, and their common-prefix interval tree.

The array orders all suffixes of all strings, each ending at its own string's end. Ranks of prefixes of
7, 21, 63, ... bytes order the suffixes and later yield exact common prefixes of neighbours. A stack
scan over those gives the intervals of the tree; an interval is a maximal repeat if the bytes to the
left of its suffixes differ (a string's start differs from everything).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SYMBOLS = 7  # of 9 bits in one key; 0 is the end of a string


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and dense ranks (from 1) of keys."""
    order = np.argsort(key)
    fresh = np.ones(len(key), bool)
    held = key[order]
    fresh[1:] = held[1:] != held[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(fresh)
    return order, rank


class SuffixArray:
    """``order`` lists suffix positions in the joined strings; ``rest`` has the bytes from each position to its string's end."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(strings), np.uint8)
        n = len(self.raw)
        self.owner = np.repeat(np.arange(len(strings)), self.sizes)
        self.rest = (self.begins + self.sizes)[self.owner] - np.arange(n)
        symbol = self.raw.astype(np.int64) + 1
        key = symbol
        for j in range(1, _SYMBOLS):
            nxt = np.zeros(n, np.int64)
            nxt[: max(n - j, 0)] = symbol[j:]
            nxt[self.rest <= j] = 0
            key = key << 9 | nxt
        self.order, rank = _ranks(key)
        self.depths, self.ranks = [_SYMBOLS], [rank]
        longest = int(self.sizes.max()) if len(self.sizes) else 0
        fan = 3 if n < (1 << 21) - 1 else 2
        while self.depths[-1] < longest and int(rank.max()) < n:
            depth, key = self.depths[-1], rank
            for j in range(1, fan):
                key = key * (n + 1) + self._at(rank, np.arange(n), j * depth)
            self.order, rank = _ranks(key)
            self.depths.append(depth * fan)
            self.ranks.append(rank)
        self.fan = fan

    def _at(self, rank: np.ndarray, place: np.ndarray, ahead: int | np.ndarray) -> np.ndarray:
        """Ranks some bytes ahead of places, 0 beyond their string's end."""
        out = np.zeros(len(place), np.int64)
        inside = np.flatnonzero(self.rest[place] > ahead)
        out[inside] = rank[place[inside] + (ahead if np.isscalar(ahead) else ahead[inside])]
        return out

    def common(self, least: int) -> np.ndarray:
        """Common prefix of each suffix in the order with the one before it, 0 where it has under ``least`` bytes."""
        out = np.zeros(len(self.order), np.int64)
        k = np.arange(1, len(self.order))
        k = k[(self.rest[self.order[1:]] >= least) & (self.rest[self.order[:-1]] >= least)]
        for depth, rank in zip(self.depths, self.ranks):
            if depth <= least:
                k = k[rank[self.order[k]] == rank[self.order[k - 1]]]
        a, b = self.order[k - 1], self.order[k]
        most, done = np.minimum(self.rest[a], self.rest[b]), np.zeros(len(k), np.int64)
        for depth, rank in zip(self.depths[::-1], self.ranks[::-1]):
            for _ in range(self.fan):
                live = np.flatnonzero((done < most) & (self._at(rank, a, done) == self._at(rank, b, done)))
                done[live] += depth
        for _ in range(_SYMBOLS - 1):
            live = np.flatnonzero(done < most)
            live = live[self.raw[a[live] + done[live]] == self.raw[b[live] + done[live]]]
            done[live] += 1
        done = np.minimum(done, most)
        out[k[done >= least]] = done[done >= least]
        return out


@dataclass
class Repeats:
    """Maximal repeats of at least ``least`` bytes.

    ``nodes`` has (length, first, last, parent) of each: its occurrences are the suffixes order[first..last], all
    of them, and ``parent`` is the number of the node around it (-1: none). ``deepest`` is the number of the
    innermost node at each position (-1: none), and ``reach`` that node's length (0: none).
    ``alone`` marks the positions of windows of ``least`` bytes that occur once; ``shared`` has one position of
    each window that occurs more often.
    """

    array: SuffixArray
    nodes: list[tuple[int, int, int, int]]
    deepest: np.ndarray
    reach: np.ndarray
    alone: np.ndarray
    shared: np.ndarray


def maximal_repeats(strings: list[bytes], least: int) -> Repeats:
    """The tree's left-diverse intervals at depth ``least`` or more."""
    sa = SuffixArray(strings)
    order, n = sa.order, len(sa.order)
    lcp = sa.common(least)
    left = np.where(order == sa.begins[sa.owner[order]], -1 - sa.owner[order], sa.raw[np.maximum(order - 1, 0)].astype(np.int64)) if n else np.empty(0, np.int64)
    changes = np.zeros(n, np.int64)
    if n:
        changes[1:] = np.cumsum(left[1:] != left[:-1])
    linked = lcp >= least
    first = np.flatnonzero(~linked & np.append(linked[1:], False)) if n else np.empty(0, np.int64)
    last = np.flatnonzero(linked & ~np.append(linked[1:], False)) if n else np.empty(0, np.int64)
    nodes: list[tuple[int, int, int, int]] = []
    inner = np.full(n, -1, np.int64)
    diverse = changes[last] > changes[first]
    for a, z in zip(first[diverse].tolist(), last[diverse].tolist()):
        found, stack = [], []  # a repeat without left diversity in its whole interval has none in any part
        for k, depth in enumerate([*lcp[a + 1 : z + 1].tolist(), 0], a + 1):
            begin = k - 1
            while stack and stack[-1][0] > depth:
                size, begin = stack.pop()
                if changes[k - 1] > changes[begin]:
                    found.append((size, begin, k - 1))
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, begin))
        for size, begin, end in reversed(found):  # an interval comes after those inside it
            parent = int(inner[begin])
            inner[begin : end + 1] = len(nodes)
            nodes.append((size, begin, end, parent))
    deepest = np.empty(n, np.int64)
    deepest[order] = inner
    reach = np.array([x[0] for x in nodes] + [0], np.int64)[deepest]
    member = linked | np.append(linked[1:], False) if n else linked
    alone = np.zeros(n, bool)
    alone[order[~member]] = True
    alone &= sa.rest >= least
    return Repeats(sa, nodes, deepest, reach, alone, order[first])
