"""Gray-order hierarchical index over 64-bit fingerprints, and the links it finds within k bits.

Fingerprints of a bucket are sorted by Gray rank, so neighbours share most bits. A node stands for a
run of the sorted list and knows its masked pattern: the bits that all its members share, factored
out once (bitwise and / or over the run). Pairs of nodes are followed from the top: the differences
inside the masks common to both can only grow further down, so a pair beyond k is pruned with all
its members, and a pair whose remaining free bits cannot exceed k is accepted with all its members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np

WIDTH = 64
#: Node pairs that are expanded at a time.
FRONTIER = 500_000


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the Gray sequence."""
    out = x.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def routing_masks(n: int, k: int, per_bucket: int = 256) -> list[int]:
    """Masks of which any two fingerprints within k bits agree on one at least.

    The word is cut into b blocks; k differences leave b - k of them equal. b is the smallest from
    k + 1 with which ``n`` spread fingerprints are at most ``per_bucket`` to a bucket.
    """
    for b in range(k + 1, k + 5):
        if n / 2 ** (WIDTH * (b - k) / b) <= per_bucket:
            break
    cuts = [WIDTH * i // b for i in range(b + 1)]
    blocks = [((1 << (z - a)) - 1) << a for a, z in zip(cuts, cuts[1:])]
    return [sum(c) for c in itertools.combinations(blocks, b - k)]


class GrayIndex:
    """The hierarchy over buckets of fingerprints that lie side by side, each in Gray order."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), bucket))
        self.order, self.fp = order, fp[order].astype(np.uint64)
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        self.lo = np.concatenate([[0], cuts]).astype(np.int64)
        self.hi = np.concatenate([cuts, [len(fp)]]).astype(np.int64)
        self.ands, self.ors = [self.fp], [self.fp]
        step, most = 1, int((self.hi - self.lo).max()) if len(fp) else 0
        while 2 * step <= most:
            a, o = self.ands[-1], self.ors[-1]
            self.ands.append(a[:-step] & a[step:])
            self.ors.append(o[:-step] | o[step:])
            step *= 2

    def patterns(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each run: the bits that its members share, and their values."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        value, union = np.empty(len(lo), np.uint64), np.empty(len(lo), np.uint64)
        for n in np.unique(level):
            m = level == n
            a, z = lo[m], hi[m] - (1 << int(n))
            value[m] = self.ands[n][a] & self.ands[n][z]
            union[m] = self.ors[n][a] | self.ors[n][z]
        return ~(value ^ union), value

    def links(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs that connect, within each bucket, whatever is linked (not all linked pairs)."""
        big = self.hi - self.lo > 1
        lo, hi = self.lo[big], self.hi[big]
        stack = [(lo, hi, lo, hi)] if len(lo) else []
        while stack:
            part = stack.pop()
            if len(part[0]) > FRONTIER:
                stack.append(tuple(x[FRONTIER:] for x in part))
                part = tuple(x[:FRONTIER] for x in part)
            a, b, c, d = part
            m1, v1 = self.patterns(a, b)
            m2, v2 = self.patterns(c, d)
            mask = m1 & m2
            least = np.bitwise_count((v1 ^ v2) & mask)
            most = least + np.bitwise_count(~mask)
            whole = most <= k
            if whole.any():  # every member of one run is linked with every member of the other
                yield from self._stars(*(x[whole] for x in part))
            go = (least <= k) & ~whole
            a, b, c, d = (x[go] for x in part)
            same = a == c
            s, t = a[same], b[same]
            mid = (s + t) // 2
            first, second = (s, mid), (mid, t)
            new = [[*first, *first], [*second, *second], [*first, *second]]
            a, b, c, d = (x[~same] for x in (a, b, c, d))
            left = b - a >= d - c
            p, q, r, u = a[left], b[left], c[left], d[left]
            mid = (p + q) // 2
            new += [[p, mid, r, u], [mid, q, r, u]]
            p, q, r, u = a[~left], b[~left], c[~left], d[~left]
            mid = (r + u) // 2
            new += [[p, q, r, mid], [p, q, mid, u]]
            children = tuple(np.concatenate([x[i] for x in new]) for i in range(4))
            alone = (children[0] == children[2]) & (children[1] - children[0] == 1)
            children = tuple(x[~alone] for x in children)
            if len(children[0]):
                stack.append(children)

    @staticmethod
    def _stars(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for hub, lo, hi in ((a, c, d), (c, a, b)):
            size = hi - lo
            if size.sum():
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                yield np.repeat(hub, size), np.repeat(lo, size) + at


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each entry the smallest member known of its set) after joining the sets of i and j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def spanning_links(bucket: np.ndarray, fp: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smaller place's fingerprint), fewer than there are fingerprints, that connect what lies within k bits in a bucket."""
    index = GrayIndex(bucket, fp)
    label = np.arange(len(fp))
    for i, j in index.links(k):
        label = join_labels(label, i, j)
    child = np.flatnonzero(label != np.arange(len(fp)))
    return index.fp[child], index.fp[label[child]]
