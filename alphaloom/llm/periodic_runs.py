"""Maximal periodic runs of words inside documents, by repeated k-gram masking and Main-Lorentz.

A run of period q and length L holds an overlap of L - q words that occurs twice in the document, q
words apart. With L >= max(shortest, exponent * q) that overlap has at least k words, so every word of
a run lies in a k-gram that its document repeats. Words outside such k-grams are masked, and only the
segments that survive are searched.

The search is Main and Lorentz's divide and conquer with all nodes of a level taken at once: a run lies
whole in the dyadic block around the highest dyadic point inside it, so that block's midpoint and every
period up to a share of the block are extended to the left and right. Extensions are exact: they
compare ranks of word sequences of lengths 1, 2, 4, ...

All work is inside a document, so nothing is shuffled. Memory follows the longest text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import giving_back, text_of
from .token_counts import slices

#: Text bytes whose words are searched together (a longer text is searched alone).
SLICE = 1_000_000


def shortest_overlap(shortest: int, exponent: int) -> int:
    """k: the least L - q of any run with L >= max(shortest, exponent * q)."""
    return min(max(shortest, exponent * q) - q for q in range(1, shortest + 2))


def surviving(codes: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Mask of the words that lie in a k-gram which its document holds twice.

    k-grams are told apart by a 64-bit hash: a collision only lets words survive that need not.
    """
    n, mask = len(codes), np.zeros(len(codes), bool)
    if n < k + 1:
        return mask
    gram = doc[: n - k + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(k):
            gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[j : n - k + 1 + j].astype(np.uint64)
        gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    again = np.zeros(len(gram), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    again &= doc[: n - k + 1] == doc[k - 1 :]
    for j in range(k):
        mask[j : n - k + 1 + j] |= again
    return mask


class Extensions:
    """Longest common extensions of pairs of positions, from ranks of sequences of 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray, longest: int):
        self.n, self.ranks = len(words), [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        while 2 << len(self.ranks) - 1 <= longest:
            half, last = 1 << len(self.ranks) - 1, self.ranks[-1]
            rank = np.unique(last[:-half] * self.n + last[half:], return_inverse=True)[1].astype(np.int64)
            if len(rank) == 0 or int(rank.max()) + 1 == len(rank):
                break  # no sequence of this length occurs twice
            self.ranks.append(rank)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on (a < b)."""
        a, b, start = a.copy(), b.copy(), b
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[level], 1 << level
            for _ in range(2 if level == len(self.ranks) - 1 else 1):
                inside = np.flatnonzero(b + size <= self.n)
                step = inside[rank[a[inside]] == rank[b[inside]]]
                a[step] += size
                b[step] += size
        return b - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b (a < b)."""
        a, b, start = a.copy(), b.copy(), a
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[level], 1 << level
            for _ in range(2 if level == len(self.ranks) - 1 else 1):
                inside = np.flatnonzero(a >= size)
                step = inside[rank[a[inside] - size] == rank[b[inside] - size]]
                a[step] -= size
                b[step] -= size
        return start - a


def maximal_runs(words: np.ndarray, room: np.ndarray, shortest: int, exponent: int) -> np.ndarray:
    """(runs, 3) of start, length and least period in a sequence of word codes.

    ``room`` is, for each position, the length of the segment that it lies in; segments are parted by
    codes that occur once.
    """
    n, found = len(words), [np.empty((0, 3), np.int64)]
    longest = int(room.max()) if n else 0
    if longest < shortest:
        return found[0]
    same = Extensions(words, longest)
    half, top = 1, False
    while not top:
        half *= 2
        top = 2 * half >= longest  # then every point of this level and above is a midpoint
        mids = np.arange(half, n, half if top else 2 * half)
        most = np.minimum(2 * half, room[mids]) // exponent
        mid = np.repeat(mids, most)
        period = np.arange(len(mid)) - np.repeat(np.cumsum(most) - most, most) + 1
        for a in (mid, mid - period):  # the equal words begin at or before the midpoint, or end before it
            ok = np.flatnonzero((a >= 0) & (a + period < n))
            a, p = a[ok], period[ok]
            right = words[a] == words[a + p]
            before = np.maximum(a - 1, 0)
            ok = right | ((a > 0) & (words[before] == words[before + p]))
            a, p = a[ok], p[ok]
            ahead, behind = same.forward(a, a + p), same.backward(a, a + p)
            length = ahead + behind + p
            ok = length >= np.maximum(shortest, exponent * p)
            found.append(np.column_stack([a - behind, length, p])[ok])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # the same stretch under a multiple of its period
    return runs[first]


def search(texts: list[list[bytes]], shortest: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of each text's words: the text's number and (start, length, period), by text, start, period."""
    code: dict[bytes, int] = defaultdict()
    code.default_factory = code.__len__
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.fromiter((code[w] for words in texts for w in words), np.int64, int(sizes.sum()))
    doc, begin = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    at = np.flatnonzero(surviving(codes, doc, shortest_overlap(shortest, exponent)))
    if not len(at):
        return np.empty(0, np.int64), np.empty((0, 3), np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])
    segment = np.cumsum(fresh) - 1
    place = np.arange(len(at)) + segment  # one separator after each segment
    n_segments = int(segment[-1]) + 1
    size = np.bincount(segment)
    words = np.empty(len(at) + n_segments, np.int64)
    words[place] = codes[at]
    ends = place[np.flatnonzero(np.append(fresh[1:], True))] + 1
    words[ends] = len(code) + np.arange(n_segments)
    room = np.zeros(len(words), np.int64)
    room[place] = size[segment]
    runs = maximal_runs(words, room, shortest, exponent)
    back = np.zeros(len(words), np.int64)
    back[place] = at
    start = back[runs[:, 0]]
    owner = doc[start]
    runs[:, 0] = start - begin[owner]
    order = np.lexsort((runs[:, 2], runs[:, 0], owner))
    return owner[order], runs[order]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside the repeats of runs: of a run its first period stays."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, shortest: int = 6, exponent: int = 4, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (array of start, length, period), collapsed (string).

    Words are maximal stretches without ``[\\x20\\x09-\\x0D]``. A run is a stretch of words with smallest
    period q and at least max(``shortest``, ``exponent`` * q) words that no neighbour extends; runs are
    ordered by start, then period. ``collapsed`` joins by one space the words that are in no run after
    its first q words. ``edit`` may rewrite a document's words first. Null, empty and blank texts
    have no words, no runs and an empty ``collapsed``. Each row is searched by itself, whatever its
    doc_id (null and repeated ones too); an empty table gives an empty result, and other columns are
    not read.
    """
    if exponent < 3:
        raise ValueError("exponent must be at least 3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                ids = b.column("doc_id").to_pylist()
                texts = [t.split() for t in b.column("text").cast(pa.binary()).to_pylist()]  # bytes split at the six ASCII blanks
                if edit is not None:
                    texts = [edit(i, words) for i, words in zip(ids, texts)]
                owner, runs = search(texts, shortest, exponent)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(runs[:, j], pa.int64()) for j in range(3)], fields=list(_RUN)))
                collapsed = [_collapsed(words, runs[a:z]) for words, a, z in zip(texts, cuts, cuts[1:])]
                sizes = pa.array([len(words) for words in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(giving_back(run), schema)
