"""Toxicity by a logistic model over hashed words and word beginnings with counterfactual regularisation.

Each labelled sentence that names a group is paired with the same sentences naming another group of
its row, once for every other term and every term swapped alike; the squared change of the score (log
odds) is penalised, so group terms by themselves carry no weight and neutral mentions stay clean. As
few labelled sentences may name a given group, the terms themselves, unlabelled, are pairs of the
penalty too. An L1 penalty keeps the weights of ordinary words at zero. Labels come from the labelled
documents alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back
from .features import buckets_of, fold, labelled_sample, words_of
from .token_counts import slices

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
DIM = 1 << 18
BEGINNINGS = (4, 5, 6, 7)  # code points
AT_ONCE, STEPS = 200, 30

#: Identity terms, swapped within a row (fixed values).
IDENTITIES = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "natives", "refugees", "foreigners"), ("old", "young"), ("deaf", "blind", "disabled"), ("frauen", "männer"), ("christen", "muslime", "juden"),
    ("ausländer", "deutsche", "türken", "polen"), ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("étrangers", "français", "arabes"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"), ("extranjeros", "españoles", "gitanos"),
)

MOST_TERMS = max(map(len, IDENTITIES))


def swaps() -> list[dict[str, str]]:
    """For each step, the term that lies as many places further in its row (a row shorter than the step ends)."""
    return [{t: row[(i + step) % len(row)] for row in IDENTITIES if step < len(row) for i, t in enumerate(row)} for step in range(1, MOST_TERMS)]


def grams_of(names: pa.Array) -> np.ndarray:
    """(names, 1 + BEGINNINGS) buckets: the word, and its beginnings where it is longer (else -1)."""
    columns = [buckets_of(names, DIM)]
    length = pc.utf8_length(names).to_numpy(zero_copy_only=False)
    for k in BEGINNINGS:
        start = pc.utf8_slice_codeunits(names, 0, k).dictionary_encode()
        bucket = buckets_of(start.dictionary, DIM, k)[start.indices.to_numpy()] if len(names) else columns[0]
        columns.append(np.where(length > k, bucket, -1))
    return np.column_stack(columns)


@dataclass
class ToxicityModel:
    bias: float
    weights: np.ndarray  # of DIM buckets, most of them 0

    def logits(self, texts: pa.Array) -> np.ndarray:
        """Each word and beginning of a text counts once."""
        out = np.full(len(texts), self.bias)
        row, code, names = words_of(texts)
        if len(row):
            grams = grams_of(names)
            weighs = (grams >= 0) & (self.weights[grams] != 0)
            at = np.flatnonzero(weighs.any(axis=1)[code])
            which = weighs[code[at]]
            pairs = np.unique((row[at].astype(np.int64)[:, None] * DIM + grams[code[at]])[which])
            out += np.bincount(pairs // DIM, self.weights[pairs % DIM], minlength=len(texts))
        return out


Sets = tuple[np.ndarray, list[np.ndarray]]


def _sets(texts: pa.Array) -> list[Sets]:
    """Of each text: its buckets, and those of each counterfactual (none where no group is named)."""
    row, code, names = words_of(texts)
    plain = names.to_pylist()
    here = grams_of(names)
    there = [(np.array([w in swap for w in plain], bool), grams_of(pa.array([swap.get(w, w) for w in plain], pa.string()))) for swap in swaps()]
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for c in (np.unique(code[a:z]) for a, z in zip(cuts, cuts[1:])):
        sets = [np.unique(g[c]) for g in (here, *(g for named, g in there if named[c].any()))]
        out.append((sets[0][sets[0] >= 0], [s[s >= 0] for s in sets[1:]]))
    return out


def term_pairs() -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of every two terms of a row."""
    out = []
    for row in IDENTITIES:
        grams = [g[g >= 0] for g in grams_of(pa.array(row))]
        out += list(itertools.combinations(grams, 2))
    return out


def fit(sets: list[Sets], y: np.ndarray, min_docs: int = 4, lasso: float = 3e-4, pull: float = 1.0) -> ToxicityModel:
    """Minimises log loss + pull * mean squared score change + lasso * |w|.

    The problem is convex, and nearly all weights are 0 at its solution: it is solved over few buckets,
    to which ``AT_ONCE`` of those are added whose slope exceeds the L1 penalty, steepest first, until
    there are none (or after ``STEPS`` times).
    """
    seen = np.bincount(np.concatenate([s for s, _ in sets]) if sets else np.empty(0, np.int64), minlength=DIM)
    pairs = [(s, t) for s, others in sets for t in others] + term_pairs()
    named = np.unique(np.concatenate([np.setxor1d(s, t) for s, t in pairs]))
    used = np.union1d(np.flatnonzero(seen >= min_docs), named).astype(np.int64)
    n, d = len(sets), len(used)
    weights, base = np.zeros(DIM), float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    bias = float(np.log(base / (1 - base)))
    if not n:
        return ToxicityModel(bias, weights)
    place = np.full(DIM, -1, np.int32)
    place[used] = np.arange(d)
    rows, cols = _incidence([place[s] for s, _ in sets])
    gain, g_cols = _incidence([place[np.setdiff1d(s, t)] for s, t in pairs])
    loss_, l_cols = _incidence([place[np.setdiff1d(t, s)] for s, t in pairs])
    pair, p_cols, sign = np.append(gain, loss_), np.append(g_cols, l_cols), np.append(np.ones(len(gain)), -np.ones(len(loss_)))
    w, active = np.zeros(d), np.zeros(d, bool)
    for _ in range(STEPS):
        off = _sigmoid(bias + np.bincount(rows, w[cols], minlength=n)) - y
        change = np.bincount(pair, sign * w[p_cols], minlength=len(pairs))
        slope = np.bincount(cols, off[rows], minlength=d) / n + 2 * pull / len(pairs) * np.bincount(p_cols, sign * change[pair], minlength=d)
        steep = np.where(active, 0, np.abs(slope))
        more = np.argsort(-steep, kind="stable")[:AT_ONCE]
        more = more[steep[more] > lasso * (1 + 1e-3)]
        if active.any() and not len(more):
            break
        active[more] = True
        at = np.flatnonzero(active)
        here = np.cumsum(active) - 1
        inside, p_inside = active[cols], active[p_cols]
        x = np.zeros((n, len(at)), np.float32)
        x[rows[inside], here[cols[inside]]] = 1
        z = np.zeros((len(pairs), len(at)), np.float32)
        np.add.at(z, (pair[p_inside], here[p_cols[p_inside]]), sign[p_inside])
        z = np.unique(z, axis=0, return_counts=True)  # pairs of equal change are one, weighed
        w[at], bias = _descend(x, z[0], z[1] / len(pairs), y, w[at], bias, lasso, pull)
        active = w != 0
    weights[used] = w
    return ToxicityModel(bias, weights)


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(set, member) of all members that are no -1."""
    rows = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    cols = np.concatenate(sets)
    return rows[cols >= 0], cols[cols >= 0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(x: np.ndarray, z: np.ndarray, share: np.ndarray, y: np.ndarray, w: np.ndarray, bias: float, lasso: float, pull: float, rounds: int = 200, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Proximal gradient (FISTA) over the given weights, until rounds hardly change the objective."""
    forward = lambda w, b: (b + x @ w.astype(np.float32), z @ w.astype(np.float32))
    objective = lambda w, s, c: np.mean(np.logaddexp(0, s) - y * s) + pull * (share * np.square(c)).sum() + lasso * np.abs(w).sum()
    at = ahead = (w, bias, *forward(w, bias))  # weights, bias, log odds, score changes; the last two are linear in the others
    best, t, still = objective(w, *at[2:]), 1.0, 0
    for _ in range(rounds):
        aw, ab, az, ac = ahead
        off = (_sigmoid(az) - y) / len(y)
        g = off.astype(np.float32) @ x + 2 * pull * ((share * ac).astype(np.float32) @ z)
        w = aw - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)
        b = ab - rate * off.sum()
        new = (w, b, *forward(w, b))
        now = objective(w, *new[2:])
        if not now <= best:  # overshot: drop the momentum, or without any, halve the step
            if t == 1 and rate < 1e-6:
                break
            rate, ahead, t = rate if t > 1 else rate / 2, at, 1.0
            continue
        still = still + 1 if best - now < 1e-7 * abs(best) else 0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = tuple(v + (t - 1) / t_new * (v - old) for v, old in zip(new, at))
        at, best, t = new, now, t_new
        if still == 5:
            break
    return at[0], float(at[1])


def train(docs: DataFrame, labels: DataFrame, most: int = 8000) -> ToxicityModel:
    """Fitted on at most ``most`` labelled documents outside the held-out fold (the bound of the sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 4_000_000):
                both = _sets(b.column("text"))
                here = pa.array([h.astype("<i4").tobytes() for h, _ in both], pa.binary())
                there = pa.array([[t.astype("<i4").tobytes() for t in others] for _, others in both], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y").cast(pa.int32()), here, there], ["doc_id", "y", "here", "there"])

    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, most)
    rows = sorted(sample.mapInArrow(giving_back(run), "doc_id long, y int, here binary, there array<binary>").collect(), key=lambda r: r["doc_id"])
    sets = [(np.frombuffer(r["here"], "<i4"), [np.frombuffer(t, "<i4") for t in r["there"]]) for r in rows]  # most name no group
    return fit(sets, np.array([r["y"] for r in rows], np.float64))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row of ``docs``: all its columns as struct ``row``, with score (0 to 1) and predicted (1 from a score of 0.3).

    Null and empty texts have the score of a text without known words. Repeated rows and null ids
    are scored row by row; an empty table gives an empty result; only the text is an input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 4_000_000):
                z = model.logits(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["row", "score"])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    docs = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(giving_back(run), docs.select("row").schema.add("score", "double"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns."""
    kept = score_toxicity(docs, model).filter("predicted = 0")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
