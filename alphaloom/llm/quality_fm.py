"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

The metadata is the table's n_chars: its size, whether it is missing and whether it fits the text. (The
other columns of documents are ruled out as inputs.)

score = sigmoid(b + <w, x> + sum over pairs of <v_i, v_j> x_i x_j); the pairwise sum is computed in
linear time as half of (sum of v x)^2 - sum of (v x)^2. It is fitted on a bounded labelled sample
whose features the executors compute; scoring runs over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import STRUCTURE, buckets_of, fold, labelled_sample, structure, words_of
from .token_counts import slices

FOLDS, HELD_OUT = 3, 1
ROWS = 256  # documents whose dense features are held at a time


#: Features after the word buckets: structure statistics, then metadata.
TAIL = STRUCTURE + 3


def _n_chars(docs: DataFrame) -> Column:
    """The table's n_chars, null where it has none."""
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long").alias("n_chars")


def metadata(texts: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """(rows, 3): size as declared, whether it is missing, whether it is the text's."""
    declared = n_chars.fill_null(0).to_numpy(zero_copy_only=False)
    missing = n_chars.is_null().to_numpy(zero_copy_only=False)
    length = pc.utf8_length(texts.fill_null("")).to_numpy(zero_copy_only=False)
    return np.column_stack([np.log1p(np.maximum(declared, 0)) / 10, missing, ~missing & (declared == length)])


def dense_features(texts: pa.Array, n_chars: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim + TAIL) float32: word buckets scaled to unit length, then structure and metadata."""
    row, code, names = words_of(texts)
    bucket = buckets_of(names, dim)[code] if len(code) else np.empty(0, np.int64)
    x = np.bincount(row * dim + bucket, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float32)
    np.sqrt(x, out=x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    return np.concatenate([x, structure(texts, row, code).astype(np.float32), metadata(texts, n_chars).astype(np.float32)], axis=1)


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, -TAIL:] = np.clip((x[:, -TAIL:] - self.mean) / self.scale, -4, 4)
        return x

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of standardised features, by the sum-of-squares identity."""
        return self.bias + x @ self.w + 0.5 * (np.square(x @ self.v) - np.square(x) @ np.square(self.v)).sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 12, rate: float = 0.05, ridge: float = 1e-4, seed: int = 3) -> FactorisationMachine:
    """AdaGrad on the log loss, each class weighted alike; deterministic."""
    r = np.random.default_rng(seed)
    tail = x[:, -TAIL:].astype(np.float64)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    fm = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(x.shape[1]), r.normal(0, 0.01, (x.shape[1], factors)), tail.mean(axis=0) if len(y) else np.zeros(TAIL), tail.std(axis=0) + 1e-3 if len(y) else np.ones(TAIL))
    gw, gv, gb = np.full(fm.w.shape, 1e-4), np.full(fm.v.shape, 1e-4), 1e-4
    for _ in range(epochs):
        for part in np.array_split(r.permutation(len(y)), max(1, len(y) // 64)):
            if not len(part):
                continue
            b = fm.standard(x[part]).astype(np.float64)
            off = (1 / (1 + np.exp(-np.clip(fm.logits(b), -30, 30))) - y[part]) / len(part)
            bv = b @ fm.v
            dw = b.T @ off + ridge * fm.w
            dv = b.T @ (off[:, None] * bv) - (np.square(b).T @ off)[:, None] * fm.v + ridge * fm.v
            gw += dw * dw
            gv += dv * dv
            gb += off.sum() ** 2
            fm.w -= rate * dw / np.sqrt(gw)
            fm.v -= rate * dv / np.sqrt(gv)
            fm.bias -= rate * off.sum() / np.sqrt(gb)
    return fm


def train(docs: DataFrame, labels: DataFrame, dim: int = 4096, most: int = 4000) -> FactorisationMachine:
    """Fitted on at most ``most`` labelled documents outside the held-out fold (the bound of the sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                x = dense_features(part.column("text"), part.column("n_chars"), dim)
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y").cast(pa.int32()), pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(x, at)], pa.binary())], ["doc_id", "y", "at", "x"])

    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, most, [_n_chars(docs)])
    rows = sorted(sample.mapInArrow(run, "doc_id long, y int, at binary, x binary").collect(), key=lambda r: r["doc_id"])
    x = np.zeros((len(rows), dim + TAIL), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["x"], np.float32)
    return fit(x, np.array([r["y"] for r in rows], np.float64))


def score_quality(docs: DataFrame, model: FactorisationMachine, dim: int = 4096) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from a score of 0.5).

    Null and empty texts have no words and are scored by their structure like any other. Repeated
    rows and null ids are scored row by row; empty tables give empty results; only doc_id, text and
    n_chars (which may be null or absent) are read, and doc_id is no input of the score. A model fitted on no rows scores 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in slices(whole, "text", 4_000_000):
                for i in range(0, s.num_rows, ROWS):
                    b = s.slice(i, ROWS)
                    z = model.logits(model.standard(dense_features(b.column("text"), b.column("n_chars"), dim)))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _n_chars(docs)).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
