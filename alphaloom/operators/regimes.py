"""Market regimes by a hidden Markov model with normal emissions, one series a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _pass(x: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each step's state, expected moves, and log likelihood (scaled forward and backward sums)."""
    density = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
    n, k = density.shape
    ahead, scale, back = np.empty((n, k)), np.empty(n), np.ones((n, k))
    for t in range(n):
        a = (start if t == 0 else ahead[t - 1] @ move) * density[t]
        scale[t] = a.sum()
        ahead[t] = a / scale[t]
    for t in range(n - 2, -1, -1):
        back[t] = move @ (density[t + 1] * back[t + 1]) / scale[t + 1]
    moves = move * (ahead[:-1].T @ (density[1:] * back[1:] / scale[1:, None]))
    return ahead * back, moves, float(np.log(scale).sum())


def fit_regimes(x: np.ndarray, k: int = 3, rounds: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Filtered state probabilities (n, k) and state means, states by ascending mean.

    Expectation maximisation from k equal slices of the sorted values; the probabilities are
    filtered, so a date's state uses nothing later than the fitted parameters do.
    """
    slices = np.array_split(np.sort(x), k)
    floor = max(x.var() * 1e-3, 1e-12)
    mean, var = np.array([s.mean() for s in slices]), np.array([max(s.var(), floor) for s in slices])
    start, move, before = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)), -np.inf
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    for _ in range(rounds):
        post, moves, fit = _pass(x, start, move, mean, var)
        if fit - before < tolerance * abs(fit):
            break
        before, weight = fit, post.sum(axis=0) + 1e-12
        mean = (post * x[:, None]).sum(axis=0) / weight
        var = np.maximum((post * (x[:, None] - mean) ** 2).sum(axis=0) / weight, floor)
        start, move = post[0] / post[0].sum(), (moves + 1e-6) / (moves + 1e-6).sum(axis=1, keepdims=True)
    order = np.argsort(mean, kind="stable")
    density = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
    out, p = np.empty_like(density), start
    for t in range(len(x)):
        p = (start if t == 0 else p @ move) * density[t]
        p = p / p.sum()
        out[t] = p
    return out[:, order], mean[order]


def hidden_regimes(df: DataFrame, value: str, key: str = "code", k: int = 3, least: int = 60) -> DataFrame:
    """key, dt, state (0: lowest mean), p_state: the likeliest state of each known value's date.

    Null values are left out; series of fewer than ``least`` values have a null state.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt").reset_index(drop=True)
        if len(rows) < least:
            return rows.assign(state=None, p_state=None).drop(columns="x")
        p, _ = fit_regimes(rows["x"].to_numpy(float), k)
        return rows.assign(state=p.argmax(axis=1), p_state=p.max(axis=1)).drop(columns="x")

    schema = T.StructType([df.schema[key], df.schema["dt"], T.StructField("state", T.IntegerType()), T.StructField("p_state", T.DoubleType())])
    return df.select(key, "dt", F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)").groupBy(key).applyInPandas(run, schema)
