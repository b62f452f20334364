"""Cleaning and rotating a date's cross section: chained imputation, isolation forests, orthogonal factors.

A group is one date, so its rows are the securities of one market.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.functions.columns import date


def _per_date(df: DataFrame, factors: list[str], change) -> DataFrame:
    """code, dt and the factors after ``change`` (matrix with NaN -> matrix) of each date's rows, by code."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("code").reset_index(drop=True)
        rows[factors] = change(rows[factors].to_numpy(float, na_value=np.nan))
        rows[factors] = rows[factors].astype(object).where(rows[factors].notna(), None)
        return rows

    schema = T.StructType([df.schema["code"], df.schema["dt"], *(T.StructField(f, T.DoubleType()) for f in factors)])
    return df.select("code", "dt", *(F.col(f).cast("double").alias(f) for f in factors)).groupBy("dt").applyInPandas(run, schema)


def impute_chained(df: DataFrame, factors: list[str], rounds: int = 10, penalty: float = 1e-3) -> DataFrame:
    """code, dt, factors: nulls start at the median, then each factor is regressed on the others in turn (ridge) and its nulls predicted.

    A factor with no value on a date stays null there; with fewer than five known values it keeps the median.
    """

    def change(x: np.ndarray) -> np.ndarray:
        gone = np.isnan(x)
        use = np.flatnonzero(~gone.all(axis=0))
        if not len(use) or not gone[:, use].any():
            return x
        y, m = x[:, use].copy(), gone[:, use]
        y[m] = np.broadcast_to(np.nanmedian(y, axis=0), y.shape)[m]
        mean, scale = y.mean(axis=0), y.std(axis=0)
        y = (y - mean) / np.where(scale > 0, scale, 1)
        for _ in range(rounds if len(use) > 1 else 0):
            before = y[m].copy()
            for j in np.flatnonzero(m.any(axis=0)):
                known = ~m[:, j]
                if known.sum() < 5:
                    continue
                a = np.column_stack([np.ones(len(y)), np.delete(y, j, axis=1)])
                gram = a[known].T @ a[known] + penalty * np.eye(a.shape[1])
                y[m[:, j], j] = a[m[:, j]] @ np.linalg.solve(gram, a[known].T @ y[known, j])
            if np.abs(y[m] - before).max() < 1e-6:
                break
        out = x.copy()
        filled = y * np.where(scale > 0, scale, 1) + mean
        out[:, use] = np.where(m, filled, x[:, use])
        return out

    return _per_date(df, factors, change)


def _depths(x: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
    """Depth at which each row of x is isolated by one tree grown on a sample of ``most`` rows."""
    sample = x[rng.choice(len(x), min(most, len(x)), replace=False)]
    limit = int(np.ceil(np.log2(max(len(sample), 2))))
    depth = np.zeros(len(x))
    todo = [(np.arange(len(x)), sample, 0)]
    while todo:
        rows, grown, d = todo.pop()
        spread = grown.max(axis=0) > grown.min(axis=0) if len(grown) else np.zeros(x.shape[1], bool)
        if d >= limit or len(grown) <= 1 or not spread.any() or not len(rows):
            depth[rows] = d + path_length(len(grown))
            continue
        j = rng.choice(np.flatnonzero(spread))
        cut = rng.uniform(grown[:, j].min(), grown[:, j].max())
        left, small = x[rows, j] < cut, grown[:, j] < cut
        todo += [(rows[left], grown[small], d + 1), (rows[~left], grown[~small], d + 1)]
    return depth


def path_length(n: int) -> float:
    """Mean depth of a failed search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def mask_isolated(df: DataFrame, factors: list[str], share: float = 0.05, trees: int = 100, most: int = 256, seed: int = 7) -> DataFrame:
    """code, dt, factors: the ``share`` of a date's rows that random trees isolate soonest become null.

    Rows with a null factor take no part and stay; dates of fewer than ten full rows stay as they are.
    """

    def change(x: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(~np.isnan(x).any(axis=1))
        gone = int(share * len(full))
        if len(full) < 10 or not gone:
            return x
        rng = np.random.default_rng(seed)
        depth = sum(_depths(x[full], rng, most) for _ in range(trees))
        out = x.copy()
        out[full[np.argsort(depth, kind="stable")[:gone]]] = np.nan
        return out

    return _per_date(df, factors, change)


def orthogonalize(df: DataFrame, factors: list[str]) -> DataFrame:
    """code, dt and factors, centred per date and each without its projection on the earlier ones (rows with all factors known).

    Modified Gram-Schmidt as sums over the date: every step shares one shuffle.
    """
    df = df.select("code", "dt", *(F.col(f).cast("double").alias(f) for f in factors)).dropna(subset=factors)
    df = df.withColumns({f: F.col(f) - F.avg(f).over(date()) for f in factors})
    for i, base in enumerate(factors):
        power = F.sum(F.col(base) * F.col(base)).over(date())
        slopes = {f: F.when(power > 1e-15, F.sum(F.col(f) * F.col(base)).over(date()) / power).otherwise(0.0) for f in factors[i + 1 :]}
        df = df.withColumns({f: F.col(f) - s * F.col(base) for f, s in slopes.items()}) if slopes else df
    return df


def independence(df: DataFrame, factors: list[str], least: int = 10) -> DataFrame:
    """dt, mean_corr, max_corr (absolute), mean_vif (mean diagonal of the inverse correlation matrix; null where singular)."""
    pairs = list(itertools.combinations(range(len(factors)), 2))
    k = len(factors)

    @F.pandas_udf(T.DoubleType())
    def mean_vif(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            r = np.eye(k)
            for (i, j), c in zip(pairs, v):
                r[i, j] = r[j, i] = np.nan if c is None else c
            good = np.isfinite(r).all() and np.linalg.det(r) > 1e-10
            out.append(float(np.diag(np.linalg.inv(r)).mean()) if good else None)
        return pd.Series(out, dtype=object)

    known = df.dropna(subset=factors)
    corr = known.groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.corr(factors[i], factors[j]) for i, j in pairs)).alias("c")).filter(F.col("n") >= least)
    size = F.transform("c", F.abs)
    total = F.aggregate(size, F.lit(0.0), lambda a, x: a + x)
    return corr.select("dt", (total / len(pairs)).alias("mean_corr"), F.array_max(size).alias("max_corr"), mean_vif("c").alias("mean_vif"))
