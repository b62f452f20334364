"""Tail risk per series, structured covariances of few series, and the optimisers on them."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import pct_change

from .portfolio import capped_simplex

Z95 = NormalDist().inv_cdf(0.05)


def value_at_risk(df: DataFrame, confidence: float = 0.95, spread: float = 0.0, participation: float = 0.0) -> DataFrame:
    """Per code, losses as positive numbers: historical, normal, mean beyond the historical, and the historical with costs of leaving."""
    z = NormalDist().inv_cdf(1 - confidence)
    df = df.withColumn("ret", pct_change("close"))
    df = df.join(df.groupBy("code").agg(F.percentile("ret", 1 - confidence).alias("_q")), "code")
    out = df.groupBy("code").agg(
        F.count("ret").alias("n"), (-F.first("_q")).alias("historical"), (-(F.avg("ret") + z * F.stddev_samp("ret"))).alias("parametric"), (-F.avg(F.when(F.col("ret") <= F.col("_q"), F.col("ret")))).alias("conditional"),
    )
    return out.withColumn("liquidity", F.col("historical") + 0.5 * spread + 0.1 * participation**0.5)


def tail_dependence(df: DataFrame, key: str, value: str, tail: float = 0.1) -> DataFrame:
    """a, b (a < b), n, lower, upper: how often b is in its tail when a is in its own. Keys are few (industries, factors)."""
    u = F.percent_rank().over(W.partitionBy(key).orderBy(value))
    x = df.filter(F.col(value).isNotNull()).select("dt", F.col(key).alias("a"), u.alias("u"))
    y = x.select("dt", F.col("a").alias("b"), F.col("u").alias("v"))
    share = lambda both, one: F.try_divide(F.sum(both.cast("int")), F.sum(one.cast("int")))
    low, high = F.col("u") <= tail, F.col("u") >= 1 - tail
    return x.join(y, "dt").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), share(low & (F.col("v") <= tail), low).alias("lower"), share(high & (F.col("v") >= 1 - tail), high).alias("upper"))


def christoffersen(df: DataFrame, n: int = 60, confidence: float = 0.95) -> DataFrame:
    """Per code: transitions between days within and beyond the rolling historical VaR, and the likelihood ratio against independence."""
    df = df.withColumn("ret", pct_change("close"))
    past = f"OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    df = df.withColumns({"_c": F.expr(f"count(ret) {past}"), "_v": F.expr(f"percentile(ret, {1 - confidence}) {past}")}).filter((F.col("_c") >= n) & F.col("ret").isNotNull())
    df = df.withColumn("_h", (F.col("ret") < F.col("_v")).cast("int"))
    df = df.withColumn("_p", F.lag("_h").over(W.partitionBy("code").orderBy("dt")))
    out = df.groupBy("code").agg(*(F.count(F.when((F.col("_p") == p) & (F.col("_h") == h), 1)).alias(f"n{p}{h}") for p in (0, 1) for h in (0, 1)))
    a, b, c, d = (F.col(x).cast("double") for x in ("n00", "n01", "n10", "n11"))
    part = lambda k, total: F.when(k > 0, k * F.ln(k / total)).otherwise(0.0)
    free = part(b, a + b) + part(a, a + b) + part(d, c + d) + part(c, c + d)
    return out.withColumn("christoffersen", F.greatest(F.lit(0.0), 2 * (free - part(b + d, a + b + c + d) - part(a + c, a + b + c + d))))


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float = 1.0, cap: float = 1.0, before: np.ndarray | None = None, turnover: float = 0.0, steps: int = 2000) -> np.ndarray:
    """Long-only weights of most mu.w - aversion/2 w.cov.w - turnover |w - before|^2, by projected gradient."""
    before = np.full(len(mu), 1 / len(mu)) if before is None else before
    w, rate = capped_simplex(before, cap), 1 / max(aversion * np.linalg.eigvalsh(cov).max() + 2 * turnover, 1e-9)
    for _ in range(steps):
        w = capped_simplex(w + rate * (mu - aversion * cov @ w - 2 * turnover * (w - before)), cap)
    return w


def max_sharpe(mu: np.ndarray, cov: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """The best of mean-variance weights over a range of aversions, by return on deviation."""
    fits = [mean_variance(mu, cov, a, cap, steps=500) for a in np.logspace(-1, 4, 24)]
    return max(fits, key=lambda w: mu @ w / np.sqrt(max(w @ cov @ w, 1e-18)))


def max_diversification(cov: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """Weights of least correlation-risk on unit deviations, scaled back by the deviations."""
    sd = np.sqrt(np.diag(cov))
    w = mean_variance(np.zeros(len(cov)), cov / np.outer(sd, sd), 1.0, cap) / sd
    return w / w.sum()


def hierarchical_parity(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: order by single linkage of correlation distances, then split risk down the order."""
    sd = np.sqrt(np.diag(cov))
    far = np.sqrt(np.maximum(0.5 * (1 - cov / np.outer(sd, sd)), 0))
    groups = [[i] for i in range(len(cov))]
    while len(groups) > 1:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: far[np.ix_(groups[p[0]], groups[p[1]])].min())
        groups[j] += groups.pop(i)
    w, todo = np.ones(len(cov)), [groups[0]]

    def risk(part: list[int]) -> float:
        inverse = 1 / np.diag(cov)[part]
        return float(inverse @ cov[np.ix_(part, part)] @ inverse / inverse.sum() ** 2)

    while todo:
        part = todo.pop()
        if len(part) > 1:
            a, b = part[: len(part) // 2], part[len(part) // 2 :]
            share = 1 - risk(a) / (risk(a) + risk(b))
            w[a] *= share
            w[b] *= 1 - share
            todo += [a, b]
    return w / w.sum()
