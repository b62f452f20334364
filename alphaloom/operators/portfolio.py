"""Scores, weights, costs and back-tests."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import date

#: Additive changes of module weights by regime (fixed values).
REGIME_DELTAS = {"BULL": {"f": 0.1, "g": -0.1}, "BEAR": {"f": -0.1, "g": 0.1}, "SIDEWAYS": {"f": 0.0, "g": 0.0}}


def weighted_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weight * factor over known factors, divided by the known weights."""
    top = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()))
    known = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), abs(w)).otherwise(0.0) for c, w in weights.items()))
    return df.withColumn("score", F.when(known > 0, top / known))


def rank_scores(df: DataFrame, n: int = 10, groups: int = 5) -> DataFrame:
    """Rank (1 is best, ties by code), quantile group and whether among the first n, per date."""
    order = date().orderBy(F.col("score").desc_nulls_last(), "code")
    df = df.withColumn("rank", F.row_number().over(order)).withColumn("_n", F.count("score").over(date()))
    return df.withColumns({"quantile": F.least(F.lit(groups), F.floor((F.col("rank") - 1) * groups / F.col("_n")).cast("int") + 1), "selected": (F.col("rank") <= n) & F.col("score").isNotNull()})


def buffered_selection(df: DataFrame, n: int = 10, buffer: int = 5) -> DataFrame:
    """Members of the first n, and those of the last date's first n that still rank within n + buffer."""
    held = df.withColumn("_before", F.lag("rank").over(W.partitionBy("code").orderBy("dt")))
    return held.withColumn("held", (F.col("rank") <= n) | (F.coalesce(F.col("_before") <= n, F.lit(False)) & (F.col("rank") <= n + buffer)))


def score_weights(df: DataFrame, most: float = 0.2, industry_most: float = 0.4) -> DataFrame:
    """Weights in proportion to positive scores, clipped per name, scaled down in crowded industries, summing to 1."""
    d = date()
    df = df.filter("selected").withColumn("_w", F.greatest(F.col("score") - F.min("score").over(d), F.lit(0.0)) + 1e-6)
    df = df.withColumn("_w", F.least(F.try_divide("_w", F.sum("_w").over(d)), F.lit(most))).withColumn("_w", F.try_divide("_w", F.sum("_w").over(d)))
    df = df.withColumn("_i", F.sum("_w").over(date("dt", "industry"))).withColumn("_w", F.when(F.col("_i") > industry_most, F.col("_w") * industry_most / F.col("_i")).otherwise(F.col("_w")))
    return df.withColumn("weight", F.try_divide("_w", F.sum("_w").over(d)))


def turnover(weights: DataFrame) -> DataFrame:
    """Half the absolute weight changes between consecutive dates."""
    dates = weights.select("dt").distinct().withColumn("next", F.lead("dt").over(W.orderBy("dt")))  # one row a date
    now = weights.select("dt", "code", "weight")
    old = now.join(dates.filter("next is not null"), "dt").select(F.col("next").alias("dt"), "code", F.col("weight").alias("before"))
    both = now.join(dates.select("dt"), "dt").join(old, ["dt", "code"], "full_outer")
    return both.groupBy("dt").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))) / 2).alias("turnover"))


def trade_costs(df: DataFrame, commission: float = 0.00025, least: float = 5.0, transfer: float = 0.00001, stamp: float = 0.001, slip: float = 0.0005, impact: float = 0.3) -> DataFrame:
    """Commission, transfer fee, stamp duty of sells and square-root slippage of trades (amount, side, day_amount, sigma)."""
    a = F.abs("amount")
    part = F.when((F.col("day_amount") > 0) & F.col("sigma").isNotNull(), slip + impact * F.col("sigma") * F.sqrt(a / F.col("day_amount"))).otherwise(F.lit(0.001))
    return df.withColumns({
        "commission": F.greatest(a * commission, F.lit(least)), "transfer": a * transfer, "stamp": F.when(F.col("side") == "sell", a * stamp).otherwise(0.0), "slippage": a * part,
    }).withColumn("cost", F.col("commission") + F.col("transfer") + F.col("stamp") + F.col("slippage"))


def nav(weights: DataFrame, returns: DataFrame, label: str = "fwd_1") -> DataFrame:
    """Portfolio return per date and the compounded value after it."""
    daily = weights.join(returns.select("dt", "code", label), ["dt", "code"]).groupBy("dt").agg(F.sum(F.col("weight") * F.coalesce(label, F.lit(0.0))).alias("ret"))
    return daily.withColumn("nav", F.exp(F.sum(F.log1p("ret")).over(W.orderBy("dt").rowsBetween(W.unboundedPreceding, 0))))  # one row a date


def capped_simplex(v: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """The nearest point with entries within [0, cap] that sum to 1 (bisection on the shift)."""
    low, high = v.min() - 1, v.max()
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > 1 else (low, mid)
    return np.clip(v - (low + high) / 2, 0, cap)


def minimum_variance(cov: np.ndarray, cap: float = 1.0, steps: int = 2000) -> np.ndarray:
    """Long-only weights of least variance by projected gradient."""
    w = capped_simplex(np.full(len(cov), 1 / len(cov)), cap)
    rate = 1 / max(np.linalg.eigvalsh(cov).max(), 1e-12)
    for _ in range(steps):
        w = capped_simplex(w - rate * (cov @ w), cap)
    return w


def risk_parity(cov: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights of equal risk contributions by cyclical coordinate descent."""
    n = len(cov)
    w = 1 / np.sqrt(np.diag(cov))
    for _ in range(steps):
        for i in range(n):
            b = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-b + np.sqrt(b * b + 4 * cov[i, i] / n)) / (2 * cov[i, i])
    return w / w.sum()
