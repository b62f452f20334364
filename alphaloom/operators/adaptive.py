"""Adaptive factor choice over histories of information coefficients, and the fusion of module scores.

A history has one row per factor and date: factor, dt, ic, rank_ic. Windows are per factor.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACTIVE, MONITORING, INACTIVE = "ACTIVE", "MONITORING", "INACTIVE"
#: Base weights of the score modules, and the bounds of each (fixed values).
BASE_WEIGHTS = {"quality_growth": 0.35, "expectation": 0.30, "residual_momentum": 0.25, "flow_confirm": 0.10}
LEAST_WEIGHT, MOST_WEIGHT = 0.10, 0.45


def recent_history(history: DataFrame, n: int) -> DataFrame:
    """The last n dates of each factor."""
    last = F.row_number().over(W.partitionBy("factor").orderBy(F.col("dt").desc()))
    return history.filter("ic is not null").withColumn("_rn", last).filter(F.col("_rn") <= n)


def select_factors(history: DataFrame, lookback: int = 24, least: int = 2, most: int = 30, icir: float = 0.3) -> DataFrame:
    """factor, icir, positive, score, chosen: those with enough |icir| by score, topped up to ``least``, at most ``most``."""
    s = recent_history(history, lookback).groupBy("factor").agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("sd"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.avg("rank_ic").alias("r"))
    s = s.withColumn("icir", F.when(F.col("sd") > 1e-12, F.col("m") / F.col("sd")).otherwise(0.0))
    score = 0.5 * F.abs("icir") + 0.3 * 2 * (F.col("positive") - 0.5) + 0.2 * 10 * F.abs("r")
    s = s.withColumn("score", F.when(F.col("m") < 0, score * 0.3).otherwise(score))
    enough = F.abs("icir") >= icir
    place = F.row_number().over(W.orderBy(enough.desc(), F.col("score").desc(), "factor"))  # one row a factor
    return s.withColumn("_p", place).select("factor", "icir", "positive", "score", ((F.col("_p") <= least) | (enough & (F.col("_p") <= most))).alias("chosen"))


def decay_monitor(history: DataFrame, short: int = 12, long: int = 36, alert: float = 0.5) -> DataFrame:
    """Short and long means, the share lost, the slope of IC over its position, and alerts per factor."""
    h = recent_history(history, long)
    s = h.groupBy("factor").agg(
        F.avg(F.when(F.col("_rn") <= short, F.col("ic"))).alias("short_ic"), F.avg("ic").alias("long_ic"), F.regr_slope(F.col("ic"), -F.col("_rn").cast("double")).alias("slope"),
    )
    lost = F.when(F.abs("long_ic") > 1e-12, 1 - F.col("short_ic") / F.col("long_ic"))
    s = s.withColumn("lost", lost)
    return s.withColumn("alert", F.when(F.col("short_ic") * F.col("long_ic") < 0, "sign_change").when(F.col("lost") > alert, "decayed").when(F.abs("short_ic") < 0.01, "weak").otherwise("none"))


def health(history: DataFrame, lookback: int = 24) -> DataFrame:
    """A score of 0 to 100 per factor (40 strength, 30 stability, 20 sign, 10 length), its level and what to do."""
    s = recent_history(history, lookback).groupBy("factor").agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("sd"), F.avg((F.col("ic") > 0).cast("double")).alias("p"), F.count("ic").alias("n"))
    ratio = F.when(F.col("sd") > 1e-12, F.abs(F.col("m")) / F.col("sd")).otherwise(0.0)
    score = 40 * F.least(F.lit(1.0), F.abs("m") / 0.05) + 30 * F.least(F.lit(1.0), ratio) + 20 * F.abs(F.col("p") - 0.5) * 2 + 10 * F.least(F.lit(1.0), F.col("n") / lookback)
    s = s.withColumn("score", score)
    level = F.when(F.col("score") >= 70, "good").when(F.col("score") >= 40, "fair").otherwise("poor")
    return s.select("factor", "n", "score", level.alias("level"), F.when(F.col("score") >= 70, "keep").when(F.col("score") >= 40, "monitor").when(F.col("score") >= 20, "reduce").otherwise("remove").alias("advice"))


def states(history: DataFrame, up: float = 0.02, down: float = 0.0, run: int = 5) -> DataFrame:
    """factor, dt, state: a hysteresis over each factor's dates.

    ``run`` dates in a row with |ic| at most ``down`` lower a state by one, as many at least ``up``
    raise it by one; other dates reset both counts. Factors start as MONITORING.
    """
    order = [INACTIVE, MONITORING, ACTIVE]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        at, good, bad, out = 1, 0, 0, []
        for ic in rows["ic"].abs().fillna(0.0):
            good, bad = (good + 1 if ic >= up else 0), (bad + 1 if ic <= down else 0)
            if max(good, bad) >= run:
                at, good, bad = min(2, at + 1) if good else max(0, at - 1), 0, 0
            out.append(order[at])
        return pd.DataFrame({"factor": rows["factor"], "dt": rows["dt"], "state": out})

    return history.select("factor", "dt", "ic").groupBy("factor").applyInPandas(fold, "factor string, dt date, state string")


def module_score(df: DataFrame, factors: dict[str, tuple[int, float]], out: str) -> DataFrame:
    """Weighted sum of directed z-scores per date over known factors, renormalised by the known weights."""
    d = W.partitionBy("dt")
    terms, known = [], []
    for c, (direction, weight) in factors.items():
        sd = F.stddev_samp(c).over(d)
        z = F.when(sd > 0, (F.col(c) - F.avg(c).over(d)) / sd * direction)
        terms.append(F.coalesce(z * weight, F.lit(0.0)))
        known.append(F.when(z.isNotNull(), weight).otherwise(0.0))
    total = reduce(lambda a, b: a + b, known)
    return df.withColumn(out, F.when(total > 0, reduce(lambda a, b: a + b, terms) / total))


def module_weights(ics: dict[str, float], deltas: dict[str, float] | None = None, corr: dict[str, float] | None = None, base: dict[str, float] | None = None) -> dict[str, float]:
    """Base weights plus 0.3 IC and the regime's deltas, shrunk where a module correlates with the others, clipped and summing to 1."""
    w = {m: b + 0.3 * ics.get(m, 0.0) + (deltas or {}).get(m, 0.0) for m, b in (base or BASE_WEIGHTS).items()}
    w = {m: v * (1 - 0.3 * max((corr or {}).get(m, 0.0), 0.0)) for m, v in w.items()}
    for _ in range(3):
        w = {m: min(max(v, LEAST_WEIGHT), MOST_WEIGHT) for m, v in w.items()}
        total = sum(w.values())
        w = {m: v / total for m, v in w.items()}
    return w


def fuse_modules(df: DataFrame, weights: dict[str, float], penalty: str | None = None, strength: float = 0.35) -> DataFrame:
    """score: weighted modules less ``strength`` times a penalty that is larger for riskier names."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in weights.items()))
    return df.withColumn("score", total - strength * F.coalesce(F.col(penalty), F.lit(0.0)) if penalty else total)


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point of the unit simplex, by sorting."""
    u = np.sort(v)[::-1]
    shift = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - shift[np.nonzero(u > shift)[0][-1]], 0.0)
