"""Simulated portfolio losses from factor shocks, and value at risk with the cost of leaving positions.

A shock is a function of (seed, scenario, factor): the executors make draws from hashes of those three,
so no random state exists and any partitioning gives the same losses.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.functions.columns import col

MOST_FACTORS = 64


def uniform(seed: int, *keys: Column) -> Column:
    """A number within (0, 1) of 52 bits of the MD5 of seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal draw keyed by seed and keys (Box-Muller)."""
    a, b = uniform(seed, *keys, F.lit("r")), uniform(seed, *keys, F.lit("a"))
    return F.sqrt(-2 * F.ln(a)) * F.cos(2 * math.pi * b)


def factor_root(cov: DataFrame) -> tuple[list[str], np.ndarray]:
    """Factors in order of name and the lower Cholesky factor of a full covariance table (a, b, cov).

    At most ``MOST_FACTORS`` factors. A matrix that is not positive definite gets the least even addition to its
    diagonal, in powers of ten, that makes it so.
    """
    rows = cov.select("a", "b", "cov").limit(MOST_FACTORS * MOST_FACTORS + 1).collect()
    names = sorted({r.a for r in rows})
    if len(names) > MOST_FACTORS:
        raise ValueError(f"at most {MOST_FACTORS} factors")
    place = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[place[r.a], place[r.b]] = r["cov"] or 0.0
    m = (m + m.T) / 2
    scale = float(np.trace(m)) / max(len(m), 1) or 1.0
    for extra in (0.0, *(10.0**k for k in range(-14, 1))):
        try:
            return names, np.linalg.cholesky(m + extra * scale * np.eye(len(m)))
        except np.linalg.LinAlgError:
            continue
    raise ValueError("not a covariance matrix")


def scenario_losses(exposures: DataFrame, cov: DataFrame, scenarios: int = 10_000, seed: int = 42) -> DataFrame:
    """scenario, portfolio, loss of long exposures (portfolio, factor, x) and variances of their own (factor null, x: the specific variance).

    Factor shocks are joint normal with ``cov`` and shared by all portfolios; the specific part is a normal draw of each
    portfolio. Portfolios by scenarios is the size of the result.
    """
    names, root = factor_root(cov)
    spark = exposures.sparkSession
    draws = spark.range(scenarios).toDF("scenario").withColumn("z", F.array(*(normal(seed, F.col("scenario"), F.lit(n)) for n in names)) if names else F.array().cast("array<double>"))
    wide = exposures.groupBy("portfolio").agg(
        F.array(*(F.coalesce(F.sum(F.when(F.col("factor") == n, F.col("x"))), F.lit(0.0)) for n in names)).alias("x") if names else F.array().cast("array<double>").alias("x"),
        F.coalesce(F.sum(F.when(F.col("factor").isNull(), F.col("x"))), F.lit(0.0)).alias("own"),
    )
    through = [reduce(lambda a, j: a + F.col("x")[j] * float(root[j, m]), range(m, len(names)), F.lit(0.0)) for m in range(len(names))]
    wide = wide.select("portfolio", F.array(*through).alias("e") if through else F.array().cast("array<double>").alias("e"), F.sqrt(F.greatest("own", F.lit(0.0))).alias("sd"))
    met = draws.join(wide)  # the stated set of scenarios for every portfolio
    moved = reduce(lambda a, m: a + F.col("e")[m] * F.col("z")[m], range(len(names)), F.col("sd") * normal(seed, F.col("scenario"), F.col("portfolio"), F.lit("own")))
    return met.select("scenario", "portfolio", (-moved).alias("loss"))


def tail(losses: DataFrame, confidence: float = 0.99, accuracy: int = 100_000) -> DataFrame:
    """portfolio, scenarios, mean, sd, var, es, worst: the loss quantile from a mergeable sketch, its rank off by at most one in ``accuracy``, and the mean of losses from it on."""
    cut = losses.groupBy("portfolio").agg(F.percentile_approx("loss", confidence, accuracy).alias("var"))
    met = losses.join(cut, "portfolio")
    return met.groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("scenarios"), F.avg("loss").alias("mean"), F.stddev_samp("loss").alias("sd"), F.max("var").alias("var"),
        F.avg(F.when(F.col("loss") >= F.col("var"), F.col("loss"))).alias("es"), F.max("loss").alias("worst"),
    )


def liquidity_adjusted(df: DataFrame, confidence: float = 0.95, spread: float = 0.001, impact: float = 0.1, size: str | Column = "position", volume: str | Column = "daily_volume") -> DataFrame:
    """``df`` (mean and sd of returns, a position and a daily traded amount) with var, spread_cost, participation, impact_cost, lvar.

    The normal value at risk plus half the spread plus ``impact`` times the root of the position's share of the
    daily amount; without a positive amount there is no share and no impact. Unknown moments: unknown.
    """
    share = F.when(col(volume) > 0, F.greatest(F.try_divide(col(size), col(volume)), F.lit(0.0))).otherwise(F.lit(0.0))
    var = -(F.col("mean") + NormalDist().inv_cdf(1 - confidence) * F.col("sd"))
    out = df.withColumns({"var": var, "spread_cost": F.lit(0.5 * spread), "participation": F.coalesce(share, F.lit(0.0))})
    out = out.withColumn("impact_cost", impact * F.sqrt("participation"))
    return out.withColumn("lvar", F.col("var") + F.col("spread_cost") + F.col("impact_cost"))
