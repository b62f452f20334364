"""Resampled tests, order generation, corporate actions, integrity checks and attribution of back-tests."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

YEAR = 252


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(-v / math.sqrt(2)))


def block_bootstrap(df: DataFrame, value: str = "ret", draws: int = 1000, block: int = 5, seed: int = 7) -> DataFrame:
    """draw, mean, sharpe of block resamples of one series (dt, value), drawn by a keyed hash.

    Each draw joins its blocks' positions back to the series, so draws run side by side on Spark
    and repeat exactly for a seed. The series wraps around at its end.
    """
    x = df.filter(F.col(value).isNotNull()).select(value, (F.row_number().over(W.orderBy("dt")) - 1).alias("i"))  # one row a date
    n = F.broadcast(x.agg(F.count(F.lit(1)).alias("n")))  # one row
    blocks = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(n).filter("n > 0").withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))))  # draws x blocks
    blocks = blocks.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "draw", "b"), F.col("n")))
    steps = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).filter(F.col("b") * block + F.col("k") < F.col("n"))
    drawn = steps.select("draw", ((F.col("at") + F.col("k")) % F.col("n")).alias("i")).join(x, "i")
    out = drawn.groupBy("draw").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.select("draw", "mean", F.when(F.col("sd") > 1e-15, F.col("mean") / F.col("sd") * YEAR**0.5).alias("sharpe"))


def confidence_interval(draws: DataFrame, metric: str = "sharpe", confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    return draws.agg(F.percentile(metric, tail).alias("low"), F.percentile(metric, 1 - tail).alias("high"))


def sign_permutation_test(df: DataFrame, value: str = "ret", draws: int = 1000, block: int = 5, seed: int = 7) -> DataFrame:
    """observed, p: how often block-wise sign flips of one series reach the observed mean."""
    x = df.filter(F.col(value).isNotNull()).select(value, F.floor((F.row_number().over(W.orderBy("dt")) - 1) / block).alias("b"))  # one row a date
    sums = x.groupBy("b").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    flips = sums.crossJoin(F.broadcast(df.sparkSession.range(draws).withColumnRenamed("id", "draw")))  # a fixed number of draws
    per = flips.groupBy("draw").agg((F.sum(F.when(F.xxhash64(F.lit(seed), "draw", "b") % 2 == 0, F.col("s")).otherwise(-F.col("s"))) / F.sum("c")).alias("m"))
    seen = F.broadcast(x.agg(F.avg(value).alias("observed")))  # one row
    return per.crossJoin(seen).groupBy("observed").agg(((F.sum((F.col("m") >= F.col("observed")).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def deflated_sharpe(df: DataFrame, trials: int, sharpe: str = "sharpe", n: str = "n", skew: str = "skew", kurt: str = "kurt") -> DataFrame:
    """Probability that a per-period Sharpe ratio beats the best of ``trials`` without skill, given length, skewness and kurtosis."""
    gamma, inverse = 0.5772156649015329, NormalDist().inv_cdf
    best = (1 - gamma) * inverse(1 - 1 / trials) + gamma * inverse(1 - 1 / (trials * math.e)) if trials > 1 else 0.0
    s, size = F.col(sharpe), F.col(n)
    spread = F.greatest(F.lit(1e-12), 1 - F.col(skew) * s + (F.col(kurt) - 1) / 4 * s * s)
    z = F.when(size > 1, (s - best / F.sqrt(size)) * F.sqrt(size - 1) / F.sqrt(spread))
    return df.withColumn("deflated", normal_cdf(z)).withColumn("least_years", F.when(s > 0, F.pow(inverse(0.95) / (s * YEAR**0.5), F.lit(2.0))))


def orders(targets: DataFrame, holdings: DataFrame, value: float, lot: int = 100, ignore: float = 1e-4) -> DataFrame:
    """dt, code, side, shares from target weights (dt, code, weight, close) and holdings (dt, code, shares, close).

    Changes below ``ignore`` of the value are left out; buys are whole lots, sells that close a position take odd lots along.
    """
    a = targets.select("dt", "code", F.col("close").alias("c1"), "weight")
    b = holdings.select("dt", "code", F.col("close").alias("c2"), "shares")
    x = a.join(b, ["dt", "code"], "full_outer").withColumns({"close": F.coalesce("c1", "c2"), "weight": F.coalesce("weight", F.lit(0.0)), "shares": F.coalesce("shares", F.lit(0.0))}).filter("close > 0")
    want = F.try_divide(F.col("weight") * value, "close")
    delta = F.when(F.col("weight") == 0, -F.col("shares")).otherwise(F.signum(want - F.col("shares")) * F.floor(F.abs(want - F.col("shares")) / lot) * lot)
    x = x.withColumn("delta", delta).filter((F.abs(F.col("delta") * F.col("close")) > ignore * value) & (F.col("delta") != 0))
    return x.select("dt", "code", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("delta").alias("shares"))


def dividends(lots: DataFrame, paid: DataFrame) -> DataFrame:
    """Cash after tax and bonus shares of lots (lot, code, bought, shares) per payment (code, ex_day, cash, bonus).

    Tax is 20 % for lots held up to 30 days, 10 % up to 365, else none; lots bought on or after the day get nothing.
    """
    x = lots.join(paid, "code").filter("bought < ex_day").withColumn("held", F.datediff("ex_day", "bought"))
    tax = F.when(F.col("held") <= 30, 0.2).when(F.col("held") <= 365, 0.1).otherwise(0.0)
    return x.select("lot", "code", "ex_day", "held", (F.col("shares") * F.col("cash") * (1 - tax)).alias("net_cash"), F.floor(F.col("shares") * F.col("bonus")).alias("bonus_shares"))


def t_plus_one(trades: DataFrame) -> DataFrame:
    """Codes and days that sell more than was held before the day: code, dt, sold, sellable."""
    day = trades.groupBy("code", "dt").agg(F.sum(F.when(F.col("side") == "buy", F.col("shares")).otherwise(0.0)).alias("bought"), F.sum(F.when(F.col("side") == "sell", F.col("shares")).otherwise(0.0)).alias("sold"))
    before = W.partitionBy("code").orderBy("dt").rowsBetween(W.unboundedPreceding, -1)
    held = F.coalesce(F.sum(F.col("bought") - F.col("sold")).over(before), F.lit(0.0))
    return day.withColumn("sellable", held).filter("sold > sellable").select("code", "dt", "sold", "sellable")


def factor_attribution(weights: DataFrame, exposures: DataFrame, returns: DataFrame) -> DataFrame:
    """dt, factor, contribution = sum of weight * exposure * factor return."""
    x = weights.join(exposures, ["dt", "code"]).join(returns, ["dt", "factor"])
    return x.groupBy("dt", "factor").agg(F.sum(F.col("weight") * F.col("exposure") * F.col("ret")).alias("contribution"))


def signal_report(df: DataFrame, signal: str) -> DataFrame:
    """Of one series per code: how often LONG and SHORT were right on the next row, gains on losses, and mean on deviation of the signed return."""
    ahead = F.try_divide(F.lead("close").over(W.partitionBy("code").orderBy("dt")), "close") - 1
    side = F.when(F.col(signal) == "LONG", 1).when(F.col(signal) == "SHORT", -1)
    x = df.withColumn("_p", side * ahead).filter("_p is not null")
    out = x.groupBy("code", signal).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_p") > 0).cast("double")).alias("hit_rate"), F.sum(F.greatest("_p", F.lit(0.0))).alias("gain"), (-F.sum(F.least("_p", F.lit(0.0)))).alias("loss"), F.avg("_p").alias("m"), F.stddev_samp("_p").alias("sd"))
    return out.withColumns({"profit_factor": F.when(F.col("loss") > 0, F.col("gain") / F.col("loss")), "snr": F.when(F.col("sd") > 0, F.col("m") / F.col("sd"))}).withColumnRenamed(signal, "signal")


def signal_nav(df: DataFrame, signal: str, start: float = 1.0) -> DataFrame:
    """Value of holding the series where the signal of the row before is not SHORT."""
    w = W.partitionBy("code").orderBy("dt")
    ret = F.try_divide("close", F.lag("close").over(w)) - 1
    x = df.withColumn("_r", F.when(F.coalesce(F.lag(signal).over(w), F.lit("NEUTRAL")) == "SHORT", 0.0).otherwise(F.coalesce(ret, F.lit(0.0))))
    return x.withColumn("nav", start * F.exp(F.sum(F.log1p(F.greatest(F.col("_r"), F.lit(-0.999999)))).over(w.rowsBetween(W.unboundedPreceding, 0))))
