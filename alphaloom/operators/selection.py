"""Choosing by several scores in turn, blending scores, and what capital a strategy can carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import date


def filter_in_turn(df: DataFrame, steps: list[tuple[str, float]]) -> DataFrame:
    """Rows that survive all steps: each keeps the top share of a date's survivors by a column (nulls last, ties by code)."""
    for x, share in steps:
        place = F.row_number().over(date().orderBy(F.col(x).desc_nulls_last(), "code"))
        df = df.withColumns({"_p": place, "_n": F.count(F.lit(1)).over(date())}).filter(F.col("_p") <= F.ceil(F.col("_n") * share)).drop("_p", "_n")
    return df


def blend(df: DataFrame, first: str, second: str, weight: float = 0.6, out: str = "score") -> DataFrame:
    """Adds the weighted sum of two scores standardised per date; where one is unknown, the other alone."""
    z = [(F.col(x) - F.avg(x).over(date())) / F.nullif(F.stddev_samp(x).over(date()), F.lit(0.0)) for x in (first, second)]
    return df.withColumns({"_a": z[0], "_b": z[1]}).withColumn(out, F.coalesce(weight * F.col("_a") + (1 - weight) * F.col("_b"), "_a", "_b")).drop("_a", "_b")


def market_impact(df: DataFrame, aum: float, change: str = "change", volume: str = "amount", volatility: str = "vol") -> DataFrame:
    """Adds participation (traded money over the day's) and impact: volatility times the root of participation over a tenth."""
    share = F.when(F.col(volume) > 0, F.abs(change) * aum / F.col(volume))
    return df.withColumn("participation", share).withColumn("impact", F.col(volatility) * F.sqrt(F.col("participation") / 0.1))


def capital_levels(df: DataFrame, levels: list[float], label: str = "fwd_1", fixed: float = 0.0005, slope: float = 0.3, year: int = 12) -> DataFrame:
    """capital, annual, sharpe, slippage: the strategy's rows (dt, weight, label, amount, vol) rerun at each capital.

    Slippage is ``fixed`` plus ``slope`` times participation times volatility. ``levels`` are a handful of constants.
    """
    spent = F.explode(F.array(*(F.lit(float(x)) for x in levels))).alias("capital")
    rate = fixed + F.try_divide(slope * F.col("weight") * F.col("capital"), "amount") * F.col("vol")
    days = df.filter((F.col("amount") > 0) & F.col(label).isNotNull()).select("*", spent).groupBy("capital", "dt").agg(
        F.sum(F.col("weight") * (F.col(label) - rate)).alias("r"), F.sum(F.col("weight") * rate).alias("s")
    )
    return days.groupBy("capital").agg(
        (F.avg("r") * year).alias("annual"), (F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0)) * year**0.5).alias("sharpe"), F.avg("s").alias("slippage")
    )


def capacity(levels: DataFrame, share: float = 0.8) -> DataFrame:
    """One row, capacity: the capital at which ``share`` of the smallest level's return is left, between levels on a straight line.

    Null where the smallest level earns nothing; the largest level where even that keeps the share.
    """
    order = W.orderBy("capital")  # a handful of rows
    x = levels.withColumns({"goal": share * F.first("annual").over(order), "c0": F.lag("capital").over(order), "a0": F.lag("annual").over(order)})
    crossed = F.when((F.col("annual") < F.col("goal")) & (F.col("a0") >= F.col("goal")), F.col("c0") + (F.col("a0") - F.col("goal")) / (F.col("a0") - F.col("annual")) * (F.col("capital") - F.col("c0")))
    return x.agg(F.when(F.max("goal") > 0, F.coalesce(F.min(crossed), F.max("capital"))).alias("capacity"))
