"""The production portfolio: a buffer around the ranks held, tiers of weights, risk and liquidity discounts, industry bounds, lots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import date

from .transitions import states

# fixed values
TIERS = ((10, 1.5), (30, 1.2), (60, 1.0))
RISK_DISCOUNT = {"low": 1.0, "medium": 0.85, "high": 0.6, "extreme": 0.0}
LIQUIDITY_DISCOUNT = {"normal": 1.0, "marginal": 0.85, "insufficient": 0.6}
INDUSTRY_MOST, LEAST_WEIGHT, LOT = 0.20, 0.002, 100


@dataclass(frozen=True)
class Bounds:
    """The first ``top`` are bought on a first date; later a name is bought within ``buy`` and held within ``hold``."""

    top: int = 60
    buy: int = 50
    hold: int = 75


def held_names(df: DataFrame, bounds: Bounds) -> DataFrame:
    """``df`` (code, dt, rank) with held: two states a name, composed like any machine's (see ``transitions``).

    A name without a row on a date is sold on it, so after a gap it must be bought again.
    """
    days = df.select("dt").distinct().withColumn("_day", F.row_number().over(W.orderBy("dt")))  # a row a date
    df = df.join(F.broadcast(days), "dt")
    goes_on = F.coalesce(F.lag("_day").over(W.partitionBy("code").orderBy("dt")) == F.col("_day") - 1, F.lit(False))
    rank = F.col("rank")
    buys = F.coalesce(F.when(F.col("_day") == 1, rank <= bounds.top).otherwise(rank <= bounds.buy), F.lit(False)).cast("int")
    keeps = F.when(goes_on, F.coalesce(rank <= bounds.hold, F.lit(False)).cast("int")).otherwise(buys)
    df = df.withColumns({"_buys": buys, "_keeps": keeps})
    return states(df, "code", F.array("_buys", "_keeps"), 2).withColumn("held", F.col("state") == 1).drop("_day", "_buys", "_keeps", "state")


def _level(column: str, discounts: dict[str, float], default: str) -> Column:
    named = F.create_map(*(F.lit(v) for pair in discounts.items() for v in pair))
    return F.coalesce(F.try_element_at(named, F.coalesce(column, F.lit(default))), F.lit(1.0))


def _even(df: DataFrame) -> DataFrame:
    total = F.sum("weight").over(date())
    return df.withColumn("weight", F.when(total > 0, F.try_divide("weight", total)).otherwise(0.0))


def industry_bounded(df: DataFrame, most: float = INDUSTRY_MOST) -> DataFrame:
    """Industries over ``most`` of a date shrink to it; what they give goes to the names of the others in proportion (none: stays in cash).

    A null industry is one of its own.
    """
    own = F.sum("weight").over(W.partitionBy("dt", "industry"))
    df = df.withColumn("_i", own).withColumn("_over", F.col("_i") > most)
    freed = F.sum(F.when(F.col("_over"), F.col("weight") * (1 - F.try_divide(F.lit(most), "_i"))).otherwise(0.0)).over(date())
    rest = F.sum(F.when(~F.col("_over"), F.col("weight")).otherwise(0.0)).over(date())
    df = df.withColumns({"_freed": freed, "_rest": rest})
    more = 1 + F.coalesce(F.try_divide("_freed", F.nullif("_rest", F.lit(0.0))), F.lit(0.0))
    return df.withColumn("weight", F.when(F.col("_over"), F.col("weight") * F.try_divide(F.lit(most), "_i")).otherwise(F.col("weight") * more)).drop("_i", "_over", "_freed", "_rest")


def tiered_portfolio(df: DataFrame, bounds: Bounds = Bounds(), tiers: tuple[tuple[int, float], ...] = TIERS, capital: float = 1e8, lot: int = LOT, industry_most: float = INDUSTRY_MOST, least: float = LEAST_WEIGHT) -> DataFrame:
    """dt, code, rank, industry, tier, shares, weight of names held on each date, from code, dt, rank, industry, close, risk_level, liquidity_level.

    Weights begin with the multiplier of the rank's tier (beyond the last: 1, tier 0), times the discounts of both
    levels (null: low and normal; an unknown level discounts nothing), and sum to 1; then industries are bounded,
    shares are whole lots at the close (no price: none), weights under ``least`` go, and the rest sum to 1 again.
    """
    df = held_names(df, bounds).filter("held")
    tier, times = F.lit(0), F.lit(1.0)
    for i, (last, multiplier) in reversed(list(enumerate(tiers, 1))):
        tier, times = F.when(F.col("rank") <= last, i).otherwise(tier), F.when(F.col("rank") <= last, multiplier).otherwise(times)
    df = df.withColumns({"tier": tier, "weight": times * _level("risk_level", RISK_DISCOUNT, "low") * _level("liquidity_level", LIQUIDITY_DISCOUNT, "normal")})
    df = industry_bounded(_even(df), industry_most)
    shares = F.when(F.col("close") > 0, F.floor(F.try_divide(F.col("weight") * capital, F.col("close")) / lot) * lot).otherwise(F.lit(0))
    df = df.withColumn("shares", shares.cast("long"))
    df = _even(df.withColumn("weight", F.col("shares") * F.coalesce("close", F.lit(0.0)) / capital))
    df = _even(df.withColumn("weight", F.when(F.col("weight") >= least, F.col("weight")).otherwise(0.0)))
    return df.filter("weight > 0").select("dt", "code", "rank", "industry", "tier", "shares", "weight")
