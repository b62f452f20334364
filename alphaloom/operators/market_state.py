"""The market's regime by trend, volatility and breadth, with hysteresis in the volatility state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.functions.columns import pct_change, rolling, series

from .transitions import states

# fixed values
VOL_HIGH_ENTER, VOL_HIGH_EXIT, VOL_LOW_ENTER, VOL_LOW_EXIT = 0.30, 0.25, 0.15, 0.20
RATIO_HIGH_ENTER, RATIO_HIGH_EXIT, RATIO_LOW_ENTER, RATIO_LOW_EXIT = 1.5, 1.3, 0.7, 0.9
TREND_20, TREND_60, CROSS = 0.03, 0.05, 0.02
BREADTH_HIGH, BREADTH_LOW = 0.6, 0.4
RISK_ON, TRENDING, DEFENSIVE, MEAN_REVERTING = "risk_on", "trending", "defensive", "mean_reverting"

NEUTRAL, DEFENCE, ATTACK = 0, 1, 2


def features(index: DataFrame) -> DataFrame:
    """``index`` (code, dt, close) with trend_20, trend_60, ma_cross, vol_20 and vol_ratio as known at each row (null: too few rows).

    Trends are the close less its mean of 20 or 60 rows, on the close; the ratio sets the deviation of 10 returns on that
    of 60 (of 20 while there are fewer).
    """
    df = index.withColumn("_r", pct_change("close"))
    mean = lambda n: rolling(F.avg, "close", n)
    sd = lambda n: rolling(F.stddev_samp, "_r", n)
    on_close = lambda n: F.when(mean(n).isNotNull(), F.when(F.col("close") > 0, (F.col("close") - mean(n)) / F.nullif(F.col("close"), F.lit(0.0))).otherwise(0.0))
    df = df.withColumns({"trend_20": on_close(20), "trend_60": on_close(60), "_ma20": mean(20), "_ma60": mean(60), "_sd20": sd(20), "_long": F.coalesce(sd(60), sd(20)), "_short": sd(10)})
    cross = F.when(F.col("_ma60").isNotNull(), F.when(F.col("_ma60") > 0, (F.col("_ma20") - F.col("_ma60")) / F.nullif(F.col("_ma60"), F.lit(0.0))).otherwise(0.0))
    ratio = F.when(F.col("_long").isNotNull(), F.when(F.col("_long") > 0, F.col("_short") / F.nullif(F.col("_long"), F.lit(0.0))).otherwise(1.0))
    return df.withColumns({"ma_cross": cross, "vol_20": F.col("_sd20") * 252**0.5, "vol_ratio": ratio, "_first": F.row_number().over(series()) == 1}).drop("_ma20", "_ma60", "_sd20", "_long", "_short", "_r")


def breadth(panel: DataFrame) -> DataFrame:
    """dt, breadth: of the securities (code, dt, close) with a return on a date, the share that rose."""
    return panel.withColumn("_r", pct_change("close")).filter("_r is not null").groupBy("dt").agg(F.avg((F.col("_r") > 0).cast("double")).alias("breadth"))


def volatility_step(vol: Column, ratio: Column) -> Column:
    """Where each volatility state goes: the bound that a state is entered at is not the one that it is left at."""
    neutral = F.when((vol > VOL_HIGH_ENTER) | (ratio > RATIO_HIGH_ENTER), DEFENCE).when((vol < VOL_LOW_ENTER) & (ratio < RATIO_LOW_ENTER), ATTACK).otherwise(NEUTRAL)
    defence = F.when((vol < VOL_HIGH_EXIT) & (ratio < RATIO_HIGH_EXIT), NEUTRAL).otherwise(DEFENCE)
    attack = F.when((vol > VOL_LOW_EXIT) | (ratio > RATIO_LOW_EXIT), NEUTRAL).otherwise(ATTACK)
    return F.array(neutral, defence, attack)


def detect(index: DataFrame, breadths: DataFrame) -> DataFrame:
    """code, dt, trend_score, vol_score, breadth_score, composite, regime, confidence of every row of ``index`` (code, dt, close).

    ``breadths`` has dt and breadth (one row a date; a date without it counts as a half). Unknown trends count as
    none, an unknown volatility as 0.2 and an unknown ratio as 1. The volatility state goes on from row to row of a
    code, beginning neutral. The first row of a code tells nothing: mean-reverting with a confidence of 0.3.
    """
    df = features(index).join(F.broadcast(breadths), "dt", "left").withColumn("breadth", F.coalesce("breadth", F.lit(0.5)))  # a row a date
    df = df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trend_20", "trend_60", "ma_cross")} | {"vol_20": F.coalesce("vol_20", F.lit(0.2)), "vol_ratio": F.coalesce("vol_ratio", F.lit(1.0))})
    df = states(df, "code", volatility_step(F.col("vol_20"), F.col("vol_ratio")), 3)
    t20, cross = F.col("trend_20"), F.col("ma_cross")
    strong = (F.abs(t20) > TREND_20) & (F.abs("trend_60") > TREND_60)
    trend = F.when(strong, F.signum(t20) * F.least(F.abs(t20) * 10, F.lit(1.0))).when(F.abs(cross) > CROSS, F.signum(cross) * F.least(F.abs(cross) * 5, F.lit(0.5))).otherwise(0.0)
    vol = F.when(F.col("state") == DEFENCE, -1.0).when(F.col("state") == ATTACK, 1.0).otherwise(0.0)
    wide = F.when(F.col("breadth") > BREADTH_HIGH, 1.0).when(F.col("breadth") < BREADTH_LOW, -1.0).otherwise(0.0)
    df = df.withColumns({"trend_score": trend, "vol_score": vol, "breadth_score": wide}).withColumn("composite", F.col("trend_score") + F.col("vol_score") + F.col("breadth_score"))
    regime = F.when(F.col("_first"), MEAN_REVERTING).when((F.col("composite") >= 1.5) & (F.col("trend_score") > 0), RISK_ON).when((F.col("composite") >= 0.5) & (F.abs("trend_score") > 0.3), TRENDING)
    regime = regime.when(F.col("composite") <= -1.0, DEFENSIVE).otherwise(MEAN_REVERTING)
    clear = (F.abs(t20) * 10 + F.abs(F.col("vol_ratio") - 1) * 2 + F.abs(F.col("breadth") - 0.5) * 2) / 3
    return df.select("code", "dt", "trend_score", "vol_score", "breadth_score", "composite", regime.alias("regime"), F.when(F.col("_first"), 0.3).otherwise(F.least(clear, F.lit(1.0))).alias("confidence"))
