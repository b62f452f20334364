"""Timing signals over an index series, and their fusion into a target exposure."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import pct_change, rolling, series

LONG, SHORT, NEUTRAL = "LONG", "SHORT", "NEUTRAL"


def signal(up: Column, down: Column) -> Column:
    return F.when(up, LONG).when(down, SHORT).otherwise(NEUTRAL)


def ma_cross(df: DataFrame, fast: int = 20, slow: int = 60) -> DataFrame:
    df = df.withColumns({"_f": rolling(F.avg, "close", fast), "_s": rolling(F.avg, "close", slow)})
    return df.withColumn("ma_cross", signal(F.col("_f") > F.col("_s"), F.col("_f") < F.col("_s")))


def trend_strength(df: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 60, 120)) -> DataFrame:
    """Share of moving averages below the close, scaled to [-1, 1]; an unknown one counts as not below."""
    below = [F.coalesce(F.col("close") > rolling(F.avg, "close", n), F.lit(False)).cast("double") for n in windows]
    return df.withColumn("trend_strength", reduce(lambda a, b: a + b, below) / len(windows) * 2 - 1)


def volatility_signal(df: DataFrame, n: int = 20, low: float = 0.12, high: float = 0.25) -> DataFrame:
    df = df.withColumn("_r", pct_change("close")).withColumn("realised", rolling(F.stddev_samp, "_r", n) * 252**0.5)
    return df.withColumn("vol_signal", signal(F.col("realised") < low, F.col("realised") > high))


def drawdown_signal(df: DataFrame, most: float = 0.1, back: float = 0.05) -> DataFrame:
    """SHORT below the running peak by ``most``; NEUTRAL on the row that recovers above ``back``; else LONG."""
    df = df.withColumn("dd", F.try_divide("close", F.max("close").over(series().rowsBetween(W.unboundedPreceding, 0))) - 1)
    before = F.lag("dd").over(series())
    return df.withColumn("dd_signal", F.when(F.col("dd") < -most, SHORT).when((before < -most) & (F.col("dd") > -back), NEUTRAL).otherwise(LONG))


def trailing_stop(df: DataFrame, stop: float = 0.05, n: int = 20) -> DataFrame:
    return df.withColumn("stopped", F.col("close") < (1 - stop) * F.max("close").over(series().rowsBetween(-(n - 1), 0)))


def breadth(df: DataFrame, n: int = 20) -> DataFrame:
    """Of a panel: per date advances, declines, the smoothed share of advances, its signal, and the advance-decline line."""
    df = df.withColumn("_r", pct_change("close")).groupBy("dt").agg(F.count(F.when(F.col("_r") > 0, 1)).alias("up"), F.count(F.when(F.col("_r") < 0, 1)).alias("down"))
    order = W.orderBy("dt")  # one row a date
    df = df.withColumn("_share", F.when(F.col("up") + F.col("down") > 0, F.col("up") / (F.col("up") + F.col("down"))))
    df = df.withColumn("breadth", rolling(F.avg, "_share", n, n, order)).withColumn("ad_line", F.sum(F.col("up") - F.col("down")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return df.withColumn("breadth_signal", signal(F.col("breadth") > 0.6, F.col("breadth") < 0.4))


def flow_signal(df: DataFrame, flow: str, n: int = 5, base: int = 60, least: int = 20, threshold: float = 0.5) -> DataFrame:
    """Rolling sum of a flow as z-score of its own longer window."""
    df = df.withColumn("_s", rolling(F.sum, flow, n))
    df = df.withColumns({"_m": rolling(F.avg, "_s", base, least), "_d": rolling(F.stddev_samp, "_s", base, least)})
    z = F.when(F.col("_d") > 0, (F.col("_s") - F.col("_m")) / F.col("_d"))
    return df.withColumn("flow_z", z).withColumn("flow_signal", signal(F.col("flow_z") > threshold, F.col("flow_z") < -threshold))


def seasonal(df: DataFrame) -> DataFrame:
    month = F.month("dt")
    return df.withColumn("seasonal", signal(month.isin(1, 2, 12), month.between(5, 9)))


def regime(df: DataFrame, n: int = 60) -> DataFrame:
    df = df.withColumn("_r", pct_change("close")).withColumns({"_ma": rolling(F.avg, "close", n), "_v": rolling(F.stddev_samp, "_r", n) * 252**0.5})
    up, down = (F.col("close") > F.col("_ma")) & (F.col("_v") < 0.2), (F.col("close") < F.col("_ma")) & (F.col("_v") > 0.25)
    return df.withColumn("regime", F.when(up, "BULL").when(down, "BEAR").otherwise("SIDEWAYS"))


def policy_calendar(df: DataFrame, events: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Signal of the last listed event (event_seq, event_day, signal) whose days cover a date.

    Each event is spelled out into its few days, which makes the range join an equi-join.
    """
    events = events.groupBy("event_day").agg(F.max_by("signal", "event_seq").alias("signal"), F.max("event_seq").alias("event_seq"))  # a day's last event decides
    days = events.withColumn("dt", F.explode(F.sequence(F.date_sub("event_day", before), F.date_add("event_day", after))))
    last = days.groupBy("dt").agg(F.max_by("signal", "event_seq").alias("policy"))
    return df.join(last, "dt", "left").withColumn("policy", F.coalesce("policy", F.lit(NEUTRAL)))


def fuse(df: DataFrame, weights: dict[str, float], threshold: float = 0.2) -> DataFrame:
    """Weighted sum of signals as +-1 and 0, and the fused signal and exposure (1, 0.5 or 0.2)."""
    total = sum(weights.values())
    score = reduce(lambda a, b: a + b, (F.when(F.col(c) == LONG, 1.0).when(F.col(c) == SHORT, -1.0).otherwise(0.0) * (w / total) for c, w in weights.items()))
    df = df.withColumn("score", score).withColumn("fused", signal(F.col("score") > threshold, F.col("score") < -threshold))
    return df.withColumn("exposure", F.when(F.col("fused") == LONG, 1.0).when(F.col("fused") == SHORT, 0.2).otherwise(0.5))


def fuse_dma(df: DataFrame, signals: list[str], forgetting: float = 0.95) -> DataFrame:
    """dt, dma: signals weighted by their discounted past hit rates, a recursion over one short series."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        s = np.column_stack([rows[c].map({LONG: 1.0, SHORT: -1.0}).fillna(0.0) for c in signals])
        ret = rows["close"].pct_change().fillna(0.0).to_numpy()
        log, out = np.zeros(len(signals)), []
        for i in range(len(rows)):
            if i:
                hit = s[i - 1] * np.sign(ret[i])
                log = forgetting * log + np.log(np.where(hit > 0, 0.6, np.where(hit < 0, 0.4, 0.5)))
            w = np.exp(log - log.max())
            out.append(float(w @ s[i] / w.sum()))
        return pd.DataFrame({"code": rows["code"], "dt": rows["dt"], "dma": out})

    return df.select("code", "dt", "close", *signals).groupBy("code").applyInPandas(run, "code string, dt date, dma double")


def market_features(df: DataFrame) -> DataFrame:
    """Trend (close on its means of 20 and 60 rows, less 1), annual volatility of 20 and 60, volume of 10 on 60, returns of 5 and 20 rows, of every row."""
    df = df.withColumn("_r", pct_change("close"))
    mean = lambda x, n: rolling(F.avg, x, n)
    return df.withColumns({
        "trend_20": F.try_divide("close", mean("close", 20)) - 1, "trend_60": F.try_divide("close", mean("close", 60)) - 1,
        "vol_20": rolling(F.stddev_samp, "_r", 20) * 252**0.5, "vol_60": rolling(F.stddev_samp, "_r", 60) * 252**0.5,
        "volume_ratio": F.try_divide(mean("volume", 10), mean("volume", 60)), "ret_5": pct_change("close", 5), "ret_20": pct_change("close", 20),
    })


def size_spread(df: DataFrame, share: float = 0.3, n: int = 20) -> DataFrame:
    """dt, spread, mean_spread: mean return (ret) of the smallest ``share`` by cap less that of the largest, and its mean over the last n rows."""
    place = F.percent_rank().over(W.partitionBy("dt").orderBy("cap", "code"))
    sides = df.filter("ret is not null").withColumn("_p", place).groupBy("dt").agg(F.avg(F.when(F.col("_p") <= share, F.col("ret"))).alias("small"), F.avg(F.when(F.col("_p") >= 1 - share, F.col("ret"))).alias("large"))
    last = W.orderBy("dt").rowsBetween(-(n - 1), 0)  # one row a date
    out = sides.withColumn("spread", F.col("small") - F.col("large"))
    return out.select("dt", "spread", F.avg("spread").over(last).alias("mean_spread"))


def sector_dispersion(df: DataFrame, sector: str = "industry", least: int = 3) -> DataFrame:
    """dt, dispersion: the deviation of the sectors' mean returns (ret) on a date; null below ``least`` sectors."""
    per = df.filter("ret is not null").groupBy("dt", sector).agg(F.avg("ret").alias("r"))
    return per.groupBy("dt").agg(F.when(F.count("r") >= least, F.stddev_samp("r")).alias("dispersion"))


def fuse_by_hits(df: DataFrame, signals: list[str], alpha: float = 10.0, beta: float = 10.0, threshold: float = 0.2) -> DataFrame:
    """score and fused: signals weighed by the posterior mean of their hit rate, Beta(alpha, beta) before any.

    A hit is a signal whose sign the next row's return has. Only rows before the date count, so nothing
    is known in advance.
    """
    nxt = F.try_divide(F.lead("close").over(series()), "close") - 1
    side = {s: F.when(F.col(s) == LONG, 1.0).when(F.col(s) == SHORT, -1.0).otherwise(0.0) for s in signals}
    df = df.withColumn("_n", nxt)
    df = df.withColumns({f"_h_{s}": F.when((x != 0) & F.col("_n").isNotNull(), (x * F.col("_n") > 0).cast("double")) for s, x in side.items()})
    past = series().rowsBetween(W.unboundedPreceding, -1)  # a hit of the row before is known only now: its return ends here
    weight = {s: (alpha + F.coalesce(F.sum(f"_h_{s}").over(past), F.lit(0.0))) / (alpha + beta + F.count(f"_h_{s}").over(past)) for s in signals}
    df = df.withColumns({f"weight_{s}": w for s, w in weight.items()})
    top = reduce(lambda a, b: a + b, (F.col(f"weight_{s}") * x for s, x in side.items()))
    df = df.withColumn("score", top / reduce(lambda a, b: a + b, (F.col(f"weight_{s}") for s in signals)))
    return df.withColumn("fused", signal(F.col("score") > threshold, F.col("score") < -threshold))


def resampled(df: DataFrame, blends: dict[int, float], fast: int = 5, slow: int = 20) -> DataFrame:
    """score: the trend (1, 0 or -1 by fast and slow means) of closes taken every k rows, weighed by ``blends`` {k: weight}.

    A block's close is known at its last row; until the next block ends the signal stands.
    """
    place = F.row_number().over(series())
    df = df.withColumn("_i", place)
    terms = []
    for k, weight in blends.items():
        ends = F.col("_i") % k == 0
        block = W.partitionBy("code", ends).orderBy("dt")
        mean = lambda n: F.when(F.count("close").over(block.rowsBetween(-(n - 1), 0)) >= n, F.avg("close").over(block.rowsBetween(-(n - 1), 0)))
        df = df.withColumn(f"_t{k}", F.when(ends & mean(slow).isNotNull(), F.signum(mean(fast) - mean(slow))))
        df = df.withColumn(f"_t{k}", F.last(f"_t{k}", ignorenulls=True).over(series().rowsBetween(W.unboundedPreceding, 0)))
        terms.append(F.coalesce(f"_t{k}", F.lit(0.0)) * weight)
    return df.withColumn("score", reduce(lambda a, b: a + b, terms))
