"""Price, volume and flow factors per security over rows ordered by date.

Every function takes a panel with code, dt and price columns and adds factor columns; windows share
one partitioning and order, so a panel is shuffled once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import clip, pct_change, rolling, safe_divide, series


def momentum(df: DataFrame, short: int = 1, skips: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """ret_reversal = c / c[-short] - 1; ret_{k}_skip = c[-short] / c[-k] - 1."""
    lag = lambda n: F.lag("close", n).over(series())
    out = df.withColumn("ret_reversal", safe_divide("close", lag(short)) - 1)
    for k in skips:
        out = out.withColumn(f"ret_{k}_skip", safe_divide(lag(short), lag(k)) - 1)
    return out


def returns(df: DataFrame) -> DataFrame:
    return df.withColumn("ret", pct_change("close"))


def volatility(df: DataFrame, n: int = 20, least: int = 10, year: int = 252) -> DataFrame:
    return returns(df).withColumn("vol", rolling(F.stddev_samp, "ret", n, least) * (year**0.5))


def liquidity(df: DataFrame, n: int = 20, least: int = 10, still: float = 0.01) -> DataFrame:
    """Mean turnover, Amihud illiquidity and share of still days (the first row counts as not still)."""
    df = returns(df)
    df = df.withColumn("_ill", safe_divide(F.abs("ret"), "amount")).withColumn("_still", F.coalesce(F.abs("ret") < still, F.lit(False)).cast("double"))
    return df.withColumns({"turnover_mean": rolling(F.avg, "turnover", n, least), "amihud": rolling(F.avg, "_ill", n, least) * 1e6, "zero_ratio": rolling(F.avg, "_still", n, least)})


def price_volume_corr(df: DataFrame, n: int = 20) -> DataFrame:
    """Rolling Pearson correlation of return and volume, null for a constant side."""
    df = returns(df)
    w = series().rowsBetween(-(n - 1), 0)
    v = F.when(F.col("ret").isNotNull(), F.col("volume").cast("double"))
    spread = F.stddev_samp("ret").over(w) * F.stddev_samp(v).over(w)
    return df.withColumn("pv_corr", F.when((F.count("ret").over(w) >= n) & (spread > 1e-12), F.covar_samp("ret", v).over(w) / spread))


def high_low_ratio(df: DataFrame, n: int = 10) -> DataFrame:
    df = df.withColumn("_hl", safe_divide(2 * (F.col("high") - F.col("low")), F.col("high") + F.col("low")))
    return df.withColumn("hl_ratio", rolling(F.avg, "_hl", n))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Position within the band of mean +- k std, clipped to [-1, 1]."""
    df = df.withColumns({"_ma": rolling(F.avg, "close", n), "_sd": rolling(F.stddev_samp, "close", n)})
    return df.withColumn("bollinger", clip(safe_divide(F.col("close") - F.col("_ma"), k * F.col("_sd")), -1.0, 1.0))


def obv_ratio(df: DataFrame, n: int = 20, least: int = 10) -> DataFrame:
    """On-balance volume over its rolling mean, less 1, clipped to +-3."""
    df = returns(df).withColumn("_obv", F.sum(F.coalesce(F.signum("ret"), F.lit(0.0)) * F.col("volume")).over(series().rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("_obv_mean", rolling(F.avg, "_obv", n, least))
    return df.withColumn("obv_ratio", clip(safe_divide("_obv", "_obv_mean") - 1, -3.0, 3.0))


def microstructure(df: DataFrame, n: int = 20, least: int = 5) -> DataFrame:
    """Overnight return, ratio of mean absolute intraday to overnight returns, and return times relative volume."""
    df = df.withColumns({"_over": safe_divide("open", F.lag("close").over(series())) - 1, "_intra": safe_divide("close", "open") - 1})
    df = returns(df).withColumns({"_a": F.abs("_intra"), "_b": F.abs("_over"), "_v": F.abs("ret") * safe_divide("volume", rolling(F.avg, "volume", n, least))})
    return df.withColumns({
        "overnight": rolling(F.avg, "_over", n, least), "intraday_ratio": safe_divide(rolling(F.avg, "_a", n, least), rolling(F.avg, "_b", n, least)), "vpin": rolling(F.avg, "_v", n, least),
    })


def beta(df: DataFrame, market: DataFrame, n: int = 24, least: int = 12) -> DataFrame:
    """Rolling beta to a market return (dt, mkt) and the residual's standard deviation."""
    df = returns(df).join(F.broadcast(market.select("dt", "mkt")), "dt", "left")  # a row a date
    w = series().rowsBetween(-(n - 1), 0)
    both = F.col("ret").isNotNull() & F.col("mkt").isNotNull()
    x, y = F.when(both, F.col("mkt")), F.when(both, F.col("ret"))
    df = df.withColumns({"_k": F.count(x).over(w), "_vx": F.var_samp(x).over(w), "_vy": F.var_samp(y).over(w), "_cxy": F.covar_samp(x, y).over(w)})  # each once
    df = df.withColumn("beta", F.when((F.col("_k") >= least) & (F.col("_vx") > 1e-12), F.try_divide("_cxy", "_vx")))
    return df.withColumn("idio_vol", F.sqrt(F.greatest(F.lit(0.0), F.col("_vy") - F.col("beta") * F.col("beta") * F.col("_vx"))))


def drawdown(df: DataFrame, n: int = 60) -> DataFrame:
    """Price against its rolling maximum and the worst of it within the window."""
    df = df.withColumn("_dd", safe_divide("close", F.max("close").over(series().rowsBetween(-(n - 1), 0))) - 1)
    return df.withColumn("max_drawdown", F.min("_dd").over(series().rowsBetween(-(n - 1), 0)))


def ema_family(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, rsi: int = 14) -> DataFrame:
    """code, dt, macd_signal (percent of close) and rsi: recursions, one security at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        close = rows["close"].astype(float)
        dif = close.ewm(span=fast, adjust=False).mean() - close.ewm(span=slow, adjust=False).mean()
        dea = dif.ewm(span=signal, adjust=False).mean()
        macd = (dif - dea) / close * 100 if len(rows) >= slow + signal else pd.Series(np.nan, index=rows.index)
        step = close.diff()
        gain = step.clip(lower=0).fillna(0.0).ewm(alpha=1 / rsi, adjust=False).mean()
        loss = (-step.clip(upper=0)).fillna(0.0).ewm(alpha=1 / rsi, adjust=False).mean()
        strength = 100 * gain / (gain + loss).where(gain + loss > 0)
        strength[np.arange(len(rows)) < rsi] = np.nan
        return pd.DataFrame({"code": rows["code"], "dt": rows["dt"], "macd_signal": macd, "rsi": strength})

    kind = dict(df.dtypes)["code"]
    return df.select("code", "dt", "close").groupBy("code").applyInPandas(run, f"code {kind}, dt date, macd_signal double, rsi double")


def rolling_features(df: DataFrame, columns: list[str], windows: tuple[int, ...] = (5, 10)) -> DataFrame:
    """{column}_{mean|std|max|min}_{n} of every column and window."""
    aggs = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    return df.withColumns({f"{c}_{name}_{n}": rolling(agg, c, n) for c in columns for n in windows for name, agg in aggs.items()})


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Product, ratio, sum, difference and squares of column pairs."""
    out = {}
    for a, b in pairs:
        x, y = F.col(a), F.col(b)
        out |= {f"{a}_x_{b}": x * y, f"{a}_over_{b}": safe_divide(x, y), f"{a}_plus_{b}": x + y, f"{a}_minus_{b}": x - y, f"{a}_squared": x * x}
    return df.withColumns(out)
