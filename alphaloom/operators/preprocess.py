"""Cross-sectional preprocessing: fill, winsorise, standardise, neutralise, all as windows over a date."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import average_rank, clip, date, normal_quantile, series

MAD_SCALE = 1.4826


def fill(df: DataFrame, x: str, how: str = "median", industry: str = "industry") -> DataFrame:
    """Null becomes the date's mean or median, the industry's mean on the date, or 0."""
    value = {"mean": lambda: F.avg(x).over(date()), "median": lambda: F.median(x).over(date()), "industry": lambda: F.avg(x).over(date("dt", industry)), "zero": lambda: F.lit(0.0)}[how]()
    return df.withColumn(x, F.coalesce(x, value))


def fill_decay(df: DataFrame, x: str, rate: float = 0.1) -> DataFrame:
    """The last known value times exp(-rate * rows since)."""
    w = series().rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_run", F.count(x).over(w))
    k = F.row_number().over(W.partitionBy("code", "_run").orderBy("dt")) - 1
    return df.withColumn("_last", F.last(x, ignorenulls=True).over(w)).withColumn(x, F.col("_last") * F.exp(-rate * k))


def winsorize(df: DataFrame, x: str, how: str = "mad", p: float = 3.0, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to median +- p scaled MADs (MAD 0: quantiles), to quantiles, or to mean +- p sigma."""
    d = date()
    if how == "quantile":
        return df.withColumn(x, clip(x, F.expr(f"percentile({x}, {low}) OVER (PARTITION BY dt)"), F.expr(f"percentile({x}, {high}) OVER (PARTITION BY dt)")))
    if how == "sigma":
        mean, sd = F.avg(x).over(d), F.stddev_samp(x).over(d)
        return df.withColumn(x, F.when(sd > 0, clip(x, mean - p * sd, mean + p * sd)).otherwise(F.col(x)))
    df = df.withColumn("_med", F.median(x).over(d)).withColumn("_mad", F.median(F.abs(F.col(x) - F.col("_med"))).over(d) * MAD_SCALE)
    q = [F.expr(f"percentile({x}, {k}) OVER (PARTITION BY dt)") for k in (low, high)]
    return df.withColumn(x, F.when(F.col("_mad") > 0, clip(x, F.col("_med") - p * F.col("_mad"), F.col("_med") + p * F.col("_mad"))).otherwise(clip(x, *q))).drop("_med", "_mad")


def standardize(df: DataFrame, x: str, how: str = "zscore", out: str | None = None) -> DataFrame:
    """zscore, rank (average rank / n), rank_zscore, minmax (degenerate: 0.5), rank_normal, robust."""
    out, d = out or x, date()
    if how in ("rank", "rank_zscore", "rank_normal"):
        df = df.withColumn("_r", average_rank(x))
        n = F.count(x).over(d)
        if how == "rank":
            value = F.col("_r") / n
        elif how == "rank_zscore":
            sd = F.stddev_samp("_r").over(d)
            value = F.when(sd > 0, (F.col("_r") - F.avg("_r").over(d)) / sd).otherwise(F.col("_r") - F.avg("_r").over(d))
        else:
            value = normal_quantile(clip(F.col("_r") / (n + 1), 0.001, 0.999))
        return df.withColumn(out, value).drop("_r")
    if how == "minmax":
        low, high = F.min(x).over(d), F.max(x).over(d)
        return df.withColumn(out, F.when(high > low, (F.col(x) - low) / (high - low)).otherwise(F.lit(0.5)))
    if how == "robust":
        df = df.withColumn("_med", F.median(x).over(d)).withColumn("_mad", F.median(F.abs(F.col(x) - F.col("_med"))).over(d) * MAD_SCALE)
        return df.withColumn(out, F.when(F.col("_mad") > 0, (F.col(x) - F.col("_med")) / F.col("_mad")).otherwise(F.col(x) - F.col("_med"))).drop("_med", "_mad")
    mean, sd = F.avg(x).over(d), F.stddev_samp(x).over(d)
    return df.withColumn(out, F.when(sd > 0, (F.col(x) - mean) / sd).otherwise(F.col(x) - mean))


def neutralize_industry(df: DataFrame, x: str, industry: str = "industry") -> DataFrame:
    """x less its industry's mean on the date (null industry: null)."""
    return df.withColumn(x, F.when(F.col(industry).isNotNull(), F.col(x) - F.avg(x).over(date("dt", industry))))


def _slope_residual(df: DataFrame, x: str, c: Column, least: int) -> DataFrame:
    d = date()
    df = df.withColumn("_c", F.when(F.col(x).isNotNull(), c)).withColumns({"_y": F.when(F.col("_c").isNotNull(), F.col(x))})
    n, vx = F.count("_y").over(d), F.var_samp("_c").over(d)
    fit = F.covar_samp("_c", "_y").over(d) / vx
    return df.withColumn(x, F.when((n >= least) & (vx > 1e-12), F.col(x) - F.avg("_y").over(d) - fit * (F.col("_c") - F.avg("_c").over(d))).otherwise(F.col(x))).drop("_c", "_y")


def neutralize_constrained(df: DataFrame, x: str, industry: str = "industry", weight: str | None = None, shares: str | None = None) -> DataFrame:
    """x replaced by its residual on a market level and all industries, with ``market`` (the level) and ``effect`` (the industry's).

    Weighted least squares per date (``weight``: null, zero or negative rows do not count; default 1 each) under one
    constraint that makes all dummies identifiable: the effects sum to zero over the industries, or, given a
    column ``shares`` (capitalisation), their mean weighted by the industries' sums of it is zero. The
    dummies span the industries' weighted means, so the residual is x less that mean, the market is the (weighted) mean of the
    means, and each effect is what an industry's mean adds. Rows of unknown x, industry or weight have no
    residual and bind nothing.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ok = F.col(x).isNotNull() & F.col(industry).isNotNull() & (w > 0)
    df = df.withColumns({"_w": F.when(ok, w), "_x": F.when(ok, F.col(x))})
    own, day = date("dt", industry), date()
    df = df.withColumn("_m", F.sum(F.col("_w") * F.col("_x")).over(own) / F.sum("_w").over(own))
    part = F.coalesce(F.when(ok, F.col(shares)), F.lit(0.0)) if shares else F.when(ok, 1 / F.count("_w").over(own))  # each industry counts once
    df = df.withColumn("_s", F.when(ok, part))
    df = df.withColumn("market", F.try_divide(F.sum(F.col("_s") * F.col("_m")).over(day), F.sum("_s").over(day)))
    return df.withColumns({x: F.col("_x") - F.col("_m"), "effect": F.when(F.col("_w").isNotNull(), F.col("_m") - F.col("market"))}).drop("_w", "_x", "_m", "_s")


def neutralize_cap(df: DataFrame, x: str, cap: str = "cap", least: int = 10, log: bool = True) -> DataFrame:
    """Residual of x on ln(cap) (or cap) per date; fewer than ``least`` rows stay as they are."""
    return _slope_residual(df, x, F.ln(cap) if log else F.col(cap), least)


def neutralize_industry_cap(df: DataFrame, x: str, industry: str = "industry", cap: str = "cap") -> DataFrame:
    """Residual on industry dummies and ln(cap), by partialling the industries out of both."""
    by = date("dt", industry)
    df = df.withColumn("_lc", F.when(F.col(x).isNotNull(), F.ln(cap)))
    df = df.withColumns({"_xt": F.col(x) - F.avg(x).over(by), "_ct": F.col("_lc") - F.avg("_lc").over(by)})
    den = F.sum(F.col("_ct") * F.col("_ct")).over(date())
    slope = F.when(den > 1e-12, F.sum(F.col("_xt") * F.col("_ct")).over(date()) / den).otherwise(F.lit(0.0))
    return df.withColumn(x, F.col("_xt") - slope * F.col("_ct")).drop("_lc", "_xt", "_ct")


def residual(df: DataFrame, y: str, controls: list[str], least: int | None = None) -> DataFrame:
    """code, dt and the least-squares residual of y on several controls per date (below ``least`` rows: y)."""
    least = least or len(controls) + 5

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["code", "dt"]].copy()
        value = rows[y].astype(float)
        ok = rows[[y, *controls]].notna().all(axis=1)
        if ok.sum() >= least:
            a = np.column_stack([np.ones(ok.sum()), rows.loc[ok, controls].astype(float)])
            fit, *_ = np.linalg.lstsq(a, value[ok], rcond=None)
            value = value.where(ok)
            value[ok] = value[ok] - a @ fit
        out["residual"] = value
        return out

    kinds = dict(df.dtypes)
    return df.select("code", "dt", y, *controls).groupBy("dt").applyInPandas(run, f"code {kinds['code']}, dt date, residual double")


def preprocess(df: DataFrame, x: str, direction: int = 1) -> DataFrame:
    """fill with the median, clip by MAD, neutralise by industry and cap, z-score, align the direction."""
    df = winsorize(fill(df, x), x)
    df = standardize(neutralize_industry_cap(df, x), x)
    return df.withColumn(x, F.col(x) * direction)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of known values per date."""
    return df.groupBy("dt").agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_coverage") for c in columns))


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """{column}_missing: 1 where the column is null, else 0."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def winsorize_adaptive(df: DataFrame, x: str, vol: str, long_vol: str, p: float = 3.0) -> DataFrame:
    """Clip to median +- k scaled MADs, where k is ``p`` times the date's volatility on the long-run one, within a half and twice ``p`` (unknown: ``p``)."""
    d = date()
    scale = F.when(F.col(long_vol) > 0, clip(F.col(vol) / F.col(long_vol), 0.5, 2.0))
    df = df.withColumn("_k", p * F.coalesce(scale, F.lit(1.0))).withColumn("_med", F.median(x).over(d)).withColumn("_mad", F.median(F.abs(F.col(x) - F.col("_med"))).over(d) * MAD_SCALE)
    return df.withColumn(x, F.when(F.col("_mad") > 0, clip(x, F.col("_med") - F.col("_k") * F.col("_mad"), F.col("_med") + F.col("_k") * F.col("_mad"))).otherwise(F.col(x))).drop("_k", "_med", "_mad")


def training_table(df: DataFrame, factors: list[str], label: str, industry: str = "industry") -> DataFrame:
    """code, dt, {factor}_rank (average rank on known rows of the date, 0 to 1) and target (the label less its industry's mean), rows with a label."""
    known = df.filter(F.col(label).isNotNull())
    ranks = {f"{f}_rank": F.try_divide(average_rank(f), F.count(f).over(date())) for f in factors}
    return known.withColumns(ranks | {"target": F.col(label) - F.avg(label).over(date("dt", industry))}).select("code", "dt", *ranks, "target")
