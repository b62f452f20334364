"""Fundamental factors: trailing and lagged items, valuation, quality, accruals, analyst revisions, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import clip, col, rolling, safe_divide


def periods() -> W:
    return W.partitionBy("code").orderBy("end_date")


def trailing(df: DataFrame, flows: list[str], stocks: list[str]) -> DataFrame:
    """{flow}_ttm (four periods), {flow}_yoy, {stock}_prev (a period before): one window, one shuffle."""
    w = periods()
    out = {f"{c}_ttm": rolling(F.sum, c, 4, 4, w) for c in flows}
    out |= {f"{c}_yoy": safe_divide(F.col(c) - F.lag(c, 4).over(w), F.abs(F.lag(c, 4).over(w))) for c in flows}
    out |= {f"{c}_prev": F.lag(c).over(w) for c in stocks}
    return df.withColumns(out)


def valuation(df: DataFrame, cap: str = "cap") -> DataFrame:
    """Earnings, book, sales and cash-flow yields on market capitalisation."""
    return df.withColumns({"ep_ttm": safe_divide("net_profit_ttm", cap), "bp": safe_divide("equity", cap), "sp_ttm": safe_divide("revenue_ttm", cap), "cfp_ttm": safe_divide("cfo_ttm", cap)})


def mean_of(now: str, before: Column) -> Column:
    return (F.col(now) + before) / 2


def quality(df: DataFrame) -> DataFrame:
    """Returns on mean equity (a missing earlier equity counts as 90 % of the present one) and mean assets, margins, current ratio, goodwill share."""
    equity = mean_of("equity", F.coalesce("equity_prev", F.col("equity") * 0.9))
    assets = mean_of("assets", F.coalesce("assets_prev", "assets"))
    return df.withColumns({
        "roe": safe_divide("net_profit", equity), "roa": safe_divide("net_profit", assets), "gross_margin": safe_divide("gross_profit", "revenue"),
        "net_margin": safe_divide("net_profit", "revenue"), "current_ratio": safe_divide("current_assets", "current_liabilities"), "goodwill_ratio": safe_divide("goodwill", "equity"),
    })


def earnings_quality(df: DataFrame) -> DataFrame:
    """Accruals on mean assets, distance of cash flow from profit, cash flow on profit within +-5, stability of eight periods."""
    assets = mean_of("assets", F.coalesce("assets_prev", "assets"))
    eight = periods().rowsBetween(-7, 0)
    spread = clip(safe_divide(F.stddev_samp("net_profit").over(eight), F.abs(F.avg("net_profit").over(eight))), 0.0, 10.0)
    return df.withColumns({
        "sloan_accrual": safe_divide(F.col("net_profit") - F.col("cfo"), assets), "cash_gap": safe_divide(F.abs(F.col("cfo") - F.col("net_profit")), F.abs("net_profit")),
        "cfo_to_profit": clip(safe_divide("cfo", "net_profit"), -5.0, 5.0), "stability": F.when(F.count("net_profit").over(eight) >= 4, 1 / (1 + spread)),
    })


def analyst(df: DataFrame, actual: str, expected: str, n: int = 8, least: int = 4) -> DataFrame:
    """Surprise against the expectation, the surprise in its own rolling deviations (SUE), and the revision of the expectation."""
    w = periods()
    df = df.withColumn("_gap", F.col(actual) - F.col(expected))
    before = F.lag(expected).over(w)
    return df.withColumns({
        "surprise": safe_divide("_gap", F.abs(col(expected))), "sue": safe_divide("_gap", rolling(F.stddev_samp, "_gap", n, least, w)),
        "revision": safe_divide(F.col(expected) - before, F.abs(before)),
    })


def concentration(holders: DataFrame, n: int = 10) -> DataFrame:
    """Share of the n largest holders (ties by holder) in each code's latest period: code, end_date, top_share."""
    keys = ["code", "end_date"]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("amount").desc(), "holder"))
    per = holders.withColumn("_rn", place).groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col("_rn") <= n, F.col("amount"))), F.sum("amount")).alias("top_share"))
    last = per.groupBy("code").agg(F.max(F.struct("end_date", "top_share")).alias("v"))
    return last.select("code", "v.*")
