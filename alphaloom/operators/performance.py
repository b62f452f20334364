"""Performance and risk of return series, and covariances from long tables."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import pct_change, rolling, series

YEAR = 252


def metrics(df: DataFrame, rate: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """Per code: rows, total and annual return, volatility, downside deviation, Sharpe, Sortino, VaR, CVaR, drawdown, Calmar, win rate, profit-loss ratio."""
    df = df.withColumn("ret", pct_change("close"))
    df = df.withColumn("dd", F.try_divide("close", F.max("close").over(series().rowsBetween(W.unboundedPreceding, 0))) - 1)
    tail = df.groupBy("code").agg(F.percentile("ret", 1 - confidence).alias("var"))
    df = df.join(tail, "code")
    out = df.groupBy("code").agg(
        F.count("ret").alias("n"), (F.try_divide(F.max_by("close", "dt"), F.min_by("close", "dt")) - 1).alias("total"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"),
        F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"), F.first("var").alias("var"), F.avg(F.when(F.col("ret") <= F.col("var"), F.col("ret"))).alias("cvar"),
        F.min("dd").alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.try_divide(F.avg(F.when(F.col("ret") > 0, F.col("ret"))), -F.avg(F.when(F.col("ret") < 0, F.col("ret")))).alias("pl_ratio"),
    )
    return out.withColumns({
        "annual": F.when((F.col("n") > 0) & (F.col("total") > -1), F.pow(1 + F.col("total"), F.lit(float(YEAR)) / F.col("n")) - 1), "volatility": F.col("sd") * YEAR**0.5,
        "sharpe": F.when(F.col("sd") > 0, (F.col("mean") - rate / YEAR) / F.col("sd") * YEAR**0.5), "sortino": F.when(F.col("down") > 0, (F.col("mean") - rate / YEAR) / F.col("down") * YEAR**0.5),
    }).withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("annual") / -F.col("max_drawdown")))


def period_returns(df: DataFrame, period: str = "quarter") -> DataFrame:
    """Compounded return of each calendar period."""
    df = df.withColumn("ret", pct_change("close")).withColumn("period", F.to_date(F.date_trunc(period, "dt")))
    return df.groupBy("code", "period").agg((F.exp(F.sum(F.log1p(F.when(F.col("ret") > -1, F.col("ret"))))) - 1).alias("ret"))


def rolling_performance(df: DataFrame, n: int = 60) -> DataFrame:
    df = df.withColumn("ret", pct_change("close"))
    df = df.withColumns({"_m": rolling(F.avg, "ret", n), "_s": rolling(F.stddev_samp, "ret", n), "_l": rolling(F.sum, F.log1p(F.when(F.col("ret") > -1, F.col("ret"))), n)})
    return df.withColumns({"sharpe": F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * YEAR**0.5), "volatility": F.col("_s") * YEAR**0.5, "compound": F.exp("_l") - 1})


def report(df: DataFrame, n: int = 12) -> DataFrame:
    """code, section, item, value: the whole report of each code's closes, one row a figure.

    Sections: ``metrics`` (of all rows), ``quarters`` (count, best, worst, mean and share above 0 of compounded
    quarters), ``drawdowns`` (spells, rows under a peak, the longest spell, the deepest) and ``rolling`` (Sharpe ratio,
    volatility and return of the last ``n`` rows). A figure that cannot be told is a row with a null value.
    """
    total = metrics(df)
    named = ["total", "annual", "volatility", "sharpe", "sortino", "var", "cvar", "max_drawdown", "calmar", "win_rate", "pl_ratio"]
    quarters = period_returns(df).groupBy("code").agg(F.count("ret").cast("double").alias("count"), F.max("ret").alias("best"), F.min("ret").alias("worst"), F.avg("ret").alias("mean"), F.avg((F.col("ret") > 0).cast("double")).alias("above_0"))
    spells = drawdown_spells(df).groupBy("code").agg(F.count(F.lit(1)).cast("double").alias("spells"), F.sum("rows").cast("double").alias("rows_under"), F.max("rows").cast("double").alias("longest"), F.min("depth").alias("deepest"))
    last = F.row_number().over(W.partitionBy("code").orderBy(F.desc("dt"))) == 1
    rolled = rolling_performance(df, n).withColumn("_last", last).filter("_last")
    parts = [("metrics", total, named), ("quarters", quarters, ["count", "best", "worst", "mean", "above_0"]), ("drawdowns", spells, ["spells", "rows_under", "longest", "deepest"]), ("rolling", rolled, ["sharpe", "volatility", "compound"])]
    tall = [part.select("code", F.lit(section).alias("section"), *(F.col(c).cast("double") for c in items)).unpivot(["code", "section"], items, "item", "value") for section, part, items in parts]
    return reduce(lambda a, b: a.unionByName(b), tall)


def drawdown_spells(df: DataFrame) -> DataFrame:
    """Each stretch below a peak: code, spell, first_day, last_day, rows, depth."""
    df = df.withColumn("dd", F.try_divide("close", F.max("close").over(series().rowsBetween(W.unboundedPreceding, 0))) - 1)
    df = df.withColumn("spell", F.sum((F.col("dd") == 0).cast("int")).over(series().rowsBetween(W.unboundedPreceding, 0))).filter("dd < 0")
    return df.groupBy("code", "spell").agg(F.min("dt").alias("first_day"), F.max("dt").alias("last_day"), F.count(F.lit(1)).alias("rows"), F.min("dd").alias("depth"))


def regime_performance(df: DataFrame, regimes: DataFrame, least: int = 5) -> DataFrame:
    df = df.withColumn("ret", pct_change("close")).join(regimes.select("dt", "regime"), "dt")
    return df.groupBy("regime").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd")).filter(F.col("n") >= least)


def brinson(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Allocation, selection and interaction per date and key of (dt, key, w, r) tables; a key that is not held has weight 0 and the benchmark's return."""
    b = benchmark.select("dt", "key", F.col("w").alias("bw"), F.col("r").alias("br"))
    b = b.withColumn("_t", F.sum(F.col("bw") * F.col("br")).over(W.partitionBy("dt")))
    both = b.join(portfolio, ["dt", "key"], "left").withColumns({"w": F.coalesce("w", F.lit(0.0)), "r": F.coalesce("r", "br")})
    return both.withColumns({
        "allocation": (F.col("w") - F.col("bw")) * (F.col("br") - F.col("_t")), "selection": F.col("bw") * (F.col("r") - F.col("br")), "interaction": (F.col("w") - F.col("bw")) * (F.col("r") - F.col("br")),
    })


def covariance_pairs(df: DataFrame, key: str, value: str, on: str = "dt", least: int = 12) -> DataFrame:
    """Pairwise covariance of series (key, on, value): a, b (a <= b), n, cov. Keys are few (industries, factors), never securities."""
    x = df.filter(F.col(value).isNotNull()).select(on, F.col(key).alias("a"), F.col(value).alias("x"))
    y = x.select(on, F.col("a").alias("b"), F.col("x").alias("y"))
    return x.join(y, on).filter("a <= b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("x", "y").alias("cov")).filter(F.col("n") >= least)


def covariance_matrix(pairs: DataFrame, most: int = 500) -> tuple[list, np.ndarray]:
    """The keys and the dense matrix of a pair table of at most ``most`` keys."""
    rows = pairs.limit(most * (most + 1) // 2 + 1).collect()
    keys = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    if len(keys) > most:
        raise ValueError("too many keys for a dense matrix")
    place = {k: i for i, k in enumerate(keys)}
    out = np.zeros((len(keys), len(keys)))
    for r in rows:
        out[place[r["a"]], place[r["b"]]] = out[place[r["b"]], place[r["a"]]] = r["cov"]
    return keys, out


def risk_contributions(w: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Shares of portfolio variance."""
    total = w @ cov @ w
    return w * (cov @ w) / total if total > 0 else np.zeros_like(w)


def ewma_variance(df: DataFrame, half: float = 20.0) -> DataFrame:
    """Per code: exponentially weighted variance of returns around their weighted mean, by rows before the last."""
    df = df.withColumn("ret", pct_change("close")).filter("ret is not null")
    age = F.row_number().over(W.partitionBy("code").orderBy(F.col("dt").desc())) - 1
    df = df.withColumn("_w", F.exp(-math.log(2) / half * age))
    sums = df.groupBy("code").agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("ret")).alias("wx"), F.sum(F.col("_w") * F.col("ret") * F.col("ret")).alias("wxx"))
    return sums.select("code", F.greatest(F.lit(0.0), F.col("wxx") / F.col("w") - F.pow(F.col("wx") / F.col("w"), F.lit(2.0))).alias("ewma_var"))


def backtest_var(df: DataFrame, n: int = 60, confidence: float = 0.95) -> DataFrame:
    """Per code: days tested, violations of the rolling historical VaR that excludes the day, and Kupiec's likelihood ratio."""
    df = df.withColumn("ret", pct_change("close"))
    past = f"OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    df = df.withColumns({"_c": F.expr(f"count(ret) {past}"), "_var": F.expr(f"percentile(ret, {1 - confidence}) {past}")}).filter((F.col("_c") >= n) & F.col("ret").isNotNull())
    out = df.groupBy("code").agg(F.count(F.lit(1)).alias("days"), F.count(F.when(F.col("ret") < F.col("_var"), 1)).alias("violations"))
    p, x, t = 1 - confidence, F.col("violations").cast("double"), F.col("days").cast("double")
    part = lambda k, q: F.when(k > 0, k * F.ln(q)).otherwise(F.lit(0.0))
    free = part(x, x / t) + part(t - x, 1 - x / t)
    return out.withColumn("kupiec", F.greatest(F.lit(0.0), 2 * (free - x * math.log(p) - (t - x) * math.log(1 - p))))


def barra_returns(df: DataFrame, label: str, styles: list[str], cap: str = "cap") -> DataFrame:
    """Factor returns per date by least squares weighted with the root of cap: dt, factor, ret.

    The normal equations are aggregates; a small dense system is solved per date.
    """
    import pandas as pd

    columns = ["_one", *styles]
    df = df.withColumn("_one", F.lit(1.0)).filter(" and ".join(f"`{c}` is not null" for c in [*styles, label, cap]))
    w = F.sqrt(F.col(cap))
    cells = [F.sum(w * F.col(a) * F.col(b)).alias(f"a{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    sums = df.groupBy("dt").agg(F.count(F.lit(1)).alias("n"), *cells, *(F.sum(w * F.col(c) * F.col(label)).alias(f"b{i}") for i, c in enumerate(columns)))
    k = len(columns)

    def run(batches):
        for rows in batches:
            out = []
            for _, r in rows.iterrows():
                a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                fit = np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(k)]), rcond=None)[0] if r["n"] > k + 2 else [None] * k
                out += [(r["dt"], name, v) for name, v in zip(["market", *styles], fit)]
            yield pd.DataFrame(out, columns=["dt", "factor", "ret"])

    return sums.mapInPandas(run, "dt date, factor string, ret double")
