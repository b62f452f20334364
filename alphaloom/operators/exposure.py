"""Style exposures, specific risk, risk decomposition, budgets, limits, stress and eligibility."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.columns import date, pct_change, rolling, safe_divide, series

from .price import beta

STYLES = ["size", "nonlinear_size", "momentum", "reversal", "volatility", "liquidity", "book_to_price", "earnings_yield", "growth", "leverage", "beta", "residual_volatility"]


def style_exposures(df: DataFrame) -> DataFrame:
    """code, dt and twelve styles from close, turnover, cap, equity, assets, liabilities, net_profit and revenue_yoy (as known on dt).

    Beta and residual volatility are those of a row's last 24 returns against the mean return of all securities.
    """
    size = F.ln(F.when(F.col("cap") > 0, F.col("cap")))
    df = beta(df, df.withColumn("_r", pct_change("close")).groupBy("dt").agg(F.avg("_r").alias("mkt"))).withColumn("_r", F.col("ret"))
    return df.withColumn("size", size).select(
        "code", "dt", "size", F.pow(F.col("size") - F.avg("size").over(date()), 3).alias("nonlinear_size"),
        safe_divide(F.lag("close", 1).over(series()) - F.lag("close", 12).over(series()), F.lag("close", 12).over(series())).alias("momentum"), F.col("_r").alias("reversal"),
        rolling(F.stddev_samp, "_r", 12, 6).alias("volatility"), F.when(F.col("turnover") > 0, F.ln("turnover")).alias("liquidity"),
        safe_divide("equity", "cap").alias("book_to_price"), safe_divide("net_profit", "cap").alias("earnings_yield"), F.col("revenue_yoy").alias("growth"), safe_divide("liabilities", "assets").alias("leverage"),
        "beta", F.when(F.col("beta").isNotNull(), F.col("idio_vol")).alias("residual_volatility"),
    )


def barra_residuals(df: DataFrame, returns: DataFrame, label: str, styles: list[str]) -> DataFrame:
    """``df`` with residual: the label less the date's market return and each style's exposure times its return.

    ``returns`` is long (dt, factor, ret) with a factor ``market``, as ``barra_returns`` gives it. Null where an exposure, the
    label or a return is unknown.
    """
    names = ["market", *styles]
    wide = returns.groupBy("dt").agg(*(F.max(F.when(F.col("factor") == n, F.col("ret"))).alias(f"_f_{n}") for n in names))
    fit = reduce(lambda a, b: a + b, (F.col(s) * F.col(f"_f_{s}") for s in styles), F.col("_f_market"))
    return df.join(F.broadcast(wide), "dt", "left").withColumn("residual", F.col(label) - fit).drop(*(f"_f_{n}" for n in names))  # a row a date


def factor_covariance(returns: DataFrame) -> DataFrame:
    """a, b, cov: sample covariance of each two factors' returns over the dates that know both (factors are few)."""
    x, y = (returns.select("dt", F.col("factor").alias(n), F.col("ret").alias(f"_{n}")) for n in "ab")
    return x.join(y, "dt").groupBy("a", "b").agg(F.covar_samp("_a", "_b").alias("cov"))


def specific_variance(residuals: DataFrame, x: str = "residual", halflife: float = 20.0) -> DataFrame:
    """code, n, specific: mean square of a code's residuals, weights halving every ``halflife`` rows back."""
    age = F.row_number().over(W.partitionBy("code").orderBy(F.col("dt").desc())) - 1
    df = residuals.filter(F.col(x).isNotNull()).withColumn("_w", F.exp(-float(np.log(2)) / halflife * age))
    return df.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col("_w") * F.col(x) * F.col(x)), F.sum("_w")).alias("specific"))


def decompose_risk(exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> DataFrame:
    """code, systematic (x' F x), specific, total, factor_share from long exposures (code, factor, x) and a full covariance table (a, b, cov).

    The covariance table has factors by factors rows (under a thousand for thirty factors) and is broadcast.
    """
    x = exposures.select("code", F.col("factor").alias("a"), F.col("x").alias("xa"))
    y = exposures.select("code", F.col("factor").alias("b"), F.col("x").alias("xb"))
    part = x.join(F.broadcast(factor_cov), "a").join(y, ["code", "b"])  # factors by factors
    out = part.groupBy("code").agg(F.sum(F.col("xa") * F.col("cov") * F.col("xb")).alias("systematic")).join(specific.select("code", "specific"), "code")
    return out.withColumn("total", F.col("systematic") + F.col("specific")).withColumn("factor_share", safe_divide("systematic", "total", 1e-15))


def risk_budget(df: DataFrame, total: float = 0.15, method: str = "icir") -> DataFrame:
    """Budget of each factor (factor, risk, icir): equal, in proportion to |icir|, or in inverse proportion to its risk."""
    raw = {"equal": F.lit(1.0), "icir": F.abs("icir"), "parity": safe_divide(F.lit(1.0), "risk")}[method]
    every = W.partitionBy()  # a row a factor
    df = df.withColumn("_b", F.coalesce(raw, F.lit(0.0)))
    return df.withColumn("budget", F.when(F.sum("_b").over(every) > 0, F.col("_b") / F.sum("_b").over(every)).otherwise(1 / F.count(F.lit(1)).over(every)) * total).drop("_b")


#: Actions by the worst excess over its limit, and what each leaves of the exposure (fixed values).
ACTIONS = {"none": 1.0, "reduce_factor": 0.7, "reduce": 0.5, "stop": 0.2}


def check_limits(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """breaches (how many measures exceed their limit), worst (largest measure on its limit), action and multiplier of each row."""
    ratios = {m: F.coalesce(F.col(m) / limit, F.lit(0.0)) for m, limit in limits.items()}
    worst = F.greatest(*ratios.values()) if len(ratios) > 1 else next(iter(ratios.values()))
    df = df.withColumns({"breaches": reduce(lambda a, r: a + (r > 1).cast("int"), ratios.values(), F.lit(0)), "worst": worst})
    action = F.when(F.col("worst") > 2, "stop").when(F.col("breaches") > 1, "reduce").when(F.col("breaches") == 1, "reduce_factor").otherwise("none")
    df = df.withColumn("action", action)
    return df.withColumn("multiplier", reduce(lambda acc, kv: acc.when(F.col("action") == kv[0], kv[1]), ACTIONS.items(), F.when(F.lit(False), 0.0)))


def eligible(df: DataFrame, day: str, new_days: int = 60, least_volume: float = 0.0) -> DataFrame:
    """Rows of ``day`` that may be bought: no special treatment, listed for over ``new_days``, not limit-up, not suspended, traded enough."""
    at = F.lit(day).cast("date")
    return df.filter((F.col("dt") == at) & ~F.coalesce("is_st", F.lit(False)) & (F.datediff(at, "list_date") > new_days) & ~F.coalesce("limit_up", F.lit(False)) & (F.col("volume") > least_volume))


def stress_periods(weights: DataFrame, returns: DataFrame, periods: dict[str, tuple[str, str]], x: str) -> DataFrame:
    """period, n (dates), loss (compounded return), worst: what the weights (code, weight) would have made in each of the periods."""
    held = returns.join(weights.select("code", "weight"), "code").groupBy("dt").agg(F.sum(F.col("weight") * F.coalesce(x, F.lit(0.0))).alias("r"))
    spans = F.array(*(F.struct(F.lit(name).alias("period"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for name, (a, b) in periods.items()))
    inside = held.withColumn("_s", F.explode(spans)).filter("dt between _s.a and _s.b")
    return inside.groupBy("_s.period").agg(F.count(F.lit(1)).alias("n"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("loss"), F.min("r").alias("worst"))


def stress_shocks(weights: DataFrame, shocks: DataFrame, key: str) -> DataFrame:
    """scenario, loss of weights (``key``, weight) under shocks (scenario, ``key``, shock); a key without a shock does not move."""
    return weights.join(F.broadcast(shocks), key).groupBy("scenario").agg(F.sum(F.col("weight") * F.col("shock")).alias("loss"))  # a row a scenario and key


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t, by integrating its density over the angle whose tangent is x / sqrt(df)."""
    theta = np.linspace(-np.pi / 2, np.pi / 2, 200_001)[1:-1]
    density = np.cos(theta) ** (df - 1)
    mass = np.cumsum(density) - density / 2
    return float(np.tan(np.interp(p, mass / mass[-1], theta)) * np.sqrt(df))


def simulated_var(df: DataFrame, x: str, confidence: float = 0.95, draws: int = 20_000, horizon: int = 1, seed: int = 1) -> DataFrame:
    """code, n, normal (Monte Carlo), student: value at risk of each code's returns, as positive losses.

    The degrees of freedom are 6 / excess kurtosis + 4, within 2.1 and 100. Draws are seeded, the same for every code.
    """
    z = np.random.default_rng(seed).standard_normal((draws, horizon)).sum(axis=1)
    low = float(np.quantile(z, 1 - confidence))

    def run(batches):
        known: dict[float, float] = {}
        for b in batches:
            nu = np.clip(6 / np.maximum(b["kurt"].fillna(0).to_numpy(), 1e-6) + 4, 2.1, 100).round(2)
            q = np.array([known.setdefault(v, t_quantile(1 - confidence, v)) if v not in known else known[v] for v in nu])
            yield pd.DataFrame({"code": b["code"], "n": b["n"], "normal": -(b["m"] * horizon + b["sd"] * low), "student": -(b["m"] + b["sd"] * q * np.sqrt((nu - 2) / nu))})

    stats = df.filter(F.col(x).isNotNull()).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"), F.kurtosis(x).alias("kurt")).filter("n > 3 and sd > 0")
    return stats.mapInPandas(run, f"code {dict(df.dtypes)['code']}, n long, normal double, student double")


def rolling_covariance(df: DataFrame, key: str, x: str, n: int = 12) -> DataFrame:
    """a, b, dt, cov: sample covariance of each two series (few) over the last ``n`` dates that both have."""
    p = df.filter(F.col(x).isNotNull()).select("dt", F.col(key).alias("a"), F.col(x).alias("xa"))
    pairs = p.join(p.select("dt", F.col("a").alias("b"), F.col("xa").alias("xb")), "dt").filter("a <= b")  # keys by keys
    w = W.partitionBy("a", "b").orderBy("dt").rowsBetween(-(n - 1), 0)
    return pairs.select("a", "b", "dt", F.when(F.count(F.lit(1)).over(w) >= n, F.covar_samp("xa", "xb").over(w)).alias("cov")).filter("cov is not null")


def pnl_attribution(positions: DataFrame, exposures: DataFrame) -> DataFrame:
    """dt, factor, pnl: each position's profit (dt, code, pnl) split by its factors' shares of absolute exposure; without any exposure: ``specific``."""
    e = exposures.filter("x is not null and x <> 0").select("dt", "code", "factor", F.abs("x").alias("_x"))
    share = F.try_divide("_x", F.sum("_x").over(W.partitionBy("dt", "code")))
    met = positions.join(e.withColumn("_s", share), ["dt", "code"], "left")
    return met.groupBy("dt", F.coalesce("factor", F.lit("specific")).alias("factor")).agg(F.sum(F.col("pnl") * F.coalesce("_s", F.lit(1.0))).alias("pnl"))


def cost_filter(new: DataFrame, old: DataFrame, least: float) -> DataFrame:
    """dt, code, weight: the new weight where it differs from the old by ``least`` or more, else the old; a missing one is 0, and weights of 0 go."""
    both = new.select("dt", "code", F.col("weight").alias("_n")).join(old.select("dt", "code", F.col("weight").alias("_o")), ["dt", "code"], "full_outer").fillna(0.0, ["_n", "_o"])
    return both.select("dt", "code", F.when(F.abs(F.col("_n") - F.col("_o")) < least, F.col("_o")).otherwise(F.col("_n")).alias("weight")).filter("weight <> 0")


def rebalance_days(calendar: DataFrame) -> DataFrame:
    """dt, weekly, biweekly, monthly: whether the day is the last open one of its week, of each second week, of its month (a calendar has one row a day)."""
    days = calendar.select("dt").distinct()
    w = W.orderBy("dt")
    after = F.lead("dt").over(w)
    week = F.floor((F.unix_date("dt") + 3) / 7)  # weeks begin on Monday
    days = days.withColumns({"_a": after, "_w": week})
    last_of_week = F.col("_a").isNull() | (F.floor((F.unix_date("_a") + 3) / 7) != F.col("_w"))
    return days.select("dt", last_of_week.alias("weekly"), (last_of_week & (F.col("_w") % 2 == 0)).alias("biweekly"), (F.col("_a").isNull() | (F.month("_a") != F.month("dt"))).alias("monthly"))
