"""Market equilibrium and views joined to posterior returns (Black-Litterman), and decay with an offset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _nearest(v: np.ndarray, cap: float) -> np.ndarray:
    """The nearest point with entries within [0, cap] that sum to 1, exactly: the sum falls along straight lines between the places where an entry meets a bound. For few keys (a table of 2k by k)."""
    shifts = np.sort(np.concatenate([v, v - cap]))
    total = np.clip(v - shifts[:, None], 0, cap).sum(axis=1)
    i = int(np.clip(np.searchsorted(-total, -1.0, side="right") - 1, 0, len(shifts) - 2))
    fall = total[i] - total[i + 1]
    shift = shifts[i] + ((total[i] - 1) / fall * (shifts[i + 1] - shifts[i]) if fall > 0 else 0.0)
    return np.clip(v - shift, 0, cap)


def best_weights(mu: np.ndarray, cov: np.ndarray, aversion: float, cap: float, steps: int = 300) -> np.ndarray:
    """Long-only weights of most mu.w - aversion / 2 w.cov.w, by projected gradient from equal ones."""
    w, rate = _nearest(np.full(len(mu), 1 / len(mu)), cap), 1 / max(aversion * np.linalg.eigvalsh(cov).max(), 1e-9)
    for _ in range(steps):
        w = _nearest(w + rate * (mu - aversion * cov @ w), cap)
    return w


def posterior_returns(cov: np.ndarray, market: np.ndarray, views: np.ndarray, tau: float, delta: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Equilibrium returns ``delta * cov @ market``, and their posterior given views on single keys (NaN: no view).

    A view's variance is ``tau`` times its key's own. The update is written with the matrix of the views only, so a
    singular covariance is no obstacle; without views the posterior is the equilibrium.
    """
    prior = delta * cov @ market
    on = np.flatnonzero(~np.isnan(views))
    if not len(on):
        return prior, prior
    gain = tau * cov[:, on] @ np.linalg.pinv(tau * cov[np.ix_(on, on)] + np.diag(tau * np.diag(cov)[on]))
    return prior, prior + gain @ (views[on] - prior[on])


def black_litterman(cov: DataFrame, keys: DataFrame, taus: list[float], delta: float = 2.5, aversion: float = 1.0, cap: float = 1.0) -> DataFrame:
    """dt, tau, key, prior, posterior, weight: per date and each of ``taus`` (how far views move the equilibrium).

    ``cov``: a, b (a <= b), dt, cov of few keys, as ``rolling_covariance`` gives. ``keys``: dt, key, market (share,
    null: 0), view (null: none). Keys of a date are those with a variance; market shares are brought to sum to one.
    A date with fewer than two keys gets no row. One date is one matrix of keys by keys, solved in its own group.
    """

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part.a == part.b].sort_values("a")
        at = {k: i for i, k in enumerate(own.a)}
        pairs = part[part.a.isin(at) & part.b.isin(at)]
        m = np.zeros((len(at), len(at)))
        i, j = pairs.a.map(at).to_numpy(), pairs.b.map(at).to_numpy()
        m[i, j] = m[j, i] = pairs["cov"].to_numpy()
        market = own.market.fillna(0).to_numpy(dtype=float)
        market = market / market.sum() if market.sum() > 0 else np.full(len(at), 1 / max(len(at), 1))
        out = []
        for tau in taus if len(at) > 1 else []:
            prior, post = posterior_returns(m, market, own["view"].to_numpy(dtype=float), tau, delta)
            out.append(pd.DataFrame({"dt": own.dt.to_numpy(), "tau": tau, "key": own.a.to_numpy(), "prior": prior, "posterior": post, "weight": best_weights(post, m, aversion, cap)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["dt", "tau", "key", "prior", "posterior", "weight"])

    rows = cov.join(keys.select("dt", F.col("key").alias("a"), "market", "view"), ["dt", "a"], "left").select("dt", "a", "b", "cov", "market", "view")
    return rows.groupBy("dt").applyInPandas(solve, f"dt date, tau double, key {dict(cov.dtypes)['a']}, prior double, posterior double, weight double")


def decay_with_offset(ic: DataFrame, key: str, low: float = 0.001, high: float = 3.0, steps: int = 80, least: int = 20) -> DataFrame:
    """key, n, rate, initial, steady, half_life, decaying: ``initial * exp(-rate * t) + steady`` fitted to each key's ICs (key, dt, ic).

    t counts a key's known ICs by date from 0. For a given rate the rest is a regression on exp(-rate * t), so only
    the rate is searched: on a geometric grid from ``low`` to ``high``, then twenty times finer beside the best. It
    decays where the rate exceeds 0.005 and the half-life is below four fifths of the series. Below ``least`` ICs all
    but n are null.
    """
    ratio = (high / low) ** (1 / steps)
    known = ic.filter("ic is not null").withColumn("t", (F.row_number().over(W.partitionBy(key).orderBy("dt")) - 1).cast("double"))
    rows = known.select(key, "t", "ic")

    def fit(with_rates: DataFrame) -> DataFrame:
        x = F.exp(-F.col("rate") * F.col("t"))
        sums = with_rates.withColumn("x", x).groupBy(key, "rate").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("ic", "x").alias("initial"), F.regr_intercept("ic", "x").alias("steady"), F.regr_syy("ic", "x").alias("yy"), F.regr_sxx("ic", "x").alias("xx"))
        off = F.col("yy") - F.col("initial") ** 2 * F.col("xx")
        best = F.row_number().over(W.partitionBy(key).orderBy(off.asc_nulls_last(), "rate"))
        return sums.withColumn("_rn", best).filter("_rn = 1").drop("_rn", "yy", "xx")

    coarse = fit(rows.withColumn("rate", F.explode(F.array(*(F.lit(low * ratio**k) for k in range(steps + 1))))))
    fine = rows.join(coarse.select(key, F.col("rate").alias("_r")), key)
    fine = fine.withColumn("_m", F.explode(F.array(*(F.lit(ratio ** (k / 20)) for k in range(-20, 21)))))
    fine = fit(fine.withColumn("rate", F.col("_r") * F.col("_m")))
    enough = F.col("n") >= least
    half = F.lit(float(np.log(2))) / F.col("rate")
    return fine.select(key, "n", *(F.when(enough, c).alias(name) for name, c in (("rate", F.col("rate")), ("initial", F.col("initial")), ("steady", F.col("steady")), ("half_life", half))), F.when(enough, (F.col("rate") > 0.005) & (half < F.col("n") * 0.8)).alias("decaying"))
