"""Registered queries: cleaning and rotating factors, choosing in turn, capacity, models, hidden regimes, optimisers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from alphaloom.operators import cleaning as cl
from alphaloom.operators import learning, regimes, risk
from alphaloom.operators import performance as pf
from alphaloom.operators import portfolio as po
from alphaloom.operators import selection as sl

from .adaptive import FACTORS, Z, index_returns
from .registry import query
from .research import LABELS, labelled
from .strategy import WEIGHTS, industry_returns, scored

KNOWN = f"{LABELS}, k AS (SELECT code, dt, f, g, turnover FROM y WHERE f IS NOT NULL AND g IS NOT NULL AND turnover IS NOT NULL)"
_ON = "{0} - CASE WHEN sum({1} * {1}) OVER d > 1e-15 THEN sum({0} * {1}) OVER d / sum({1} * {1}) OVER d ELSE 0 END * {1} AS {0}"


@query("code dt", "f g turnover", f"""WITH {KNOWN}, c AS (SELECT code, dt, f - avg(f) OVER d AS f, g - avg(g) OVER d AS g, turnover - avg(turnover) OVER d AS turnover FROM k WINDOW d AS (PARTITION BY dt)),
  o1 AS (SELECT code, dt, f, {_ON.format('g', 'f')}, {_ON.format('turnover', 'f')} FROM c WINDOW d AS (PARTITION BY dt)) --- SELECT code, dt, f, g, {_ON.format('turnover', 'g')} FROM o1 WINDOW d AS (PARTITION BY dt)""")
def factor_orthogonal(spark, d):
    return cl.orthogonalize(labelled(spark, d), FACTORS)


@query("dt", "mean_corr max_corr mean_vif", f"""WITH {KNOWN}, r AS (SELECT dt, corr(f, g) AS a, corr(f, turnover) AS b, corr(g, turnover) AS c FROM k GROUP BY dt HAVING count(*) >= 10) ---
  SELECT dt, (abs(a) + abs(b) + abs(c)) / 3 AS mean_corr, greatest(abs(a), abs(b), abs(c)) AS max_corr, (3 - a * a - b * b - c * c) / 3 / (1 + 2 * a * b * c - a * a - b * b - c * c) AS mean_vif FROM r""", 5)
def factor_independence(spark, d):
    return cl.independence(labelled(spark, d), FACTORS)


@query("code dt", "f g turnover")
def fill_chained(spark, d):
    return cl.impute_chained(labelled(spark, d), FACTORS)


@query("code dt", "f g turnover")
def winsorize_isolation(spark, d):
    return cl.mask_isolated(labelled(spark, d), FACTORS)


@query("code dt", "f g", f"""WITH {LABELS}, a AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY f DESC NULLS LAST, code) AS p, count(*) OVER (PARTITION BY dt) AS n FROM y),
  b AS (SELECT * EXCLUDE (p, n), row_number() OVER (PARTITION BY dt ORDER BY g DESC NULLS LAST, code) AS p, count(*) OVER (PARTITION BY dt) AS n FROM a WHERE p <= ceil(n * 0.5)) --- SELECT * FROM b WHERE p <= ceil(n * 0.2)""")
def selection_in_turn(spark, d):
    return sl.filter_in_turn(labelled(spark, d), [("f", 0.5), ("g", 0.2)])


@query("code dt", "score", f"WITH {LABELS}, z AS (SELECT code, dt, {Z.format('f')} AS a, {Z.format('turnover')} AS b FROM y) --- SELECT code, dt, coalesce(0.6 * a + 0.4 * b, a, b) AS score FROM z")
def score_blend(spark, d):
    return sl.blend(labelled(spark, d), "f", "turnover")


LEVELS = [1e5, 1e6, 1e7, 1e8, 1e9, 1e10]
HELD = f"{WEIGHTS}, held AS (SELECT w.code, w.dt, w.weight, y.fwd_1, y.amount, (y.high - y.low) / y.close AS vol FROM wt w JOIN y ON w.code = y.code AND w.dt = y.dt)"
CAPITAL = f"""{HELD}, ca AS (SELECT *, 0.0005 + 0.3 * weight * capital / amount * vol AS rate FROM held, (SELECT unnest([{', '.join(f'{x:.1f}::DOUBLE' for x in LEVELS)}]) AS capital) WHERE amount > 0 AND fwd_1 IS NOT NULL),
  cd AS (SELECT capital, dt, sum(weight * (fwd_1 - rate)) AS r, sum(weight * rate) AS s FROM ca GROUP BY 1, 2), cl AS (SELECT capital, avg(r) * 12 AS annual, avg(r) / nullif(stddev_samp(r), 0) * sqrt(12) AS sharpe, avg(s) AS slippage FROM cd GROUP BY 1)"""


def held(spark, d):
    bars = labelled(spark, d).select("code", "dt", "fwd_1", "amount", ((F.col("high") - F.col("low")) / F.col("close")).alias("vol"))
    return po.score_weights(scored(spark, d)).select("code", "dt", "weight").join(bars, ["code", "dt"])


@query("code dt", "participation impact", f"WITH {HELD}, p AS (SELECT *, weight * 1e8 / amount AS participation FROM held WHERE amount > 0) --- SELECT *, vol * sqrt(participation / 0.1) AS impact FROM p")
def portfolio_impact(spark, d):
    return sl.market_impact(held(spark, d).filter("amount > 0"), 1e8, "weight")


@query("capital", "annual sharpe slippage", f"WITH {CAPITAL} --- SELECT * FROM cl", 5)
def capacity_levels(spark, d):
    return sl.capital_levels(held(spark, d), LEVELS)


@query("", "capacity", f"""WITH {CAPITAL}, g AS (SELECT *, 0.8 * first_value(annual) OVER (ORDER BY capital) AS goal, lag(capital) OVER (ORDER BY capital) AS c0, lag(annual) OVER (ORDER BY capital) AS a0 FROM cl) ---
  SELECT CASE WHEN max(goal) > 0 THEN coalesce(min(CASE WHEN annual < goal AND a0 >= goal THEN c0 + (a0 - goal) / (a0 - annual) * (capital - c0) END), max(capital)) END AS capacity FROM g""", 2)
def capacity_limit(spark, d):
    return sl.capacity(sl.capital_levels(held(spark, d), LEVELS))


@query("code dt", "ridge boosted stacked")
def stacked_predictions(spark, d):
    return learning.stacked(labelled(spark, d), FACTORS, "fwd_1")


@query("", "auc", digits=4)
def drift_adversarial(spark, d):
    y = labelled(spark, d)
    early = F.col("dt") < F.lit("1998-06-30").cast("date")
    return spark.createDataFrame([(learning.adversarial_auc(y.filter(early), y.filter(~early), FACTORS),)], "auc double")


@query("code dt state", "p_state", digits=4)
def timing_hidden_regime(spark, d):
    return regimes.hidden_regimes(index_returns(spark, d).withColumn("code", F.lit("index")), "ret")


@query("industry", "max_sharpe max_diversification hierarchical", digits=4)
def risk_optimisers(spark, d):
    """Over a matrix of industries; the matrix of a market's industries is small whatever the number of rows."""
    r = industry_returns(spark, d)
    keys, cov = pf.covariance_matrix(pf.covariance_pairs(r, "industry", "r"))
    mean = {row["industry"]: row["m"] for row in r.groupBy("industry").agg(F.avg("r").alias("m")).collect()}
    mu = np.array([mean[k] for k in keys])
    columns = [risk.max_sharpe(mu, cov, 0.5), risk.max_diversification(cov, 0.5), risk.hierarchical_parity(cov)]
    return spark.createDataFrame([(int(k), *(float(c[i]) for c in columns)) for i, k in enumerate(keys)], "industry int, max_sharpe double, max_diversification double, hierarchical double")
