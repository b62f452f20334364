"""Registered queries: weights from IC history, feature choice, redundant factors, orthogonal factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators import weighting as wt
from .registry import query
from .research import CORR, LABELS, labelled

FACTORS = ["f", "g", "turnover", "fwd_lag"]
#: Labels with a fourth factor that repeats another nearly.
MANY = f"{LABELS}, ym AS (SELECT *, g + 0.05 * f AS fwd_lag FROM y)"
TALL = f"""{MANY}, tl AS (SELECT code, dt, fwd_1, unnest(['f', 'g', 'turnover', 'fwd_lag']) AS factor, unnest([f, g, turnover, fwd_lag]) AS x FROM ym),
  fi AS (SELECT factor, dt, count(*) AS n, {CORR.format('x', 'fwd_1')} AS ic FROM tl WHERE x IS NOT NULL AND fwd_1 IS NOT NULL GROUP BY 1, 2 HAVING {CORR.format('x', 'fwd_1')} IS NOT NULL)"""
RW = f"""{TALL}, rm AS (SELECT *, count(ic) OVER w AS c, avg(ic) OVER w AS m, stddev_samp(ic) OVER w AS s FROM fi WINDOW w AS (PARTITION BY factor ORDER BY dt ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
  rr AS (SELECT dt, factor, greatest(m / s, 0) AS w FROM rm WHERE c >= 3 AND s > 1e-12), rw AS (SELECT dt, factor, CASE WHEN sum(w) OVER d > 0 THEN w / sum(w) OVER d ELSE 1.0 / count(*) OVER d END AS weight FROM rr WINDOW d AS (PARTITION BY dt))"""


def many(spark, d):
    return labelled(spark, d).withColumn("fwd_lag", F.col("g") + 0.05 * F.col("f"))


@query("factor dt n", "ic", f"WITH {TALL} --- SELECT * FROM fi")
def factor_ics(spark, d):
    return wt.factor_ics(many(spark, d), FACTORS, "fwd_1")


@query("dt factor", "weight", f"WITH {RW} --- SELECT * FROM rw")
def weights_rolling_ic(spark, d):
    return wt.rolling_ic_weights(wt.factor_ics(many(spark, d), FACTORS, "fwd_1"))


@query("code dt", "score", f"WITH {RW} --- SELECT code, dt, CASE WHEN sum(weight) > 0 THEN sum(x * weight) / sum(weight) ELSE avg(x) END AS score FROM tl JOIN rw USING (dt, factor) WHERE x IS NOT NULL GROUP BY 1, 2")
def score_ic_weighted(spark, d):
    df = many(spark, d)
    weights = wt.rolling_ic_weights(wt.factor_ics(df, FACTORS, "fwd_1"))
    return wt.ic_weighted_score(df, weights, FACTORS)


PAIRS = f"{MANY}, pr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {CORR.format(a, b).replace('>= 10', '>= 2')} AS corr FROM ym WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]) + ")"


@query("a b n", "corr", f"WITH {PAIRS} --- SELECT * FROM pr")
def factor_correlations(spark, d):
    return wt.correlation_pairs(many(spark, d), FACTORS)


EVAL = f"""{PAIRS}, tk AS (SELECT code, dt, fwd_1, unnest(['f', 'g', 'turnover', 'fwd_lag']) AS feature, unnest([f, g, turnover, fwd_lag]) AS x FROM ym),
  rk AS (SELECT *, rank() OVER (PARTITION BY feature, dt ORDER BY x) + (count(*) OVER (PARTITION BY feature, dt, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature, dt ORDER BY fwd_1) + (count(*) OVER (PARTITION BY feature, dt, fwd_1) - 1) / 2.0 AS b FROM tk WHERE x IS NOT NULL AND fwd_1 IS NOT NULL),
  ei AS (SELECT feature, avg(ic) AS ic FROM (SELECT feature, dt, {CORR.format('a', 'b')} AS ic FROM rk GROUP BY 1, 2) GROUP BY 1), ec AS (SELECT feature, avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage FROM tk GROUP BY 1),
  em AS (SELECT feature, max(abs(corr)) AS max_corr FROM (SELECT a AS feature, corr FROM pr UNION ALL SELECT b, corr FROM pr) GROUP BY 1), ev AS (SELECT *, abs(ic) * coverage * (1 - 0.5 * max_corr) AS importance FROM ec JOIN ei USING (feature) JOIN em USING (feature))"""


@query("feature", "ic coverage max_corr importance", f"WITH {EVAL} --- SELECT * FROM ev")
def features_evaluated(spark, d):
    return wt.evaluate_features(many(spark, d), FACTORS, "fwd_1")


@query("feature kept", "importance", f"""WITH {EVAL}, o AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS p FROM ev), lk AS (SELECT a, b FROM pr WHERE abs(corr) >= 0.9 UNION ALL SELECT b, a FROM pr WHERE abs(corr) >= 0.9) ---
  SELECT feature, importance, NOT EXISTS (SELECT 1 FROM lk JOIN o z ON z.feature = lk.b WHERE lk.a = o.feature AND z.p < o.p) AS kept FROM o""")
def features_selected(spark, d):
    return wt.select_features(many(spark, d), FACTORS, "fwd_1")


@query("a b dropped", "corr", f"WITH {EVAL} --- SELECT a, b, corr, CASE WHEN abs(x.ic) >= abs(z.ic) THEN b ELSE a END AS dropped FROM pr JOIN ev x ON x.feature = a JOIN ev z ON z.feature = b WHERE abs(corr) > 0.7")
def factors_redundant(spark, d):
    df = many(spark, d)
    return wt.redundant(wt.correlation_pairs(df, FACTORS), wt.evaluate_features(df, FACTORS, "fwd_1"))


@query("code dt", "f g turnover")
def orthogonal_symmetric(spark, d):
    return wt.orthogonalize_symmetric(labelled(spark, d), ["f", "g", "turnover"])


@query("code dt", "pc1")
def orthogonal_components(spark, d):
    return wt.principal_components(many(spark, d), FACTORS)


@query("code dt", "g", f"""WITH {LABELS}, k AS (SELECT code, dt, f, g FROM y WHERE f IS NOT NULL AND g IS NOT NULL), m AS (SELECT regr_slope(g, f) AS b, regr_intercept(g, f) AS a FROM k), r AS (SELECT code, dt, g - a - b * f AS e FROM k, m) ---
  SELECT code, dt, e / (SELECT stddev_pop(e) FROM r) AS g FROM r""")
def orthogonal_regression(spark, d):
    return wt.regress_out(labelled(spark, d), "g", ["f"])
