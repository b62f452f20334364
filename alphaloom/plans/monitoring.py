"""Registered queries: exposures, crowding and daily risk of two models' portfolios, rebalancing by deviation, posterior returns, decay with an offset."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators import exposure as ex
from alphaloom.operators import monitoring as mo
from alphaloom.operators import portfolio as po
from alphaloom.operators import posterior as ps
from alphaloom.operators import research as rs
from alphaloom.sources.tables import dims

from .registry import query
from .research import ICS, labelled
from .strategy import WEIGHTS, industry_returns, scored

HELD = f"""{WEIGHTS}, eq AS (SELECT code, dt, row_number() OVER (PARTITION BY dt ORDER BY f DESC, code) AS k FROM y WHERE f IS NOT NULL), ho AS (SELECT 'blend' AS model, dt, code, weight FROM wt UNION ALL SELECT 'momentum', dt, code, 1.0 / count(*) OVER (PARTITION BY dt) FROM eq WHERE k <= 10)"""


def holdings(spark, d):
    """The scored model's weights and, as a second model, the ten largest of one factor in equal parts."""
    blend = po.score_weights(scored(spark, d)).select(F.lit("blend").alias("model"), "dt", "code", "weight")
    best = labelled(spark, d).filter("f is not null").withColumn("k", F.row_number().over(W.partitionBy("dt").orderBy(F.desc("f"), "code"))).filter("k <= 10")
    return blend.unionByName(best.select(F.lit("momentum").alias("model"), "dt", "code", (1.0 / F.count(F.lit(1)).over(W.partitionBy("dt"))).alias("weight")))


@query("model dt kind name", "exposure", f"""WITH {HELD}, fx AS (SELECT dt, code, unnest(['momentum', 'turnover']) AS factor, unnest([f, turnover]) AS x FROM y) ---
  SELECT model, dt, 'industry' AS kind, coalesce(CAST(industry AS VARCHAR), 'other') AS name, sum(weight) AS exposure FROM ho LEFT JOIN dims USING (code) GROUP BY ALL UNION ALL SELECT model, dt, 'style', factor, sum(weight * x) FROM ho JOIN fx USING (dt, code) WHERE x IS NOT NULL GROUP BY ALL""")
def monitor_exposures(spark, d):
    tall = labelled(spark, d).select("dt", "code", F.explode(F.create_map(F.lit("momentum"), "f", F.lit("turnover"), F.col("turnover").cast("double"))).alias("factor", "x"))
    return mo.held_exposures(holdings(spark, d), dims(spark, d), tall)


@query("model dt held shared", "crowding turnover", f"""WITH {HELD}, sh AS (SELECT *, count(*) OVER (PARTITION BY dt, code) > 1 AS twice FROM ho), ct AS (SELECT model, dt, count(*) AS held, count(*) FILTER (twice) AS shared FROM sh GROUP BY ALL), nx AS (SELECT *, lag(dt) OVER (PARTITION BY model ORDER BY dt) AS before FROM ct),
  nw AS (SELECT nx.model, nx.dt, code, weight FROM nx JOIN ho USING (model, dt) WHERE before IS NOT NULL), od AS (SELECT nx.model, nx.dt, code, weight FROM nx JOIN ho ON ho.model = nx.model AND ho.dt = nx.before),
  tn AS (SELECT model, dt, sum(abs(coalesce(nw.weight, 0) - coalesce(od.weight, 0))) / 2 AS turnover FROM nw FULL JOIN od USING (model, dt, code) GROUP BY ALL) --- SELECT model, dt, held, shared, shared / held AS crowding, turnover FROM nx LEFT JOIN tn USING (model, dt)""")
def monitor_crowding(spark, d):
    return mo.crowding(holdings(spark, d))


RISK = f"""{HELD}, dn AS (SELECT dt, row_number() OVER (ORDER BY dt) AS day FROM (SELECT dt FROM y WHERE g IS NOT NULL UNION SELECT dt FROM ho)), pr AS (SELECT day, code, g AS ret FROM y JOIN dn USING (dt) WHERE g IS NOT NULL),
  dr AS (SELECT model, ho.dt, pr.day, sum(weight * ret) AS r FROM ho JOIN dn USING (dt) JOIN pr ON pr.code = ho.code AND pr.day BETWEEN dn.day - 23 AND dn.day GROUP BY ALL), nv AS (SELECT *, product(1 + r) OVER (PARTITION BY model, dt ORDER BY day) AS nav, quantile_cont(r, 0.05) OVER (PARTITION BY model, dt) AS q FROM dr),
  fl AS (SELECT *, nav / nullif(max(nav) OVER (PARTITION BY model, dt ORDER BY day), 0) - 1 AS fall FROM nv), tl AS (SELECT model, dt, count(*) AS days, -first(q) AS var, -avg(r) FILTER (r <= q) AS cvar, min(fall) AS drawdown FROM fl GROUP BY ALL), mw AS (SELECT model, dt, max(weight) AS max_weight FROM ho GROUP BY ALL),
  rr AS (SELECT model, dt, coalesce(days, 0) AS days, max_weight, CASE WHEN days >= 12 THEN var END AS var, CASE WHEN days >= 12 THEN cvar END AS cvar, CASE WHEN days >= 12 THEN drawdown END AS drawdown FROM mw LEFT JOIN tl USING (model, dt))"""


def report(spark, d):
    return mo.risk_report(holdings(spark, d), labelled(spark, d).select("dt", "code", F.col("g").alias("ret")), 24, 12)


@query("model dt days", "max_weight var cvar drawdown", f"WITH {RISK} --- SELECT * FROM rr")
def monitor_risk(spark, d):
    return report(spark, d)


@query("model dt alert severity", "value bound", f"""WITH {RISK} --- SELECT model, dt, 'concentration' AS alert, 'high' AS severity, max_weight AS value, 0.15 AS bound FROM rr WHERE max_weight > 0.15 UNION ALL SELECT model, dt, 'var_breach', 'high', var, 0.02 FROM rr WHERE var > 0.02
  UNION ALL SELECT model, dt, 'cvar_breach', 'critical', cvar, 0.03 FROM rr WHERE cvar > 0.03 UNION ALL SELECT model, dt, 'drawdown_breach', 'critical', drawdown, -0.1 FROM rr WHERE drawdown < -0.1""")
def monitor_risk_alerts(spark, d):
    return mo.risk_alerts(report(spark, d), mo.Limits(weight=0.15))


@query("dt since rebalance", "deviation", f"""WITH RECURSIVE {WEIGHTS}, dn AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM wt)), hw AS (SELECT i, code, weight FROM wt JOIN dn USING (dt)),
  cm AS (SELECT x.i AS a, z.i AS b, sqrt(sum((x.weight - z.weight) ** 2)) AS deviation FROM hw x JOIN hw z ON x.code = z.code AND x.i <= z.i GROUP BY 1, 2), pr AS (SELECT x.i AS a, z.i AS b, deviation FROM dn x JOIN dn z ON x.i <= z.i LEFT JOIN cm ON a = x.i AND b = z.i),
  nx AS (SELECT a, min(b) AS b FROM pr WHERE b >= a + 2 AND (deviation IS NULL OR deviation > 0.3) GROUP BY a), ch AS (SELECT CAST(0 AS BIGINT) AS i UNION ALL SELECT nx.b FROM ch JOIN nx ON nx.a = ch.i),
  hs AS (SELECT dn.i, dn.dt, ch.i IS NOT NULL AS rebalance, coalesce((SELECT max(c.i) FROM ch c WHERE c.i < dn.i), 0) AS s FROM dn LEFT JOIN ch ON ch.i = dn.i) --- SELECT hs.dt, dn.dt AS since, rebalance, deviation FROM hs JOIN dn ON dn.i = s JOIN pr ON a = s AND b = hs.i""")
def rebalance_deviation(spark, d):
    return mo.rebalance_by_deviation(po.score_weights(scored(spark, d)).select("dt", "code", "weight"), 0.3, 2)


@query("dt key", "tau prior posterior weight")
def posterior_weights(spark, d):
    r = industry_returns(spark, d).filter("r is not null")
    share = dims(spark, d).groupBy(F.col("industry").alias("key")).agg(F.sum("cap").alias("market"))
    view = F.avg("r").over(W.partitionBy("industry").orderBy("dt").rowsBetween(-2, 0))
    keys = r.select("dt", F.col("industry").alias("key"), view.alias("view")).join(share, "key")
    return ps.black_litterman(ex.rolling_covariance(r, "industry", "r"), keys, [0.01, 0.05, 0.1])


_RATES = "[" + ", ".join(repr(0.001 * 3000 ** (k / 80)) for k in range(81)) + "]"
_FINE = "[" + ", ".join(repr(3000 ** (k / 1600)) for k in range(-20, 21)) + "]"
_SUMS = "count(*) AS n, regr_slope(ic, exp(-rate * t)) AS initial, regr_intercept(ic, exp(-rate * t)) AS steady, regr_syy(ic, exp(-rate * t)) - regr_slope(ic, exp(-rate * t)) ** 2 * regr_sxx(ic, exp(-rate * t)) AS off"
OFFSET = f"""{ICS}, st AS (SELECT CAST(row_number() OVER (ORDER BY dt) - 1 AS DOUBLE) AS t, ic FROM ics WHERE ic IS NOT NULL), f1 AS (SELECT rate, {_SUMS} FROM (SELECT *, unnest({_RATES}) AS rate FROM st) GROUP BY rate), b1 AS (SELECT rate FROM f1 ORDER BY off, rate LIMIT 1),
  f2 AS (SELECT rate, {_SUMS} FROM (SELECT t, ic, rate * m AS rate FROM (SELECT st.*, rate, unnest({_FINE}) AS m FROM st CROSS JOIN b1)) GROUP BY rate), b2 AS (SELECT * FROM f2 ORDER BY off, rate LIMIT 1)"""


@query("factor n decaying", "rate initial steady half_life", f"WITH {OFFSET} --- SELECT 'f' AS factor, n, CASE WHEN n >= 20 THEN rate > 0.005 AND ln(2) / rate < n * 0.8 END AS decaying, CASE WHEN n >= 20 THEN rate END AS rate, CASE WHEN n >= 20 THEN initial END AS initial, CASE WHEN n >= 20 THEN steady END AS steady, CASE WHEN n >= 20 THEN ln(2) / rate END AS half_life FROM b2", 5)
def ic_decay_offset(spark, d):
    return ps.decay_with_offset(rs.ic_series(labelled(spark, d), "f", "fwd_1").withColumn("factor", F.lit("f")), "factor")
