"""Registered queries: a factor's analysis in one pass, and alerts on the health of factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators import alerts as al
from alphaloom.operators import analysis as an
from alphaloom.operators import mining as mi
from alphaloom.operators import weighting as wt

from .registry import query
from .research import CORR, LABELS, labelled
from .weighting import FACTORS, TALL, many

HORIZONS, GROUPS = (1, 3, 6), 5
_EDGES = ", ".join(str(k / GROUPS) for k in range(1, GROUPS))
PASS = f"""{LABELS}, ho AS (SELECT dt, f AS x, unnest([1, 3, 6]) AS horizon, unnest([fwd_1, fwd_3, CASE WHEN close <> 0 THEN lead(close, 6) OVER s / close - 1 END]) AS r FROM y WINDOW s AS (PARTITION BY code ORDER BY dt)), hk AS (SELECT * FROM ho WHERE x IS NOT NULL AND r IS NOT NULL),
  hr AS (SELECT *, rank() OVER (PARTITION BY dt, horizon ORDER BY x) + (count(*) OVER (PARTITION BY dt, horizon, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY dt, horizon ORDER BY r) + (count(*) OVER (PARTITION BY dt, horizon, r) - 1) / 2.0 AS rb, quantile_cont(x, [{_EDGES}]) OVER (PARTITION BY dt, horizon) AS q FROM hk),
  hg AS (SELECT *, 1 + (x > q[1])::INT + (x > q[2])::INT + (x > q[3])::INT + (x > q[4])::INT AS grp FROM hr),
  aa AS (SELECT horizon, dt, CAST(NULL AS INTEGER) AS grp, count(*) AS n, {CORR.format('x', 'r')} AS ic, {CORR.format('ra', 'rb')} AS rank_ic, avg(r) AS ret FROM hr GROUP BY 1, 2 UNION ALL SELECT horizon, dt, grp, count(*), NULL, NULL, avg(r) FROM hg GROUP BY 1, 2, 3)"""


@query("horizon dt grp n", "ic rank_ic ret", f"WITH {PASS} --- SELECT * FROM aa")
def factor_analysis(spark, d):
    return an.analyse(labelled(spark, d), "f", HORIZONS, GROUPS)


@query("horizon dates", "mean_ic std_ic icir positive mean_rank_ic nw_t long_short monotony coverage", f"""WITH {PASS}, kd AS (SELECT *, ic - avg(ic) OVER (PARTITION BY horizon) AS d FROM aa WHERE grp IS NULL AND ic IS NOT NULL),
  kl AS (SELECT *, d * lag(d, 1) OVER o AS p1, d * lag(d, 2) OVER o AS p2, d * lag(d, 3) OVER o AS p3, d * lag(d, 4) OVER o AS p4 FROM kd WINDOW o AS (PARTITION BY horizon ORDER BY dt)),
  ki AS (SELECT horizon, count(*) AS dates, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive, avg(rank_ic) AS mean_rank_ic, sqrt(greatest(0.0, sum(d * d) + 2 * (0.8 * sum(p1) + 0.6 * sum(p2) + 0.4 * sum(p3) + 0.2 * sum(p4)))) / count(*) AS se FROM kl GROUP BY 1),
  ks AS (SELECT horizon, avg(ls) AS long_short FROM (SELECT horizon, dt, max(ret) FILTER (grp = 5) - max(ret) FILTER (grp = 1) AS ls FROM aa GROUP BY 1, 2) GROUP BY 1), km AS (SELECT horizon, corr(grp, m) AS monotony FROM (SELECT horizon, grp, avg(ret) AS m FROM aa WHERE grp IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
  kc AS (SELECT horizon, avg(n) AS coverage FROM aa WHERE grp IS NULL GROUP BY 1) --- SELECT horizon, dates, mean_ic, std_ic, mean_ic / std_ic AS icir, positive, mean_rank_ic, mean_ic / se AS nw_t, long_short, monotony, coverage FROM kc JOIN ki USING (horizon) JOIN ks USING (horizon) JOIN km USING (horizon)""", 5)
def factor_report(spark, d):
    return an.report(an.analyse(labelled(spark, d), "f", HORIZONS, GROUPS), GROUPS)


_MINED = {"f": "f", "g": "g", "turnover": "turnover", "rank(f)": "CASE WHEN f IS NOT NULL THEN percent_rank() OVER (PARTITION BY dt, f IS NULL ORDER BY f) END", "rank(g)": "CASE WHEN g IS NOT NULL THEN percent_rank() OVER (PARTITION BY dt, g IS NULL ORDER BY g) END", "rank(turnover)": "CASE WHEN turnover IS NOT NULL THEN percent_rank() OVER (PARTITION BY dt, turnover IS NULL ORDER BY turnover) END",
  "sub(f,g)": "f - g", "sub(f,turnover)": "f - turnover", "sub(g,turnover)": "g - turnover", "mul(f,f)": "f * f", "mul(f,g)": "f * g", "mul(f,turnover)": "f * turnover", "mul(g,g)": "g * g", "mul(g,turnover)": "g * turnover", "mul(turnover,turnover)": "turnover * turnover"}
MINED = f"""{LABELS}, mt AS (SELECT dt, fwd_1, unnest([{', '.join(f"'{n}'" for n in _MINED)}]) AS formula, unnest([{', '.join(_MINED.values())}]) AS x FROM y), mi AS (SELECT formula, dt, {CORR.format('x', 'fwd_1')} AS ic FROM mt WHERE x IS NOT NULL AND fwd_1 IS NOT NULL GROUP BY 1, 2),
  ms AS (SELECT formula, count(ic) AS dates, coalesce(sum(ic), 0) / (SELECT count(DISTINCT dt) FROM y WHERE fwd_1 IS NOT NULL) AS mean_ic FROM mi GROUP BY 1)"""


@query("formula dates", "mean_ic", f"WITH {MINED} --- SELECT formula, dates, mean_ic FROM ms ORDER BY round(abs(mean_ic), 12) DESC, length(formula), formula LIMIT 5")
def factors_mined(spark, d):
    """The five best of fifteen formulas: a top-k report."""
    formulas = mi.grammar(["f", "g", "turnover"], 1, ("rank",), ("sub", "mul"))
    found = mi.mine(labelled(spark, d), formulas, "fwd_1", best=5)
    return spark.createDataFrame([(n, ic, dates) for n, ic, dates, _ in found], "formula string, mean_ic double, dates long")


RULE = al.Rule(low=0.0, high=0.02, after=2, until=2, quiet_days=200)
ALERTS = f"""RECURSIVE {TALL}, fn AS (SELECT factor, dt, ic, row_number() OVER (PARTITION BY factor ORDER BY dt) AS i FROM fi), sm AS (SELECT factor, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(NULL AS DATE) AS dt, CAST(NULL AS DOUBLE) AS ic, CAST(NULL AS DATE) AS last, false AS tell, '' AS kind FROM (SELECT DISTINCT factor FROM fn)
    UNION ALL SELECT factor, i, n, dt, ic, CASE WHEN k = 'r' AND q THEN dt ELSE last END, CASE WHEN k = 'r' THEN q WHEN k = 'c' THEN false ELSE tell END, CASE WHEN k = 'r' AND q THEN 'raised' WHEN k = 'c' AND tell THEN 'cleared' ELSE '' END
    FROM (SELECT factor, i, n, dt, ic, last, tell, CASE WHEN s < 2 AND n >= 2 THEN 'r' WHEN s >= 2 AND n < 2 THEN 'c' ELSE '' END AS k, last IS NULL OR date_diff('day', last, dt) > 200 AS q
      FROM (SELECT fn.factor, fn.i, fn.dt, fn.ic, sm.s, sm.last, sm.tell, CASE WHEN sm.s < 2 THEN CASE WHEN fn.ic < 0 THEN sm.s + 1 ELSE 0 END ELSE CASE WHEN fn.ic > 0.02 THEN (sm.s + 1) % 4 ELSE 2 END END AS n FROM sm JOIN fn ON fn.factor = sm.factor AND fn.i = sm.i + 1)))"""


@query("factor dt kind", "value", f"WITH {ALERTS} --- SELECT factor, dt, kind, ic AS value FROM sm WHERE kind <> ''")
def factor_alerts(spark, d):
    ics = wt.factor_ics(many(spark, d), FACTORS, "fwd_1").select("factor", "dt", F.col("ic").alias("value"))
    return al.alerts(ics, RULE)
