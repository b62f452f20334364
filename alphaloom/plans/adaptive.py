"""Registered queries: adaptive factor choice, resampled tests, orders, corporate actions, attribution, tail risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from alphaloom.operators import adaptive as ad
from alphaloom.operators import portfolio as po
from alphaloom.operators import research as rs
from alphaloom.operators import risk
from alphaloom.operators import simulation as sm
from alphaloom.operators import timing as tm
from alphaloom.sources.tables import INDEX, PANEL, index_series, panel, table

from .registry import query
from .research import CORR, LABELS, labelled
from .strategy import IRET, WEIGHTS, _ma, _signal, scored

FACTORS = ["f", "g", "turnover"]
RANKED = "rank() OVER (PARTITION BY dt ORDER BY {0}) + (count(*) OVER (PARTITION BY dt, {0}) - 1) / 2.0"
HIST = f"{LABELS}, hs AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS factor, dt, {CORR.format('x', 'fwd_1')} AS ic, {CORR.format('a', 'b')} AS rank_ic FROM (SELECT dt, {x} AS x, fwd_1, {RANKED.format(x)} AS a, {RANKED.format('fwd_1')} AS b FROM y WHERE {x} IS NOT NULL AND fwd_1 IS NOT NULL) GROUP BY dt HAVING count(*) >= 10" for x in FACTORS
) + "), rc AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY dt DESC) AS rn FROM hs WHERE ic IS NOT NULL)"


def history(spark, d):
    """IC history of three factors from one stacked table, so the panel is ranked once."""
    y = labelled(spark, d)
    parts = [rs.ic_series(y, x, "fwd_1").select(F.lit(x).alias("factor"), "dt", "ic", "rank_ic") for x in FACTORS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("factor chosen", "icir positive score", f"""WITH {HIST}, s AS (SELECT factor, avg(ic) AS m, stddev_samp(ic) AS sd, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive, avg(rank_ic) AS r FROM rc WHERE rn <= 24 GROUP BY 1),
  t AS (SELECT *, CASE WHEN sd > 1e-12 THEN m / sd ELSE 0 END AS icir FROM s), u AS (SELECT *, (0.5 * abs(icir) + 0.6 * (positive - 0.5) + 2 * abs(r)) * CASE WHEN m < 0 THEN 0.3 ELSE 1 END AS score FROM t),
  v AS (SELECT *, row_number() OVER (ORDER BY abs(icir) >= 0.3 DESC, score DESC, factor) AS p FROM u) --- SELECT *, p <= 2 OR (abs(icir) >= 0.3 AND p <= 30) AS chosen FROM v""", 5)
def adaptive_selection(spark, d):
    return ad.select_factors(history(spark, d))


@query("factor alert", "short_ic long_ic lost slope", f"""WITH {HIST}, s AS (SELECT factor, avg(ic) FILTER (rn <= 12) AS short_ic, avg(ic) AS long_ic, regr_slope(ic, -rn) AS slope FROM rc WHERE rn <= 36 GROUP BY 1), l AS (SELECT *, CASE WHEN abs(long_ic) > 1e-12 THEN 1 - short_ic / long_ic END AS lost FROM s) ---
  SELECT *, CASE WHEN short_ic * long_ic < 0 THEN 'sign_change' WHEN lost > 0.5 THEN 'decayed' WHEN abs(short_ic) < 0.01 THEN 'weak' ELSE 'none' END AS alert FROM l""", 5)
def adaptive_decay_monitor(spark, d):
    return ad.decay_monitor(history(spark, d))


@query("factor n level advice", "score", f"""WITH {HIST}, s AS (SELECT factor, count(ic) AS n, avg(ic) AS m, stddev_samp(ic) AS sd, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS p FROM rc WHERE rn <= 24 GROUP BY 1),
  t AS (SELECT *, 40 * least(1.0, abs(m) / 0.05) + 30 * least(1.0, CASE WHEN sd > 1e-12 THEN abs(m) / sd ELSE 0 END) + 40 * abs(p - 0.5) + 10 * least(1.0, n / 24) AS score FROM s) ---
  SELECT *, CASE WHEN score >= 70 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS level, CASE WHEN score >= 70 THEN 'keep' WHEN score >= 40 THEN 'monitor' WHEN score >= 20 THEN 'reduce' ELSE 'remove' END AS advice FROM t""", 4)
def adaptive_health(spark, d):
    return ad.health(history(spark, d))


@query("factor dt state", "", f"""WITH RECURSIVE {HIST}, so AS (SELECT factor, dt, coalesce(abs(ic), 0) AS x, row_number() OVER (PARTITION BY factor ORDER BY dt) AS i FROM hs),
  st AS (SELECT factor, CAST(NULL AS DATE) AS dt, CAST(0 AS BIGINT) AS i, 1 AS lv, 0 AS good, 0 AS bad FROM (SELECT DISTINCT factor FROM so)
    UNION ALL SELECT factor, dt, i, CASE WHEN g >= 2 THEN least(2, lv + 1) WHEN b >= 2 THEN greatest(0, lv - 1) ELSE lv END, CASE WHEN greatest(g, b) >= 2 THEN 0 ELSE g END, CASE WHEN greatest(g, b) >= 2 THEN 0 ELSE b END
    FROM (SELECT so.factor, so.dt, so.i, lv, CASE WHEN x >= 0.1 THEN good + 1 ELSE 0 END AS g, CASE WHEN x <= 0.05 THEN bad + 1 ELSE 0 END AS b FROM st JOIN so ON so.factor = st.factor AND so.i = st.i + 1)) ---
  SELECT factor, dt, CASE lv WHEN 2 THEN 'ACTIVE' WHEN 1 THEN 'MONITORING' ELSE 'INACTIVE' END AS state FROM st WHERE i > 0""")
def adaptive_states(spark, d):
    return ad.states(history(spark, d), up=0.1, down=0.05, run=2)


Z = "(({0} - avg({0}) OVER (PARTITION BY dt)) / nullif(stddev_samp({0}) OVER (PARTITION BY dt), 0))"


@query("code dt", "m1 m2 score", f"""WITH {LABELS}, z AS (SELECT code, dt, {Z.format('f')} AS zf, {Z.format('g')} * -1 AS zg, {Z.format('turnover')} AS zt FROM y),
  m AS (SELECT code, dt, CASE WHEN zf IS NULL AND zg IS NULL THEN NULL ELSE (coalesce(zf * 0.6, 0) + coalesce(zg * 0.4, 0)) / (CASE WHEN zf IS NULL THEN 0 ELSE 0.6 END + CASE WHEN zg IS NULL THEN 0 ELSE 0.4 END) END AS m1, zt AS m2 FROM z) ---
  SELECT *, coalesce(m1, 0) * 0.7 + coalesce(m2, 0) * 0.3 AS score FROM m""")
def ensemble_score(spark, d):
    df = ad.module_score(labelled(spark, d), {"f": (1, 0.6), "g": (-1, 0.4)}, "m1")
    return ad.fuse_modules(ad.module_score(df, {"turnover": (1, 1.0)}, "m2"), {"m1": 0.7, "m2": 0.3})


@query("draw", "mean sharpe")
def backtest_bootstrap(spark, d):
    return sm.block_bootstrap(index_returns(spark, d))


def index_returns(spark, d):
    return tm.regime(index_series(spark, d)).select("dt", F.col("_r").alias("ret"))


@query("", "observed p")
def backtest_permutation(spark, d):
    return sm.sign_permutation_test(index_returns(spark, d))


@query("code n", "deflated least_years")
def backtest_deflated_sharpe(spark, d):
    r = panel(spark, d).withColumn("r", F.col("close") / F.lag("close").over(tm.series()) - 1).groupBy("code").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))
    return sm.deflated_sharpe(r.filter("sd > 0").withColumn("sharpe", F.col("m") / F.col("sd")), 20)


ORD = f"""{WEIGHTS}, tg AS (SELECT wt.dt, wt.code, weight, close FROM wt JOIN panel USING (code, dt)), hd AS (SELECT dt, code, close, CAST(volume AS DOUBLE) AS shares FROM panel),
  x AS (SELECT dt, code, coalesce(tg.close, hd.close) AS close, coalesce(weight, 0) AS weight, coalesce(shares, 0) AS shares FROM tg FULL JOIN hd USING (dt, code)),
  dl AS (SELECT *, CASE WHEN weight = 0 THEN -shares ELSE sign(weight * 1e6 / close - shares) * floor(abs(weight * 1e6 / close - shares) / 100) * 100 END AS delta FROM x WHERE close > 0)"""


@query("dt code side", "shares", f"WITH {ORD} --- SELECT dt, code, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, abs(delta) AS shares FROM dl WHERE abs(delta * close) > 100 AND delta <> 0", 2)
def backtest_orders(spark, d):
    p = panel(spark, d)
    held = p.select("dt", "code", "close", F.col("volume").cast("double").alias("shares"))
    return sm.orders(po.score_weights(scored(spark, d)).select("dt", "code", "weight", "close"), held, 1e6)


LOTS = "lt AS (SELECT o_orderkey AS lot, o_custkey % 200 AS code, CAST(o_orderdate AS DATE) AS bought, CAST(1 + o_orderkey % 900 AS DOUBLE) AS shares FROM orders)"


@query("lot code ex_day held bonus_shares", "net_cash", f"""WITH {LOTS}, pd AS (SELECT code, DATE '1997-06-30' AS ex_day, 0.1 + code / 1000.0 AS cash, 0.3 AS bonus FROM range(200) t(code)), x AS (SELECT *, date_diff('day', bought, ex_day) AS held FROM lt JOIN pd USING (code) WHERE bought < ex_day) ---
  SELECT *, shares * cash * (1 - CASE WHEN held <= 30 THEN 0.2 WHEN held <= 365 THEN 0.1 ELSE 0 END) AS net_cash, CAST(floor(CAST(shares AS DOUBLE) * CAST(bonus AS DOUBLE)) AS BIGINT) AS bonus_shares FROM x""", 4)
def backtest_dividends(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("lot"), (F.col("o_custkey") % 200).alias("code"), F.to_date("o_orderdate").alias("bought"), (1 + F.col("o_orderkey") % 900).cast("double").alias("shares"))
    paid = spark.range(200).select(F.col("id").alias("code"), F.to_date(F.lit("1997-06-30")).alias("ex_day"), (0.1 + F.col("id") / 1000.0).alias("cash"), F.lit(0.3).alias("bonus"))
    return sm.dividends(o, paid)


@query("code dt", "sold sellable", """WITH tr AS (SELECT o_custkey % 200 AS code, CAST(o_orderdate AS DATE) AS dt, o_orderkey % 2 = 0 AS buy, CAST(o_orderkey % 10 + 1 AS DOUBLE) AS shares FROM orders), dy AS (SELECT code, dt, coalesce(sum(shares) FILTER (buy), 0) AS bought, coalesce(sum(shares) FILTER (NOT buy), 0) AS sold FROM tr GROUP BY 1, 2),
  h AS (SELECT *, coalesce(sum(bought - sold) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sellable FROM dy) --- SELECT * FROM h WHERE sold > sellable""")
def backtest_t_plus_one(spark, d):
    tr = table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("code"), F.to_date("o_orderdate").alias("dt"), F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("o_orderkey") % 10 + 1).cast("double").alias("shares"))
    return sm.t_plus_one(tr)


@query("dt factor", "contribution", f"""WITH {WEIGHTS}, ex AS (SELECT dt, code, 'f' AS factor, f AS exposure FROM y WHERE f IS NOT NULL UNION ALL SELECT dt, code, 'g', g FROM y WHERE g IS NOT NULL), rt AS (SELECT dt, 'f' AS factor, avg(f) AS ret FROM y GROUP BY dt UNION ALL SELECT dt, 'g', avg(g) FROM y GROUP BY dt) ---
  SELECT dt, factor, sum(weight * exposure * ret) AS contribution FROM wt JOIN ex USING (dt, code) JOIN rt USING (dt, factor) GROUP BY 1, 2""")
def performance_factor_attribution(spark, d):
    df = scored(spark, d)
    tall = df.select("dt", "code", "f", "g").unpivot(["dt", "code"], ["f", "g"], "factor", "exposure").filter("exposure is not null")
    return sm.factor_attribution(po.score_weights(df).select("dt", "code", "weight"), tall, tall.groupBy("dt", "factor").agg(F.avg("exposure").alias("ret")))


MA = f"{INDEX}, m0 AS (SELECT *, {_ma(20)} AS f, {_ma(60)} AS s FROM idx), mc AS (SELECT *, {_signal('f > s', 'f < s')} AS sg FROM m0)"


@query("code signal n", "hit_rate profit_factor snr", f"""WITH {MA}, p AS (SELECT *, CASE sg WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 END * (lead(close) OVER (ORDER BY dt) / close - 1) AS p FROM mc) ---
  SELECT code, sg AS signal, count(*) AS n, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(greatest(p, 0)) / nullif(-sum(least(p, 0)), 0) AS profit_factor, avg(p) / nullif(stddev_samp(p), 0) AS snr FROM p WHERE p IS NOT NULL GROUP BY 1, 2""")
def timing_evaluation(spark, d):
    return sm.signal_report(tm.ma_cross(index_series(spark, d)), "ma_cross")


@query("dt", "nav", f"""WITH {MA}, p AS (SELECT *, CASE WHEN coalesce(lag(sg) OVER (ORDER BY dt), 'NEUTRAL') = 'SHORT' THEN 0.0 ELSE coalesce(close / lag(close) OVER (ORDER BY dt) - 1, 0) END AS r FROM mc) ---
  SELECT dt, exp(sum(ln(1 + greatest(r, -0.999999))) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS nav FROM p""", 3)
def timing_backtest(spark, d):
    return sm.signal_nav(tm.ma_cross(index_series(spark, d)), "ma_cross")


VARS = f"{PANEL}, pr AS (SELECT code, dt, close / lag(close) OVER (PARTITION BY code ORDER BY dt) - 1 AS r FROM panel), vq AS (SELECT code, quantile_cont(r, 0.05) AS q FROM pr GROUP BY 1)"


@query("code n", "historical parametric conditional liquidity", f"""WITH {VARS}, a AS (SELECT code, count(r) AS n, -any_value(q) AS historical, -(avg(r) + {risk.Z95!r} * stddev_samp(r)) AS parametric, -avg(r) FILTER (r <= q) AS conditional FROM pr JOIN vq USING (code) GROUP BY 1) ---
  SELECT *, historical + 0.5 * 0.002 + 0.1 * sqrt(0.25) AS liquidity FROM a""")
def risk_value_at_risk(spark, d):
    return risk.value_at_risk(panel(spark, d), spread=0.002, participation=0.25)


@query("a b n", "lower upper", f"""WITH {LABELS}, i AS (SELECT industry, dt, avg(g) AS r FROM y WHERE g IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, percent_rank() OVER (PARTITION BY industry ORDER BY r) AS u FROM i) ---
  SELECT x.industry AS a, z.industry AS b, count(*) AS n, sum(CASE WHEN x.u <= 0.1 AND z.u <= 0.1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN x.u <= 0.1 THEN 1 ELSE 0 END), 0) AS lower,
  sum(CASE WHEN x.u >= 0.9 AND z.u >= 0.9 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN x.u >= 0.9 THEN 1 ELSE 0 END), 0) AS upper FROM k x JOIN k z ON x.dt = z.dt AND x.industry < z.industry GROUP BY 1, 2""")
def risk_tail_dependence(spark, d):
    g = labelled(spark, d).filter("g is not null").groupBy("industry", "dt").agg(F.avg("g").alias("r"))
    return risk.tail_dependence(g, "industry", "r")


@query("code n00 n01 n10 n11", "christoffersen", f"""WITH {IRET}, b AS (SELECT *, count(r) OVER x AS c, quantile_cont(r, 0.05) OVER x AS v FROM ir WINDOW x AS (ORDER BY dt ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
  h AS (SELECT code, dt, CASE WHEN r < v THEN 1 ELSE 0 END AS hit FROM b WHERE c >= 60 AND r IS NOT NULL), t AS (SELECT code, hit, lag(hit) OVER (ORDER BY dt) AS p FROM h),
  k AS (SELECT code, count(*) FILTER (p = 0 AND hit = 0) AS n00, count(*) FILTER (p = 0 AND hit = 1) AS n01, count(*) FILTER (p = 1 AND hit = 0) AS n10, count(*) FILTER (p = 1 AND hit = 1) AS n11 FROM t GROUP BY 1),
  l AS (SELECT *, CASE WHEN n01 > 0 THEN n01 * ln(n01 / (n00 + n01)) ELSE 0 END + CASE WHEN n00 > 0 THEN n00 * ln(n00 / (n00 + n01)) ELSE 0 END + CASE WHEN n11 > 0 THEN n11 * ln(n11 / (n10 + n11)) ELSE 0 END + CASE WHEN n10 > 0 THEN n10 * ln(n10 / (n10 + n11)) ELSE 0 END AS la,
    CASE WHEN n01 + n11 > 0 THEN (n01 + n11) * ln((n01 + n11) / (n00 + n01 + n10 + n11)) ELSE 0 END + CASE WHEN n00 + n10 > 0 THEN (n00 + n10) * ln((n00 + n10) / (n00 + n01 + n10 + n11)) ELSE 0 END AS l0 FROM k) --- SELECT *, greatest(0.0, 2 * (la - l0)) AS christoffersen FROM l""")
def risk_christoffersen(spark, d):
    return risk.christoffersen(index_series(spark, d))
