"""Registered queries: timing, scoring, portfolios, performance and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators import backtest as bt
from alphaloom.operators import learning as ln
from alphaloom.operators import performance as pf
from alphaloom.operators import portfolio as po
from alphaloom.operators import price
from alphaloom.operators import tiers as tr
from alphaloom.operators import timing as tm
from alphaloom.sources.tables import INDEX, PANEL, index_series, panel, table

from .registry import query
from .research import LABELS, labelled

O = "ORDER BY dt ROWS BETWEEN {} PRECEDING AND CURRENT ROW"  # noqa: E741
IRET = f"{INDEX}, ir AS (SELECT *, close / lag(close) OVER (ORDER BY dt) - 1 AS r FROM idx)"


def _ma(n: int, x: str = "close") -> str:
    return f"CASE WHEN count({x}) OVER ({O.format(n - 1)}) >= {n} THEN avg({x}) OVER ({O.format(n - 1)}) END"


def _signal(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 'LONG' WHEN {down} THEN 'SHORT' ELSE 'NEUTRAL' END"


@query("dt ma_cross", "", f"WITH {INDEX}, m AS (SELECT dt, {_ma(20)} AS f, {_ma(60)} AS s FROM idx) --- SELECT dt, {_signal('f > s', 'f < s')} AS ma_cross FROM m")
def timing_ma_cross(spark, d):
    return tm.ma_cross(index_series(spark, d))


@query("dt", "trend_strength", f"WITH {INDEX}, m AS (SELECT dt, close, {', '.join(f'{_ma(n)} AS m{n}' for n in (5, 10, 20, 60, 120))} FROM idx) --- SELECT dt, (" + " + ".join(f"coalesce((close > m{n})::INT, 0)" for n in (5, 10, 20, 60, 120)) + ") / 5.0 * 2 - 1 AS trend_strength FROM m")
def timing_trend_strength(spark, d):
    return tm.trend_strength(index_series(spark, d))


VOL = f"{IRET}, v AS (SELECT *, CASE WHEN count(r) OVER ({O.format(19)}) >= 20 THEN stddev_samp(r) OVER ({O.format(19)}) * sqrt(252) END AS realised FROM ir)"


@query("dt vol_signal", "realised", f"WITH {VOL} --- SELECT dt, realised, {_signal('realised < 2.0', 'realised > 3.0')} AS vol_signal FROM v")
def timing_volatility(spark, d):
    return tm.volatility_signal(index_series(spark, d), low=2.0, high=3.0)


DD = f"{INDEX}, dd AS (SELECT *, close / max(close) OVER ({O.format('UNBOUNDED')}) - 1 AS dd FROM idx)"


@query("dt dd_signal", "dd", f"WITH {DD}, e AS (SELECT *, lag(dd) OVER (ORDER BY dt) AS b FROM dd) --- SELECT dt, dd, CASE WHEN dd < -0.1 THEN 'SHORT' WHEN b < -0.1 AND dd > -0.05 THEN 'NEUTRAL' ELSE 'LONG' END AS dd_signal FROM e")
def timing_drawdown(spark, d):
    return tm.drawdown_signal(index_series(spark, d))


@query("dt stopped", "", f"WITH {INDEX} --- SELECT dt, close < (1 - 0.05) * max(close) OVER ({O.format(19)}) AS stopped FROM idx")
def timing_trailing_stop(spark, d):
    return tm.trailing_stop(index_series(spark, d))


@query("dt up down ad_line breadth_signal", "breadth", f"""WITH {PANEL}, r AS (SELECT dt, close / lag(close) OVER (PARTITION BY code ORDER BY dt) - 1 AS r FROM panel), c AS (SELECT dt, count(*) FILTER (r > 0) AS up, count(*) FILTER (r < 0) AS down FROM r GROUP BY dt),
  s AS (SELECT *, CASE WHEN up + down > 0 THEN up / (up + down) END AS sh FROM c), b AS (SELECT *, {_ma(20, 'sh')} AS breadth, CAST(sum(up - down) OVER ({O.format('UNBOUNDED')}) AS BIGINT) AS ad_line FROM s) ---
  SELECT *, {_signal('breadth > 0.6', 'breadth < 0.4')} AS breadth_signal FROM b""")
def timing_breadth(spark, d):
    return tm.breadth(panel(spark, d))


@query("dt flow_signal", "flow_z", f"""WITH {INDEX}, a AS (SELECT *, CASE WHEN count(*) OVER ({O.format(4)}) >= 5 THEN sum(volume) OVER ({O.format(4)}) END AS s FROM idx), b AS (SELECT *, CASE WHEN count(s) OVER ({O.format(59)}) >= 20 THEN avg(s) OVER ({O.format(59)}) END AS m,
  CASE WHEN count(s) OVER ({O.format(59)}) >= 20 THEN stddev_samp(s) OVER ({O.format(59)}) END AS d FROM a), z AS (SELECT *, CASE WHEN d > 0 THEN (s - m) / d END AS flow_z FROM b) --- SELECT dt, flow_z, {_signal('flow_z > 0.5', 'flow_z < -0.5')} AS flow_signal FROM z""")
def timing_flow(spark, d):
    return tm.flow_signal(index_series(spark, d), "volume")


@query("dt seasonal", "", f"WITH {INDEX} --- SELECT dt, {_signal('month(dt) IN (1, 2, 12)', 'month(dt) BETWEEN 5 AND 9')} AS seasonal FROM idx")
def timing_seasonal(spark, d):
    return tm.seasonal(index_series(spark, d))


REGIME = f"{IRET}, g AS (SELECT *, {_ma(60)} AS ma, CASE WHEN count(r) OVER ({O.format(59)}) >= 60 THEN stddev_samp(r) OVER ({O.format(59)}) * sqrt(252) END AS v FROM ir), rg AS (SELECT dt, r, CASE WHEN close > ma AND v < 0.2 THEN 'BULL' WHEN close < ma AND v > 0.25 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime FROM g)"


@query("dt regime", "", f"WITH {REGIME} --- SELECT * FROM rg")
def timing_regime(spark, d):
    return tm.regime(index_series(spark, d))


@query("dt policy", "", f"""WITH {INDEX}, ev AS (SELECT o_orderkey AS seq, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS signal FROM orders),
  j AS (SELECT idx.dt, arg_max(signal, seq) AS policy FROM idx JOIN ev ON idx.dt BETWEEN ev.day - 3 AND ev.day + 3 GROUP BY idx.dt) --- SELECT idx.dt, coalesce(policy, 'NEUTRAL') AS policy FROM idx LEFT JOIN j USING (dt)""")
def timing_policy(spark, d):
    ev = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_seq"), F.to_date("o_orderdate").alias("event_day"), F.when(F.col("o_orderkey") % 2 == 0, "LONG").otherwise("SHORT").alias("signal"))
    return tm.policy_calendar(index_series(spark, d), ev)


@query("dt fused", "score exposure", f"""WITH {DD}, e AS (SELECT *, lag(dd) OVER (ORDER BY dt) AS b, {_ma(20)} AS f, {_ma(60)} AS s FROM dd), g AS (SELECT dt, {_signal('f > s', 'f < s')} AS a, CASE WHEN dd < -0.1 THEN 'SHORT' WHEN b < -0.1 AND dd > -0.05 THEN 'NEUTRAL' ELSE 'LONG' END AS c FROM e),
  h AS (SELECT dt, 0.6 * CASE a WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 ELSE 0 END + 0.4 * CASE c WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 ELSE 0 END AS score FROM g) ---
  SELECT *, {_signal('score > 0.25', 'score < -0.25')} AS fused, CASE WHEN score > 0.25 THEN 1 WHEN score < -0.25 THEN 0.2 ELSE 0.5 END AS exposure FROM h""")
def timing_fused(spark, d):
    return tm.fuse(tm.drawdown_signal(tm.ma_cross(index_series(spark, d))), {"ma_cross": 0.6, "dd_signal": 0.4}, 0.25)


@query("dt", "dma", f"""WITH RECURSIVE {DD}, e AS (SELECT *, lag(dd) OVER (ORDER BY dt) AS b, {_ma(20)} AS f, {_ma(60)} AS s FROM dd), g AS (SELECT dt, close, row_number() OVER (ORDER BY dt) AS i, CASE WHEN f > s THEN 1.0 WHEN f < s THEN -1.0 ELSE 0.0 END AS sa, CASE WHEN dd < -0.1 THEN -1.0 WHEN b < -0.1 AND dd > -0.05 THEN 0.0 ELSE 1.0 END AS sc FROM e),
  lw AS (SELECT dt, i, close, sa, sc, CAST(0 AS DOUBLE) AS la, CAST(0 AS DOUBLE) AS lc FROM g WHERE i = 1
    UNION ALL SELECT g.dt, g.i, g.close, g.sa, g.sc, 0.95 * la + ln(0.5 + 0.1 * sign(lw.sa * (g.close - lw.close))), 0.95 * lc + ln(0.5 + 0.1 * sign(lw.sc * (g.close - lw.close))) FROM lw JOIN g ON g.i = lw.i + 1) ---
  SELECT dt, (exp(la - greatest(la, lc)) * sa + exp(lc - greatest(la, lc)) * sc) / (exp(la - greatest(la, lc)) + exp(lc - greatest(la, lc))) AS dma FROM lw""")
def timing_dma(spark, d):
    return tm.fuse_dma(tm.drawdown_signal(tm.ma_cross(index_series(spark, d))), ["ma_cross", "dd_signal"])


SCORED = f"""{LABELS}, sc AS (SELECT *, CASE WHEN f IS NULL AND g IS NULL THEN NULL ELSE (coalesce(f, 0) * 0.6 + coalesce(g, 0) * -0.4) / ((f IS NOT NULL)::INT * 0.6 + (g IS NOT NULL)::INT * 0.4) END AS score FROM y),
  rk AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY score DESC NULLS LAST, code) AS rank, count(score) OVER (PARTITION BY dt) AS n FROM sc)"""


def scored(spark, d):
    return po.rank_scores(po.weighted_score(labelled(spark, d), {"f": 0.6, "g": -0.4}))


@query("code dt rank selected", "score", f"WITH {SCORED} --- SELECT code, dt, rank, rank <= 10 AND score IS NOT NULL AS selected, score FROM rk")
def model_score(spark, d):
    return scored(spark, d)


@query("code dt held", "", f"WITH {SCORED}, h AS (SELECT *, lag(rank) OVER (PARTITION BY code ORDER BY dt) AS b FROM rk) --- SELECT code, dt, rank <= 10 OR (coalesce(b <= 10, false) AND rank <= 15) AS held FROM h")
def portfolio_buffer(spark, d):
    return po.buffered_selection(scored(spark, d))


WEIGHTS = f"""{SCORED}, w0 AS (SELECT code, dt, industry, fwd_1, greatest(score - min(score) OVER (PARTITION BY dt), 0) + 1e-6 AS w FROM rk WHERE rank <= 10 AND score IS NOT NULL),
  w1 AS (SELECT * REPLACE (least(w / sum(w) OVER (PARTITION BY dt), 0.2) AS w) FROM w0), w2 AS (SELECT * REPLACE (w / sum(w) OVER (PARTITION BY dt) AS w) FROM w1),
  w3 AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY dt, industry) > 0.4 THEN w * 0.4 / sum(w) OVER (PARTITION BY dt, industry) ELSE w END AS w) FROM w2), wt AS (SELECT *, w / sum(w) OVER (PARTITION BY dt) AS weight FROM w3)"""


@query("code dt", "weight", f"WITH {WEIGHTS} --- SELECT * FROM wt")
def portfolio_weights(spark, d):
    return po.score_weights(scored(spark, d))


@query("dt", "turnover", f"""WITH {WEIGHTS}, ds AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS nx FROM (SELECT DISTINCT dt FROM wt)), ol AS (SELECT nx AS dt, code, weight AS b FROM wt JOIN ds USING (dt) WHERE nx IS NOT NULL) ---
  SELECT dt, sum(abs(coalesce(weight, 0) - coalesce(b, 0))) / 2 AS turnover FROM wt FULL JOIN ol USING (dt, code) GROUP BY dt""")
def portfolio_turnover(spark, d):
    return po.turnover(po.score_weights(scored(spark, d)))


@query("dt", "ret nav", f"WITH {WEIGHTS}, dl AS (SELECT dt, sum(weight * coalesce(fwd_1, 0)) AS ret FROM wt GROUP BY dt) --- SELECT dt, ret, exp(sum(ln(1 + ret)) OVER ({O.format('UNBOUNDED')})) AS nav FROM dl", 5)
def portfolio_nav(spark, d):
    df = scored(spark, d)
    return po.nav(po.score_weights(df).select("dt", "code", "weight"), df)


@query("code dt side", "commission stamp slippage cost", f"""WITH {PANEL}, t AS (SELECT code, dt, volume * 10 AS a, CASE WHEN code % 2 = 0 THEN 'sell' ELSE 'buy' END AS side, amount AS da FROM panel), s AS (SELECT *, greatest(a * 0.00025, 5.0) AS commission, CASE WHEN side = 'sell' THEN a * 0.001 ELSE 0 END AS stamp,
  a * (0.0005 + 0.3 * 0.02 * sqrt(a / da)) AS slippage FROM t) --- SELECT *, commission + a * 0.00001 + stamp + slippage AS cost FROM s""")
def trade_costs(spark, d):
    t = panel(spark, d).select("code", "dt", (F.col("volume") * 10).alias("amount"), F.when(F.col("code") % 2 == 0, "sell").otherwise("buy").alias("side"), F.col("amount").alias("day_amount"), F.lit(0.02).alias("sigma"))
    return po.trade_costs(t)


def configurations(spark):
    return spark.createDataFrame([(1, 5, 1, 9.0), (2, 10, 1, 9.0), (3, 5, 3, 0.3), (4, 10, 3, 0.3)], "config_id long, n int, every int, most_turnover double")


@query("config_id dt positions buys sells", "nav cash turnover cost", digits=2)
def backtest_sweep(spark, d):
    ranked = price.returns(scored(spark, d)).withColumn("dividend", F.when(F.month("dt") == 6, F.col("close") * 0.01))
    return bt.run_backtest(bt.market_flags(ranked, 0.3), configurations(spark))


BOUNDS, STEPS = tr.Bounds(20, 15, 30), ((5, 1.5), (10, 1.2), (20, 1.0))
LEVELS = "CASE abs(code * 7) % 5 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' WHEN 2 THEN 'extreme' WHEN 3 THEN 'low' END AS risk_level, CASE abs(code * 3) % 4 WHEN 0 THEN 'marginal' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'normal' END AS liquidity_level"
TIERED = f"""RECURSIVE {SCORED}, rd AS (SELECT dt, row_number() OVER (ORDER BY dt) AS i FROM (SELECT DISTINCT dt FROM rk WHERE score IS NOT NULL)), ri AS (SELECT rk.code, rk.dt, rk.rank, rk.industry, rk.close, rd.i FROM rk JOIN rd USING (dt) WHERE score IS NOT NULL),
  hs AS (SELECT i, code, CASE WHEN rank <= 20 THEN 1 ELSE 0 END AS held FROM ri WHERE i = 1 UNION ALL SELECT n.i, n.code, CASE WHEN n.rank <= CASE WHEN coalesce(p.held, 0) = 1 THEN 30 ELSE 15 END THEN 1 ELSE 0 END FROM (SELECT max(i) + 1 AS i FROM hs) m JOIN ri n ON n.i = m.i LEFT JOIN hs p ON p.code = n.code),
  tw AS (SELECT *, {LEVELS} FROM ri JOIN hs USING (i, code) WHERE held = 1), t1 AS (SELECT *, CASE WHEN rank <= 5 THEN 1 WHEN rank <= 10 THEN 2 WHEN rank <= 20 THEN 3 ELSE 0 END AS tier, CASE WHEN rank <= 5 THEN 1.5 WHEN rank <= 10 THEN 1.2 ELSE 1.0 END * CASE risk_level WHEN 'medium' THEN 0.85 WHEN 'high' THEN 0.6 WHEN 'extreme' THEN 0.0 ELSE 1.0 END * CASE liquidity_level WHEN 'marginal' THEN 0.85 WHEN 'insufficient' THEN 0.6 ELSE 1.0 END AS w FROM tw),
  t2 AS (SELECT * REPLACE (CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY dt) AS w) FROM t1), t3 AS (SELECT *, sum(w) OVER (PARTITION BY dt, industry) AS iw FROM t2), t4 AS (SELECT *, sum(CASE WHEN iw > 0.2 THEN w * (1 - 0.2 / iw) ELSE 0 END) OVER (PARTITION BY dt) AS freed, sum(CASE WHEN iw > 0.2 THEN 0 ELSE w END) OVER (PARTITION BY dt) AS rest FROM t3),
  t5 AS (SELECT * REPLACE (CASE WHEN iw > 0.2 THEN w * 0.2 / iw ELSE w * (1 + coalesce(freed / nullif(rest, 0), 0)) END AS w) FROM t4), t6 AS (SELECT *, CAST(CASE WHEN close > 0 THEN floor(w * 1e8 / close / 100) * 100 ELSE 0 END AS BIGINT) AS shares FROM t5), t7 AS (SELECT * REPLACE (shares * close / 1e8 AS w) FROM t6), t8 AS (SELECT * REPLACE (w / sum(w) OVER (PARTITION BY dt) AS w) FROM t7), t9 AS (SELECT * FROM t8 WHERE w >= 0.002)"""


@query("dt code rank tier", "shares weight", f"WITH {TIERED} --- SELECT dt, code, rank, tier, shares, w / sum(w) OVER (PARTITION BY dt) AS weight FROM t9", 4)
def portfolio_production(spark, d):
    k, m = F.abs(F.col("code") * 7) % 5, F.abs(F.col("code") * 3) % 4
    levels = {
        "risk_level": F.when(k == 0, "medium").when(k == 1, "high").when(k == 2, "extreme").when(k == 3, "low"),
        "liquidity_level": F.when(m == 0, "marginal").when(m == 1, "insufficient").when(m == 2, "normal"),
    }
    return tr.tiered_portfolio(scored(spark, d).filter("score is not null").select("code", "dt", "rank", "industry", "close").withColumns(levels), BOUNDS, STEPS)


METRICS = f"""{PANEL}, p AS (SELECT *, close / lag(close) OVER s - 1 AS ret, close / max(close) OVER (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM panel WINDOW s AS (PARTITION BY code ORDER BY dt)),
  v AS (SELECT code, quantile_cont(ret, 0.05) AS var FROM p GROUP BY code), a AS (SELECT code, count(ret) AS n, arg_max(close, dt) / arg_min(close, dt) - 1 AS total, avg(ret) AS mean, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS down, any_value(var) AS var,
  avg(ret) FILTER (ret <= var) AS cvar, min(dd) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS win_rate, avg(ret) FILTER (ret > 0) / -avg(ret) FILTER (ret < 0) AS pl_ratio FROM p JOIN v USING (code) GROUP BY code)"""


@query("code n", "total sharpe sortino var cvar max_drawdown win_rate pl_ratio volatility calmar", f"WITH {METRICS} --- SELECT *, mean / sd * sqrt(252) AS sharpe, mean / down * sqrt(252) AS sortino, sd * sqrt(252) AS volatility, (pow(1 + total, 252.0 / n) - 1) / -max_drawdown AS calmar FROM a", 5)
def performance_metrics(spark, d):
    return pf.metrics(panel(spark, d))


@query("code period", "ret", f"WITH {PANEL}, p AS (SELECT code, CAST(date_trunc('quarter', dt) AS DATE) AS period, close / lag(close) OVER (PARTITION BY code ORDER BY dt) - 1 AS r FROM panel) --- SELECT code, period, exp(sum(ln(1 + r))) - 1 AS ret FROM p GROUP BY 1, 2")
def performance_period(spark, d):
    return pf.period_returns(panel(spark, d))


def _tall(section: str, table: str, items: str) -> str:
    names = items.split()
    return f"SELECT code, '{section}' AS section, unnest([{', '.join(repr(n) for n in names)}]) AS item, unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in names)}]) AS value FROM {table}"


REPORT = f"""{METRICS}, rm AS (SELECT *, mean / sd * sqrt(252) AS sharpe, mean / down * sqrt(252) AS sortino, sd * sqrt(252) AS volatility, CASE WHEN n > 0 THEN pow(1 + total, 252.0 / n) - 1 END AS annual FROM a), rmc AS (SELECT *, CASE WHEN max_drawdown < 0 THEN annual / -max_drawdown END AS calmar FROM rm),
  qr AS (SELECT code, CAST(date_trunc('quarter', dt) AS DATE) AS period, exp(sum(ln(1 + ret))) - 1 AS ret FROM p GROUP BY 1, 2), qs AS (SELECT code, count(ret) AS count, max(ret) AS best, min(ret) AS worst, avg(ret) AS mean, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS above_0 FROM qr GROUP BY 1),
  sp AS (SELECT *, sum(CASE WHEN dd = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY dt) AS spell FROM p), sq AS (SELECT code, spell, count(*) AS r, min(dd) AS depth FROM sp WHERE dd < 0 GROUP BY 1, 2), ss AS (SELECT code, count(*) AS spells, sum(r) AS rows_under, max(r) AS longest, min(depth) AS deepest FROM sq GROUP BY 1),
  rw AS (SELECT code, dt, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS k, CASE WHEN count(ret) OVER w >= 12 AND stddev_samp(ret) OVER w > 0 THEN avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252) END AS sharpe, CASE WHEN count(ret) OVER w >= 12 THEN stddev_samp(ret) OVER w * sqrt(252) END AS volatility, CASE WHEN count(ret) OVER w >= 12 THEN exp(sum(ln(1 + ret)) OVER w) - 1 END AS compound FROM p WINDOW w AS (PARTITION BY code ORDER BY dt ROWS 11 PRECEDING)),
  rl AS (SELECT * FROM rw WHERE k = 1)"""


@query("code section item", "value", f"""WITH {REPORT} --- {_tall('metrics', 'rmc', 'total annual volatility sharpe sortino var cvar max_drawdown calmar win_rate pl_ratio')} UNION ALL {_tall('quarters', 'qs', 'count best worst mean above_0')}
  UNION ALL {_tall('drawdowns', 'ss', 'spells rows_under longest deepest')} UNION ALL {_tall('rolling', 'rl', 'sharpe volatility compound')}""", 5)
def performance_report(spark, d):
    return pf.report(panel(spark, d))


@query("dt", "sharpe volatility compound", f"WITH {IRET}, w AS (SELECT dt, count(r) OVER x AS c, avg(r) OVER x AS m, stddev_samp(r) OVER x AS s, sum(ln(1 + r)) OVER x AS l FROM ir WINDOW x AS ({O.format(59)})) --- SELECT dt, CASE WHEN c >= 60 THEN m / s * sqrt(252) END AS sharpe, CASE WHEN c >= 60 THEN s * sqrt(252) END AS volatility, CASE WHEN c >= 60 THEN exp(l) - 1 END AS compound FROM w")
def performance_rolling(spark, d):
    return pf.rolling_performance(index_series(spark, d))


@query("code spell first_day last_day rows", "depth", f"""WITH {PANEL}, p AS (SELECT *, close / max(close) OVER s - 1 AS dd FROM panel WINDOW s AS (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING)), q AS (SELECT *, CAST(sum((dd = 0)::INT) OVER (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spell FROM p) ---
  SELECT code, spell, min(dt) AS first_day, max(dt) AS last_day, count(*) AS rows, min(dd) AS depth FROM q WHERE dd < 0 GROUP BY 1, 2""")
def performance_drawdown_spells(spark, d):
    return pf.drawdown_spells(panel(spark, d))


@query("regime n", "mean sd", f"WITH {REGIME} --- SELECT regime, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd FROM rg GROUP BY regime HAVING count(r) >= 5")
def performance_regime(spark, d):
    i = index_series(spark, d)
    return pf.regime_performance(i, tm.regime(i))


BR = f"""{WEIGHTS}, b AS (SELECT dt, industry AS key, count(*) / sum(count(*)) OVER (PARTITION BY dt) AS bw, avg(fwd_1) AS br FROM y WHERE fwd_1 IS NOT NULL GROUP BY 1, 2),
  p AS (SELECT dt, industry AS key, sum(weight) AS w, sum(weight * fwd_1) / sum(weight) AS r FROM wt WHERE fwd_1 IS NOT NULL GROUP BY 1, 2)"""


@query("dt key", "allocation selection interaction", f"""WITH {BR}, j AS (SELECT dt, key, coalesce(w, 0) AS w, coalesce(r, br) AS r, bw, br, sum(bw * br) OVER (PARTITION BY dt) AS total FROM b LEFT JOIN p USING (dt, key)) ---
  SELECT dt, key, (w - bw) * (br - total) AS allocation, bw * (r - br) AS selection, (w - bw) * (r - br) AS interaction FROM j""")
def performance_brinson(spark, d):
    known = labelled(spark, d).filter("fwd_1 is not null")
    share = (F.count(F.lit(1)) / F.sum(F.count(F.lit(1))).over(pf.W.partitionBy("dt"))).alias("w")
    benchmark = known.groupBy("dt", F.col("industry").alias("key")).agg(share, F.avg("fwd_1").alias("r"))
    held = po.score_weights(scored(spark, d)).filter("fwd_1 is not null").groupBy("dt", F.col("industry").alias("key"))
    return pf.brinson(held.agg(F.sum("weight").alias("w"), (F.sum(F.col("weight") * F.col("fwd_1")) / F.sum("weight")).alias("r")), benchmark)


IND = f"{LABELS}, iv AS (SELECT dt, industry, avg(g) AS r FROM y GROUP BY 1, 2)"


def industry_returns(spark, d):
    return labelled(spark, d).groupBy("dt", "industry").agg(F.avg("g").alias("r"))


@query("a b n", "cov", f"WITH {IND} --- SELECT x.industry AS a, z.industry AS b, count(*) AS n, covar_samp(x.r, z.r) AS cov FROM iv x JOIN iv z ON x.dt = z.dt AND x.industry <= z.industry WHERE x.r IS NOT NULL AND z.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 12")
def risk_covariance(spark, d):
    return pf.covariance_pairs(industry_returns(spark, d), "industry", "r")


@query("industry", "min_variance risk_parity contribution")
def risk_optimal_weights(spark, d):
    keys, cov = pf.covariance_matrix(pf.covariance_pairs(industry_returns(spark, d), "industry", "r"))
    a, b = po.minimum_variance(cov, 0.5), po.risk_parity(cov)
    rows = [(int(k), float(x), float(y), float(c)) for k, x, y, c in zip(keys, a, b, pf.risk_contributions(b, cov))]
    return spark.createDataFrame(rows, "industry int, min_variance double, risk_parity double, contribution double")


@query("code", "ewma_var", f"""WITH {PANEL}, p AS (SELECT code, dt, close / lag(close) OVER (PARTITION BY code ORDER BY dt) - 1 AS r FROM panel), w AS (SELECT code, r, exp(-ln(2) / 20 * (row_number() OVER (PARTITION BY code ORDER BY dt DESC) - 1)) AS w FROM p WHERE r IS NOT NULL) ---
  SELECT code, greatest(0.0, sum(w * r * r) / sum(w) - pow(sum(w * r) / sum(w), 2)) AS ewma_var FROM w GROUP BY code""")
def risk_ewma(spark, d):
    return pf.ewma_variance(panel(spark, d))


@query("code days violations", "kupiec", f"""WITH {IRET}, b AS (SELECT *, count(r) OVER x AS c, quantile_cont(r, 0.05) OVER x AS v FROM ir WINDOW x AS (ORDER BY dt ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
  k AS (SELECT code, count(*) AS days, count(*) FILTER (r < v) AS violations FROM b WHERE c >= 60 AND r IS NOT NULL GROUP BY code) ---
  SELECT *, greatest(0.0, 2 * (CASE WHEN violations > 0 THEN violations * ln(violations / days) ELSE 0 END + CASE WHEN violations < days THEN (days - violations) * ln(1 - violations / days) ELSE 0 END - violations * ln(0.05) - (days - violations) * ln(0.95))) AS kupiec FROM k""")
def risk_backtest_var(spark, d):
    return pf.backtest_var(index_series(spark, d))


@query("dt factor", "ret", f"""WITH {LABELS}, wm AS (SELECT *, ln(cap) AS s, sqrt(cap) AS w FROM y WHERE fwd_1 IS NOT NULL AND f IS NOT NULL), mc AS (SELECT *, f - sum(w * f) OVER d / sum(w) OVER d AS fc, s - sum(w * s) OVER d / sum(w) OVER d AS c2, fwd_1 - sum(w * fwd_1) OVER d / sum(w) OVER d AS yc FROM wm WINDOW d AS (PARTITION BY dt)),
  ms AS (SELECT dt, count(*) AS n, sum(w * f) / sum(w) AS mf, sum(w * s) / sum(w) AS m2, sum(w * fwd_1) / sum(w) AS my, sum(w * fc * fc) AS ff, sum(w * c2 * c2) AS ss, sum(w * fc * c2) AS fs, sum(w * fc * yc) AS fy, sum(w * c2 * yc) AS sy FROM mc GROUP BY dt),
  kk AS (SELECT *, CASE WHEN n > 5 THEN (fy * ss - sy * fs) / (ff * ss - fs * fs) END AS k1, CASE WHEN n > 5 THEN (sy * ff - fy * fs) / (ff * ss - fs * fs) END AS k2 FROM ms) ---
  SELECT dt, 'market' AS factor, my - k1 * mf - k2 * m2 AS ret FROM kk UNION ALL SELECT dt, 'f', k1 FROM kk UNION ALL SELECT dt, 'size', k2 FROM kk""", 5)
def risk_barra_returns(spark, d):
    df = labelled(spark, d).withColumn("size", F.ln("cap"))
    return pf.barra_returns(df, "fwd_1", ["f", "size"])


@query("window_id train_start train_end test_start test_end", "", f"""WITH {PANEL}, ds AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM panel)), t AS (SELECT CAST(floor((i - 25) / 6) AS BIGINT) AS window_id, min(dt) AS test_start, max(dt) AS test_end, min(i) AS s FROM ds WHERE i >= 25 GROUP BY 1) ---
  SELECT window_id, a.dt AS train_start, b.dt AS train_end, test_start, test_end FROM t JOIN ds a ON a.i = s - 25 JOIN ds b ON b.i = s - 2""")
def walk_forward_windows(spark, d):
    return ln.walk_forward(panel(spark, d), 24, 6, 1)


@query("combination dt role", "", f"""WITH {PANEL}, ds AS (SELECT dt, ntile(6) OVER (ORDER BY dt) - 1 AS fold FROM (SELECT DISTINCT dt FROM panel)), cb AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS combination, a, b FROM range(6) x(a), range(6) z(b) WHERE a < b),
  t AS (SELECT combination, dt, fold IN (a, b) AS test FROM ds, cb) --- SELECT combination, dt, CASE WHEN test THEN 'test' WHEN max(test::INT) OVER (PARTITION BY combination ORDER BY dt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 THEN 'purged' ELSE 'train' END AS role FROM t""")
def purged_folds(spark, d):
    return ln.purged_folds(panel(spark, d))


@query("code dt", "prediction", f"""WITH {LABELS}, tr AS (SELECT f, g, fwd_1 FROM y WHERE f IS NOT NULL AND g IS NOT NULL AND fwd_1 IS NOT NULL AND dt < DATE '1999-01-01'), mo AS (SELECT avg(f) AS mf, avg(g) AS mg, avg(fwd_1) AS my, stddev_pop(f) AS sf, stddev_pop(g) AS sg, stddev_pop(fwd_1) AS sy, corr(f, g) AS r, corr(f, fwd_1) AS p, corr(g, fwd_1) AS q FROM tr),
  be AS (SELECT *, (p * (1 + 0.1 / sy) - q * r) / (pow(1 + 0.1 / sy, 2) - r * r) * sy / sf AS k1, (q * (1 + 0.1 / sy) - p * r) / (pow(1 + 0.1 / sy, 2) - r * r) * sy / sg AS k2 FROM mo) --- SELECT code, dt, my + k1 * (f - mf) + k2 * (g - mg) AS prediction FROM y, be WHERE f IS NOT NULL AND g IS NOT NULL AND dt >= DATE '1999-01-01'""", 4)
def ridge_predictions(spark, d):
    df = labelled(spark, d)
    model = ln.ridge(df.filter("dt < date'1999-01-01'"), ["f", "g"], "fwd_1")
    return ln.predict(model, df.filter("dt >= date'1999-01-01'"), ["f", "g"])
