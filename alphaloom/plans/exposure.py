"""Registered queries: styles, specific risk, budgets, limits, stress, eligibility, regimes, resampled timing, training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators import exposure as ex
from alphaloom.operators import flows as fl
from alphaloom.operators import pit, price
from alphaloom.operators import performance as pf
from alphaloom.operators import portfolio as po
from alphaloom.operators import preprocess as pp
from alphaloom.operators import scenarios as sc
from alphaloom.operators import timing as tm
from alphaloom.sources.statements import FLOWS, flows
from alphaloom.sources.tables import DIMS, INDEX, PANEL, dims, index_series, panel

from .factors import CROSS, cross
from .fundamental import TTM, trailing
from .registry import QUERIES, query
from .research import LABELS, labelled
from .strategy import IND, IRET, WEIGHTS, _ma, _signal, industry_returns, scored

KNOWN = f"""{PANEL}, {DIMS}, {TTM}, kn AS (SELECT * FROM (SELECT p.code, p.dt, equity, assets, liabilities, tt.net_profit, revenue_yoy, row_number() OVER (PARTITION BY p.code, p.dt ORDER BY end_date DESC) AS rn FROM panel p JOIN tt ON p.code = tt.code AND tt.ann_date <= p.dt) WHERE rn = 1),
  sx AS (SELECT p.*, ln(cap) AS size, cap, equity, assets, liabilities, net_profit, revenue_yoy FROM panel p JOIN dims USING (code) LEFT JOIN kn USING (code, dt)), sr AS (SELECT *, CASE WHEN lag(close) OVER s <> 0 THEN close / lag(close) OVER s - 1 END AS r FROM sx WINDOW s AS (PARTITION BY code ORDER BY dt))"""


BETA = QUERIES["price_beta"].sql.replace("---", "")


@query("code dt", "size nonlinear_size momentum reversal volatility liquidity book_to_price earnings_yield growth leverage beta residual_volatility", f"""WITH {KNOWN} --- SELECT code, dt, size, pow(size - avg(size) OVER (PARTITION BY dt), 3) AS nonlinear_size,
  CASE WHEN abs(lag(close, 12) OVER s) >= 1e-8 THEN (lag(close) OVER s - lag(close, 12) OVER s) / lag(close, 12) OVER s END AS momentum, r AS reversal, CASE WHEN count(r) OVER v >= 6 THEN stddev_samp(r) OVER v END AS volatility, CASE WHEN turnover > 0 THEN ln(turnover) END AS liquidity,
  equity / cap AS book_to_price, net_profit / cap AS earnings_yield, revenue_yoy AS growth, CASE WHEN abs(assets) >= 1e-8 THEN liabilities / assets END AS leverage, bt.beta, bt.idio_vol AS residual_volatility FROM sr JOIN ({BETA}) AS bt USING (code, dt) WINDOW s AS (PARTITION BY code ORDER BY dt), v AS (PARTITION BY code ORDER BY dt ROWS 11 PRECEDING)""", 5)
def barra_exposures(spark, d):
    items = ["equity", "assets", "liabilities", "net_profit", "revenue_yoy"]
    facts = trailing(spark, d).select("code", "ann_date", "end_date", F.struct(*items).alias("facts"))
    known = pit.as_of(panel(spark, d), facts, "facts", rank=()).select("code", "dt", "facts.*")
    return ex.style_exposures(panel(spark, d).join(known, ["code", "dt"]).join(dims(spark, d), "code"))


STYLES = ["f", "size"]
BARRA = f"""{LABELS}, wm AS (SELECT *, ln(cap) AS s, sqrt(cap) AS w FROM y WHERE fwd_1 IS NOT NULL AND f IS NOT NULL), mc AS (SELECT *, f - sum(w * f) OVER d / sum(w) OVER d AS fc, s - sum(w * s) OVER d / sum(w) OVER d AS c2, fwd_1 - sum(w * fwd_1) OVER d / sum(w) OVER d AS yc FROM wm WINDOW d AS (PARTITION BY dt)),
  ms AS (SELECT dt, count(*) AS n, sum(w * f) / sum(w) AS mf, sum(w * s) / sum(w) AS m2, sum(w * fwd_1) / sum(w) AS my, sum(w * fc * fc) AS ff, sum(w * c2 * c2) AS ss, sum(w * fc * c2) AS fs, sum(w * fc * yc) AS fy, sum(w * c2 * yc) AS sy FROM mc GROUP BY dt),
  kk AS (SELECT dt, (fy * ss - sy * fs) / (ff * ss - fs * fs) AS k1, (sy * ff - fy * fs) / (ff * ss - fs * fs) AS k2, mf, m2, my FROM ms WHERE n > 5), ki AS (SELECT dt, my - k1 * mf - k2 * m2 AS k0, k1, k2 FROM kk),
  rs AS (SELECT code, wm.dt, fwd_1 - k0 - k1 * f - k2 * s AS residual FROM wm JOIN ki USING (dt)), sw AS (SELECT *, exp(-ln(2) / 20 * (row_number() OVER (PARTITION BY code ORDER BY dt DESC) - 1)) AS w FROM rs), sv AS (SELECT code, count(*) AS n, sum(w * residual * residual) / sum(w) AS specific FROM sw GROUP BY code)"""


def barra(spark, d):
    """Securities with their exposures, the factor returns, and the residuals of the model."""
    df = labelled(spark, d).withColumn("size", F.ln("cap"))
    returns = pf.barra_returns(df, "fwd_1", STYLES)
    return df, returns, ex.barra_residuals(df, returns, "fwd_1", STYLES)


@query("code n", "specific", f"WITH {BARRA} --- SELECT * FROM sv", 5)
def risk_specific(spark, d):
    return ex.specific_variance(barra(spark, d)[2])


@query("code", "systematic specific total factor_share", f"""WITH {BARRA}, fc AS (SELECT var_samp(k0) AS c00, var_samp(k1) AS c11, var_samp(k2) AS c22, covar_samp(k0, k1) AS c01, covar_samp(k0, k2) AS c02, covar_samp(k1, k2) AS c12 FROM ki),
  xe AS (SELECT code, arg_max(f, dt) AS f, arg_max(ln(cap), dt) AS s FROM y WHERE f IS NOT NULL GROUP BY code), o AS (SELECT code, c00 + f * f * c11 + s * s * c22 + 2 * f * c01 + 2 * s * c02 + 2 * f * s * c12 AS systematic, specific FROM xe JOIN sv USING (code), fc) ---
  SELECT *, systematic + specific AS total, CASE WHEN systematic + specific >= 1e-15 THEN systematic / (systematic + specific) END AS factor_share FROM o""", 5)
def risk_decomposition(spark, d):
    df, returns, residuals = barra(spark, d)
    last = df.filter("f is not null").groupBy("code").agg(F.lit(1.0).alias("market"), F.max_by("f", "dt").alias("f"), F.max_by("size", "dt").alias("size"))
    return ex.decompose_risk(last.unpivot(["code"], ["market", *STYLES], "factor", "x"), ex.factor_covariance(returns), ex.specific_variance(residuals))


_U = "(CAST('0x' || substr(md5(concat_ws(':', '42', {}, '{}')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
_Z = lambda *keys: f"sqrt(-2 * ln({_U.format(', '.join(keys), 'r')})) * cos(2 * pi() * {_U.format(', '.join(keys), 'a')})"
SCENARIOS = 4000
LOSSES = f"""{BARRA}, fc AS (SELECT var_samp(k1) AS ff, var_samp(k0) AS mm, var_samp(k2) AS ss, covar_samp(k1, k0) AS fm, covar_samp(k1, k2) AS fs, covar_samp(k0, k2) AS ms FROM ki), c1 AS (SELECT sqrt(ff) AS l11, fm / sqrt(ff) AS l21, fs / sqrt(ff) AS l31, mm, ss, ms FROM fc),
  c2 AS (SELECT *, sqrt(mm - l21 * l21) AS l22, (ms - l31 * l21) / sqrt(mm - l21 * l21) AS l32 FROM c1), ch AS (SELECT *, sqrt(ss - l31 * l31 - l32 * l32) AS l33 FROM c2), xe AS (SELECT code, arg_max(f, dt) AS f, arg_max(ln(cap), dt) AS s FROM y WHERE f IS NOT NULL GROUP BY code),
  po AS (SELECT CAST(industry AS VARCHAR) AS portfolio, avg(f) AS f, avg(s) AS s, sqrt(sum(specific) / count(*) / count(*)) AS sd FROM xe JOIN sv USING (code) JOIN dims USING (code) GROUP BY 1),
  ls AS (SELECT scenario, portfolio, -(sd * {_Z('scenario', 'portfolio', "'own'")} + (f * l11 + l21 + s * l31) * {_Z('scenario', "'f'")} + (l22 + s * l32) * {_Z('scenario', "'market'")} + s * l33 * {_Z('scenario', "'size'")}) AS loss FROM po, ch, (SELECT unnest(range(0, {SCENARIOS})) AS scenario)),
  lq AS (SELECT portfolio, quantile_disc(loss, 0.99) AS var FROM ls GROUP BY 1)"""


@query("portfolio scenarios", "mean sd var es worst", f"WITH {LOSSES} --- SELECT portfolio, count(*) AS scenarios, avg(loss) AS mean, stddev_samp(loss) AS sd, max(var) AS var, avg(loss) FILTER (loss >= var) AS es, max(loss) AS worst FROM ls JOIN lq USING (portfolio) GROUP BY 1", 5)
def stress_scenarios(spark, d):
    """Equal-weighted industries under simulated shocks of the factor model."""
    df, returns, residuals = barra(spark, d)
    last = df.filter("f is not null").groupBy("code").agg(F.max_by("f", "dt").alias("f"), F.max_by("size", "dt").alias("size"))
    held = last.join(ex.specific_variance(residuals), "code").join(dims(spark, d), "code").groupBy(F.col("industry").cast("string").alias("portfolio"))
    wide = held.agg(F.lit(1.0).alias("market"), F.avg("f").alias("f"), F.avg("size").alias("size"), (F.sum("specific") / F.count(F.lit(1)) / F.count(F.lit(1))).alias("own"))
    tall = wide.unpivot(["portfolio"], ["market", "f", "size", "own"], "factor", "x").withColumn("factor", F.when(F.col("factor") != "own", F.col("factor")))
    return sc.tail(sc.scenario_losses(tall, ex.factor_covariance(returns), SCENARIOS), 0.99)


@query("code", "var spread_cost participation impact_cost lvar", f"""WITH {LABELS}, mo AS (SELECT code, avg(g) AS mean, stddev_samp(g) AS sd, avg(amount) AS daily_volume, arg_max(cap, dt) AS cap FROM y GROUP BY code), lv AS (SELECT code, -(mean - 1.6448536269514722 * sd) AS var, 0.0005 AS spread_cost, CASE WHEN daily_volume > 0 THEN greatest(cap * 1000 / daily_volume, 0) ELSE 0 END AS participation FROM mo) ---
  SELECT *, 0.1 * sqrt(participation) AS impact_cost, var + spread_cost + 0.1 * sqrt(participation) AS lvar FROM lv""")
def risk_liquidity_adjusted(spark, d):
    per = labelled(spark, d).groupBy("code").agg(F.avg("g").alias("mean"), F.stddev_samp("g").alias("sd"), F.avg("amount").alias("daily_volume"), (F.max_by("cap", "dt") * 1000).alias("position"))
    return sc.liquidity_adjusted(per)


RB = f"{IND}, fx AS (SELECT CAST(industry AS VARCHAR) AS factor, stddev_samp(r) AS risk, avg(r) / stddev_samp(r) AS icir FROM iv WHERE r IS NOT NULL GROUP BY 1)"


@query("factor", "equal icir_budget parity", f"WITH {RB} --- SELECT factor, 0.15 / count(*) OVER () AS equal, abs(icir) / sum(abs(icir)) OVER () * 0.15 AS icir_budget, (1 / risk) / sum(1 / risk) OVER () * 0.15 AS parity FROM fx")
def risk_budgets(spark, d):
    per = industry_returns(spark, d).filter("r is not null").groupBy(F.col("industry").cast("string").alias("factor")).agg(F.stddev_samp("r").alias("risk"), (F.avg("r") / F.stddev_samp("r")).alias("icir"))
    out = ex.risk_budget(per, method="equal").withColumnRenamed("budget", "equal")
    out = ex.risk_budget(out, method="icir").withColumnRenamed("budget", "icir_budget")
    return ex.risk_budget(out, method="parity").withColumnRenamed("budget", "parity")


@query("code breaches action", "worst multiplier", f"""WITH {PANEL}, r AS (SELECT code, dt, close / lag(close) OVER s - 1 AS r, 1 - close / max(close) OVER (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING) AS dd FROM panel WINDOW s AS (PARTITION BY code ORDER BY dt)),
  m AS (SELECT code, stddev_samp(r) AS vol, max(dd) AS drawdown, -min(r) AS loss FROM r GROUP BY code), k AS (SELECT *, CAST(coalesce(vol / 0.1 > 1, false) AS INTEGER) + CAST(coalesce(drawdown / 0.25 > 1, false) AS INTEGER) + CAST(coalesce(loss / 0.2 > 1, false) AS INTEGER) AS breaches, greatest(coalesce(vol / 0.1, 0), coalesce(drawdown / 0.25, 0), coalesce(loss / 0.2, 0)) AS worst FROM m),
  a AS (SELECT *, CASE WHEN worst > 2 THEN 'stop' WHEN breaches > 1 THEN 'reduce' WHEN breaches = 1 THEN 'reduce_factor' ELSE 'none' END AS action FROM k) --- SELECT *, CASE action WHEN 'stop' THEN 0.2 WHEN 'reduce' THEN 0.5 WHEN 'reduce_factor' THEN 0.7 ELSE 1.0 END AS multiplier FROM a""")
def risk_limits(spark, d):
    df = price.returns(panel(spark, d)).withColumn("dd", 1 - F.col("close") / F.max("close").over(ex.series().rowsBetween(ex.W.unboundedPreceding, 0)))
    measures = df.groupBy("code").agg(F.stddev_samp("ret").alias("vol"), F.max("dd").alias("drawdown"), (-F.min("ret")).alias("loss"))
    return ex.check_limits(measures, {"vol": 0.1, "drawdown": 0.25, "loss": 0.2})


@query("code", "normal student")
def risk_simulated_var(spark, d):
    return ex.simulated_var(price.returns(panel(spark, d)), "ret")


@query("a b dt", "cov", f"WITH {IND}, p AS (SELECT x.industry AS a, z.industry AS b, x.dt, x.r AS xr, z.r AS zr FROM iv x JOIN iv z ON x.dt = z.dt AND x.industry <= z.industry WHERE x.r IS NOT NULL AND z.r IS NOT NULL), c AS (SELECT a, b, dt, count(*) OVER w AS n, covar_samp(xr, zr) OVER w AS cov FROM p WINDOW w AS (PARTITION BY a, b ORDER BY dt ROWS 11 PRECEDING)) --- SELECT a, b, dt, cov FROM c WHERE n >= 12")
def risk_rolling_covariance(spark, d):
    return ex.rolling_covariance(industry_returns(spark, d), "industry", "r")


@query("period n", "loss worst", f"""WITH {LABELS}, h AS (SELECT dt, avg(coalesce(g, 0)) AS r FROM y GROUP BY dt), s AS (SELECT unnest(['first', 'second', 'overlap']) AS period, unnest([DATE '1996-01-01', DATE '1998-01-01', DATE '1996-06-01']) AS a, unnest([DATE '1996-12-31', DATE '1999-06-30', DATE '1998-06-30']) AS b) ---
  SELECT period, count(*) AS n, exp(sum(ln(1 + r))) - 1 AS loss, min(r) AS worst FROM (SELECT period, dt, r * (SELECT count(*) FROM y z WHERE z.dt = h.dt) / (SELECT count(*) FROM dims) AS r FROM h JOIN s ON dt BETWEEN a AND b) GROUP BY period""", 5)
def stress_periods(spark, d):
    codes = dims(spark, d).select("code", (1 / F.count(F.lit(1)).over(ex.W.partitionBy())).alias("weight"))  # equal weights
    return ex.stress_periods(codes, labelled(spark, d), {"first": ("1996-01-01", "1996-12-31"), "second": ("1998-01-01", "1999-06-30"), "overlap": ("1996-06-01", "1998-06-30")}, "g")


@query("scenario", "loss", f"WITH {DIMS}, w AS (SELECT industry, count(*) / sum(count(*)) OVER () AS weight FROM dims GROUP BY 1), s AS (SELECT k AS industry, 'crash' AS scenario, -0.05 * (k + 1) AS shock FROM range(6) t(k) UNION ALL SELECT k, 'rotation', CASE WHEN k % 2 = 0 THEN 0.1 ELSE -0.1 END FROM range(4) t(k)) --- SELECT scenario, sum(weight * shock) AS loss FROM w JOIN s USING (industry) GROUP BY 1")
def stress_shocks(spark, d):
    weights = dims(spark, d).groupBy("industry").agg((F.count(F.lit(1)) / F.sum(F.count(F.lit(1))).over(ex.W.partitionBy())).alias("weight"))
    k = F.col("id")
    shocks = spark.range(6).select(k.alias("industry"), F.lit("crash").alias("scenario"), (-0.05 * (k + 1)).alias("shock")).unionByName(spark.range(4).select(k.alias("industry"), F.lit("rotation").alias("scenario"), F.when(k % 2 == 0, 0.1).otherwise(-0.1).alias("shock")))
    return ex.stress_shocks(weights, shocks, "industry")


@query("code", "volume", f"""WITH {PANEL}, {DIMS}, l AS (SELECT p.code, dt, volume, is_st, DATE '1998-06-01' - CAST(p.code % 120 AS INTEGER) AS list_date, coalesce(close / lag(close) OVER (PARTITION BY p.code ORDER BY dt) - 1 > 0.1, false) AS up FROM panel p JOIN dims USING (code)) ---
  SELECT code, volume FROM l WHERE dt = DATE '1998-06-01' AND NOT is_st AND date_diff('day', list_date, dt) > 60 AND NOT up AND volume > 50""")
def universe_eligible(spark, d):
    df = price.returns(panel(spark, d)).join(dims(spark, d), "code").withColumns({"list_date": F.date_sub(F.lit("1998-06-01").cast("date"), (F.col("code") % 120).cast("int")), "limit_up": F.col("ret") > 0.1})
    return ex.eligible(df, "1998-06-01", 60, 50)


@query("dt factor", "pnl", f"""WITH {WEIGHTS}, ps AS (SELECT dt, code, weight * coalesce(fwd_1, 0) AS pnl FROM wt), e AS (SELECT dt, code, unnest(['f', 'g']) AS factor, abs(unnest([f, g])) AS x FROM y), e1 AS (SELECT dt, code, factor, x / sum(x) OVER (PARTITION BY dt, code) AS s FROM e WHERE x > 0) ---
  SELECT dt, coalesce(factor, 'specific') AS factor, sum(pnl * coalesce(s, 1)) AS pnl FROM ps LEFT JOIN e1 USING (dt, code) GROUP BY 1, 2""")
def performance_pnl_attribution(spark, d):
    df = scored(spark, d)
    held = po.score_weights(df).select("dt", "code", (F.col("weight") * F.coalesce("fwd_1", F.lit(0.0))).alias("pnl"))
    return ex.pnl_attribution(held, df.select("dt", "code", "f", "g").unpivot(["dt", "code"], ["f", "g"], "factor", "x"))


@query("dt code", "weight", f"""WITH {WEIGHTS}, nd AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS nx FROM (SELECT DISTINCT dt FROM wt)), o AS (SELECT nx AS dt, code, weight AS ow FROM wt JOIN nd USING (dt) WHERE nx IS NOT NULL), j AS (SELECT dt, code, coalesce(weight, 0) AS n, coalesce(ow, 0) AS o FROM wt FULL JOIN o USING (dt, code)) ---
  SELECT dt, code, CASE WHEN abs(n - o) < 0.03 THEN o ELSE n END AS weight FROM j WHERE CASE WHEN abs(n - o) < 0.03 THEN o ELSE n END <> 0""")
def portfolio_cost_filter(spark, d):
    w = po.score_weights(scored(spark, d)).select("dt", "code", "weight")
    dates = w.select("dt").distinct().withColumn("next", F.lead("dt").over(ex.W.orderBy("dt")))  # one row a date
    old = w.join(dates, "dt").filter("next is not null").select(F.col("next").alias("dt"), "code", "weight")
    return ex.cost_filter(w, old, 0.03)


@query("dt weekly biweekly monthly", "", f"""WITH {INDEX}, c AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS a FROM idx), k AS (SELECT *, CAST(floor((date_diff('day', DATE '1970-01-01', dt) + 3) / 7) AS BIGINT) AS w, CAST(floor((date_diff('day', DATE '1970-01-01', a) + 3) / 7) AS BIGINT) AS wa FROM c) ---
  SELECT dt, a IS NULL OR w <> wa AS weekly, (a IS NULL OR w <> wa) AND w % 2 = 0 AS biweekly, a IS NULL OR month(a) <> month(dt) AS monthly FROM k""")
def calendar_rebalance(spark, d):
    return ex.rebalance_days(index_series(spark, d))


@query("code dt f_missing g_missing", "", f"WITH {LABELS} --- SELECT code, dt, CAST(f IS NULL AS INTEGER) AS f_missing, CAST(g IS NULL AS INTEGER) AS g_missing FROM y")
def missing_flags(spark, d):
    return pp.missing_flags(labelled(spark, d), ["f", "g"])


@query("code dt", "f", f"""WITH {CROSS}, v AS (SELECT code, dt, f, CASE WHEN count(f) OVER a >= 2 THEN stddev_samp(f) OVER a END AS v1, CASE WHEN count(f) OVER b >= 2 THEN stddev_samp(f) OVER b END AS v2 FROM x WINDOW a AS (PARTITION BY code ORDER BY dt ROWS 5 PRECEDING), b AS (PARTITION BY code ORDER BY dt ROWS 23 PRECEDING)),
  m AS (SELECT *, median(f) OVER (PARTITION BY dt) AS med, 3 * coalesce(CASE WHEN v2 > 0 THEN least(greatest(v1 / v2, 0.5), 2.0) END, 1) AS k FROM v), n AS (SELECT *, 1.4826 * median(abs(f - med)) OVER (PARTITION BY dt) AS mad FROM m) ---
  SELECT code, dt, CASE WHEN f IS NULL THEN NULL WHEN mad > 0 THEN least(greatest(f, med - k * mad), med + k * mad) ELSE f END AS f FROM n""")
def winsorize_adaptive(spark, d):
    w = ex.series()
    vols = {name: F.when(F.count("f").over(w.rowsBetween(-k, 0)) >= 2, F.stddev_samp("f").over(w.rowsBetween(-k, 0))) for name, k in (("v1", 5), ("v2", 23))}
    return pp.winsorize_adaptive(cross(spark, d).withColumns(vols), "f", "v1", "v2")


@query("code dt", "f_rank g_rank target", f"""WITH {LABELS}, k AS (SELECT *, CASE WHEN f IS NOT NULL THEN (rank() OVER (PARTITION BY dt, f IS NULL ORDER BY f) + (count(*) OVER (PARTITION BY dt, f) - 1) / 2.0) / count(f) OVER (PARTITION BY dt) END AS f_rank,
  CASE WHEN g IS NOT NULL THEN (rank() OVER (PARTITION BY dt, g IS NULL ORDER BY g) + (count(*) OVER (PARTITION BY dt, g) - 1) / 2.0) / count(g) OVER (PARTITION BY dt) END AS g_rank, fwd_1 - avg(fwd_1) OVER (PARTITION BY dt, industry) AS target FROM y WHERE fwd_1 IS NOT NULL) --- SELECT * FROM k""")
def training_table(spark, d):
    return pp.training_table(labelled(spark, d), ["f", "g"], "fwd_1")


@query("code dt", "sentiment_mean supply patent_growth policy", f"""WITH {FLOWS}, a AS (SELECT code, dt, inflow / volume AS s, CASE WHEN large > 0 THEN large END AS o, CASE WHEN super_large > 40 THEN super_large END AS v, holding AS h, margin FROM fl) ---
  SELECT code, dt, CASE WHEN count(s) OVER w >= 5 THEN avg(s) OVER w END AS sentiment_mean, CASE WHEN o IS NULL THEN v WHEN v IS NULL THEN o ELSE 0.6 * o + 0.4 * v END AS supply, CASE WHEN lag(h, 4) OVER p <> 0 THEN h / lag(h, 4) OVER p - 1 END AS patent_growth, margin AS policy
  FROM a WINDOW w AS (PARTITION BY code ORDER BY dt ROWS 19 PRECEDING), p AS (PARTITION BY code ORDER BY dt)""")
def flow_alternative(spark, d):
    f = flows(spark, d)
    return fl.alternative(f.select("code", "dt", (F.col("inflow") / F.col("volume")).alias("sentiment"), F.when(F.col("large") > 0, F.col("large")).alias("orders"), F.when(F.col("super_large") > 40, F.col("super_large")).alias("deliveries"), F.col("holding").alias("patents"), F.col("margin").alias("policy_score")))


MF = f"""{IRET}, mf AS (SELECT dt, volume, close / {_ma(20)} - 1 AS trend_20, close / {_ma(60)} - 1 AS trend_60, CASE WHEN count(r) OVER a >= 20 THEN stddev_samp(r) OVER a * sqrt(252) END AS vol_20, CASE WHEN count(r) OVER b >= 60 THEN stddev_samp(r) OVER b * sqrt(252) END AS vol_60,
  {_ma(10, 'volume')} / {_ma(60, 'volume')} AS volume_ratio, close / lag(close, 5) OVER o - 1 AS ret_5, close / lag(close, 20) OVER o - 1 AS ret_20, r FROM ir WINDOW a AS (ORDER BY dt ROWS 19 PRECEDING), b AS (ORDER BY dt ROWS 59 PRECEDING), o AS (ORDER BY dt))"""


@query("dt", "trend_20 trend_60 vol_20 vol_60 volume_ratio ret_5 ret_20", f"WITH {MF} --- SELECT * FROM mf")
def market_features(spark, d):
    return tm.market_features(index_series(spark, d))


@query("dt", "spread mean_spread", f"""WITH {LABELS}, p AS (SELECT *, percent_rank() OVER (PARTITION BY dt ORDER BY cap, code) AS k FROM y WHERE g IS NOT NULL), s AS (SELECT dt, avg(g) FILTER (k <= 0.3) - avg(g) FILTER (k >= 0.7) AS spread FROM p GROUP BY dt) --- SELECT dt, spread, avg(spread) OVER (ORDER BY dt ROWS 19 PRECEDING) AS mean_spread FROM s""")
def regime_size_spread(spark, d):
    return tm.size_spread(labelled(spark, d))


@query("dt", "dispersion", f"WITH {IND} --- SELECT dt, CASE WHEN count(r) >= 3 THEN stddev_samp(r) END AS dispersion FROM iv WHERE r IS NOT NULL GROUP BY dt")
def regime_dispersion(spark, d):
    return tm.sector_dispersion(labelled(spark, d))


BY = f"""{INDEX}, b0 AS (SELECT dt, close, {_signal(f'{_ma(5)} > {_ma(20)}', f'{_ma(5)} < {_ma(20)}')} AS a, {_signal(f'{_ma(20)} > {_ma(60)}', f'{_ma(20)} < {_ma(60)}')} AS c, lead(close) OVER (ORDER BY dt) / close - 1 AS nx FROM idx),
  b1 AS (SELECT *, CASE a WHEN 'LONG' THEN 1.0 WHEN 'SHORT' THEN -1.0 ELSE 0 END AS sa, CASE c WHEN 'LONG' THEN 1.0 WHEN 'SHORT' THEN -1.0 ELSE 0 END AS sc FROM b0), b2 AS (SELECT *, CASE WHEN sa <> 0 AND nx IS NOT NULL THEN (sa * nx > 0)::INT END AS ha, CASE WHEN sc <> 0 AND nx IS NOT NULL THEN (sc * nx > 0)::INT END AS hc FROM b1),
  b3 AS (SELECT *, (10 + coalesce(sum(ha) OVER w, 0)) / (20 + count(ha) OVER w) AS wa, (10 + coalesce(sum(hc) OVER w, 0)) / (20 + count(hc) OVER w) AS wc FROM b2 WINDOW w AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), b4 AS (SELECT dt, (wa * sa + wc * sc) / (wa + wc) AS score FROM b3)"""


@query("dt fused", "score", f"WITH {BY} --- SELECT dt, score, {_signal('score > 0.2', 'score < -0.2')} AS fused FROM b4")
def timing_bayesian(spark, d):
    df = tm.ma_cross(index_series(spark, d), 5, 20).withColumnRenamed("ma_cross", "short_cross").drop("_f", "_s")
    return tm.fuse_by_hits(tm.ma_cross(df), ["short_cross", "ma_cross"])


def _block(k: int) -> str:
    return f"""e{k} AS (SELECT dt, i, close, CASE WHEN count(*) OVER b >= 20 THEN sign(avg(close) OVER a - avg(close) OVER b) END AS t FROM n WHERE i % {k} = 0 WINDOW a AS (ORDER BY dt ROWS 4 PRECEDING), b AS (ORDER BY dt ROWS 19 PRECEDING)),
  j{k} AS (SELECT n.dt, coalesce(e{k}.t, 0) AS t FROM n ASOF LEFT JOIN e{k} ON n.dt >= e{k}.dt)"""


@query("dt", "score", f"WITH {INDEX}, n AS (SELECT *, row_number() OVER (ORDER BY dt) AS i FROM idx), {_block(1)}, {_block(5)}, {_block(20)} --- SELECT dt, 0.5 * j1.t + 0.3 * j5.t + 0.2 * j20.t AS score FROM j1 JOIN j5 USING (dt) JOIN j20 USING (dt)")
def timing_resampled(spark, d):
    return tm.resampled(index_series(spark, d), {1: 0.5, 5: 0.3, 20: 0.2})
