"""Registered queries: price factors and cross-sectional preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators import preprocess as pp
from alphaloom.operators import price
from alphaloom.sources.tables import BARS, DIMS, PANEL, bars, dims, panel

from .registry import query
from .research import two_controls

ROLL = "PARTITION BY code ORDER BY dt ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
RET = f"""{PANEL}, r AS (SELECT *, CASE WHEN lag(close) OVER s <> 0 THEN close / lag(close) OVER s - 1 END AS ret FROM panel WINDOW s AS (PARTITION BY code ORDER BY dt))"""


@query("code dt", "ret_reversal ret_3_skip ret_6_skip ret_12_skip", f"""WITH {PANEL} --- SELECT code, dt, close / lag(close, 1) OVER s - 1 AS ret_reversal,
  lag(close, 1) OVER s / lag(close, 3) OVER s - 1 AS ret_3_skip, lag(close, 1) OVER s / lag(close, 6) OVER s - 1 AS ret_6_skip,
  lag(close, 1) OVER s / lag(close, 12) OVER s - 1 AS ret_12_skip FROM panel WINDOW s AS (PARTITION BY code ORDER BY dt)""")
def momentum_reversal(spark, d):
    return price.momentum(panel(spark, d))


@query("code dt", "vol", f"""WITH {RET} --- SELECT code, dt, CASE WHEN count(ret) OVER w >= 10 THEN stddev_samp(ret) OVER w * sqrt(252) END AS vol
  FROM r WINDOW w AS ({ROLL.format(19)})""")
def price_volatility(spark, d):
    return price.volatility(panel(spark, d))


@query("code dt", "turnover_mean amihud zero_ratio", f"""WITH {RET}, x AS (SELECT *, abs(ret) / nullif(amount, 0) AS ill, CASE WHEN abs(ret) < 0.01 THEN 1.0 ELSE 0.0 END AS still FROM r) ---
  SELECT code, dt, CASE WHEN count(turnover) OVER w >= 10 THEN avg(turnover) OVER w END AS turnover_mean,
  CASE WHEN count(ill) OVER w >= 10 THEN avg(ill) OVER w * 1e6 END AS amihud, CASE WHEN count(*) OVER w >= 10 THEN avg(still) OVER w END AS zero_ratio
  FROM x WINDOW w AS ({ROLL.format(19)})""")
def price_liquidity(spark, d):
    return price.liquidity(panel(spark, d))


@query("code dt", "pv_corr", f"""WITH {RET}, v AS (SELECT *, CASE WHEN ret IS NOT NULL THEN volume END AS vv FROM r) --- SELECT code, dt,
  CASE WHEN count(ret) OVER w >= 20 AND stddev_samp(ret) OVER w * stddev_samp(vv) OVER w > 1e-12 THEN covar_samp(ret, vv) OVER w / (stddev_samp(ret) OVER w * stddev_samp(vv) OVER w) END AS pv_corr
  FROM v WINDOW w AS ({ROLL.format(19)})""")
def price_volume_corr(spark, d):
    return price.price_volume_corr(panel(spark, d))


@query("code dt", "hl_ratio", f"""WITH {PANEL} --- SELECT code, dt, CASE WHEN count(*) OVER w >= 10 THEN avg(2 * (high - low) / (high + low)) OVER w END AS hl_ratio
  FROM panel WINDOW w AS ({ROLL.format(9)})""")
def price_high_low(spark, d):
    return price.high_low_ratio(panel(spark, d))


@query("code dt", "bollinger", f"""WITH {PANEL} --- SELECT code, dt, CASE WHEN count(*) OVER w >= 20 AND 2 * stddev_samp(close) OVER w >= 1e-8
  THEN greatest(-1.0, least(1.0, (close - avg(close) OVER w) / (2 * stddev_samp(close) OVER w))) END AS bollinger FROM panel WINDOW w AS ({ROLL.format(19)})""")
def price_bollinger(spark, d):
    return price.bollinger(panel(spark, d))


@query("code dt", "obv_ratio", f"""WITH {RET}, o AS (SELECT *, sum(coalesce(sign(ret), 0) * volume) OVER ({ROLL.format('UNBOUNDED')}) AS obv FROM r),
  m AS (SELECT *, CASE WHEN count(obv) OVER w >= 10 THEN avg(obv) OVER w END AS ma FROM o WINDOW w AS ({ROLL.format(19)})) ---
  SELECT code, dt, CASE WHEN abs(ma) >= 1e-8 THEN greatest(-3.0, least(3.0, obv / ma - 1)) END AS obv_ratio FROM m""")
def price_obv(spark, d):
    return price.obv_ratio(panel(spark, d))


@query("code dt", "overnight intraday_ratio vpin", f"""WITH {BARS}, a AS (SELECT *, CASE WHEN abs(lag(close) OVER s) >= 1e-8 THEN open / lag(close) OVER s - 1 END AS o,
    CASE WHEN abs(open) >= 1e-8 THEN close / open - 1 END AS i, CASE WHEN lag(close) OVER s <> 0 THEN close / lag(close) OVER s - 1 END AS ret,
    CASE WHEN count(volume) OVER w >= 5 THEN volume / avg(volume) OVER w END AS vr
    FROM bars WINDOW s AS (PARTITION BY code ORDER BY dt), w AS ({ROLL.format(19)})), b AS (SELECT *, abs(ret) * vr AS v FROM a) ---
  SELECT code, dt, CASE WHEN count(o) OVER w >= 5 THEN avg(o) OVER w END AS overnight,
  CASE WHEN count(i) OVER w >= 5 AND count(o) OVER w >= 5 AND avg(abs(o)) OVER w >= 1e-8 THEN avg(abs(i)) OVER w / avg(abs(o)) OVER w END AS intraday_ratio,
  CASE WHEN count(v) OVER w >= 5 THEN avg(v) OVER w END AS vpin FROM b WINDOW w AS ({ROLL.format(19)})""")
def price_microstructure(spark, d):
    return price.microstructure(bars(spark, d))


@query("code dt", "beta idio_vol", f"""WITH {RET}, m AS (SELECT dt, avg(ret) AS mkt FROM r GROUP BY dt), j AS (SELECT r.*, m.mkt, CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN mkt END AS x,
    CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN ret END AS y FROM r LEFT JOIN m USING (dt)), b AS (SELECT *, var_samp(x) OVER w AS vx, var_samp(y) OVER w AS vy,
    CASE WHEN count(x) OVER w >= 12 AND var_samp(x) OVER w > 1e-12 THEN covar_samp(x, y) OVER w / var_samp(x) OVER w END AS beta FROM j WINDOW w AS ({ROLL.format(23)})) ---
  SELECT code, dt, beta, CASE WHEN beta IS NOT NULL THEN sqrt(greatest(0.0, vy - beta * beta * vx)) END AS idio_vol FROM b""")
def price_beta(spark, d):
    df = panel(spark, d)
    out = price.beta(df, price.returns(df).groupBy("dt").agg(F.avg("ret").alias("mkt")))
    return out.withColumn("idio_vol", F.when(F.col("beta").isNotNull(), F.col("idio_vol")))


@query("code dt", "max_drawdown", f"""WITH {PANEL}, x AS (SELECT *, close / max(close) OVER ({ROLL.format(59)}) - 1 AS dd FROM panel) --- SELECT code, dt, min(dd) OVER ({ROLL.format(59)}) AS max_drawdown FROM x""")
def price_drawdown(spark, d):
    return price.drawdown(panel(spark, d))


@query("code dt", "macd_signal rsi", f"""WITH RECURSIVE {PANEL}, n AS (SELECT code, dt, close, row_number() OVER (PARTITION BY code ORDER BY dt) AS i, count(*) OVER (PARTITION BY code) AS c FROM panel),
  em AS (SELECT *, close AS e1, close AS e2, CAST(0 AS DOUBLE) AS dif, CAST(0 AS DOUBLE) AS dea, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down FROM n WHERE i = 1
    UNION ALL SELECT code, dt, close, i, c, e1, e2, e1 - e2, dea + 0.2 * (e1 - e2 - dea), up, down FROM (SELECT n.*, em.e1 + 2 / 13 * (n.close - em.e1) AS e1, em.e2 + 2 / 27 * (n.close - em.e2) AS e2, em.dea, em.up + (greatest(n.close - em.close, 0) - em.up) / 14 AS up, em.down + (greatest(em.close - n.close, 0) - em.down) / 14 AS down FROM em JOIN n ON n.code = em.code AND n.i = em.i + 1)) ---
  SELECT code, dt, CASE WHEN c >= 35 THEN (dif - dea) / close * 100 END AS macd_signal, CASE WHEN i > 14 AND up + down > 0 THEN 100 * up / (up + down) END AS rsi FROM em""")
def price_ema_family(spark, d):
    return price.ema_family(panel(spark, d))


@query("code dt", "close_mean_5 close_std_5 close_max_10 volume_min_10", f"""WITH {PANEL} --- SELECT code, dt, CASE WHEN count(*) OVER a >= 5 THEN avg(close) OVER a END AS close_mean_5,
  CASE WHEN count(*) OVER a >= 5 THEN stddev_samp(close) OVER a END AS close_std_5, CASE WHEN count(*) OVER b >= 10 THEN max(close) OVER b END AS close_max_10,
  CASE WHEN count(*) OVER b >= 10 THEN min(volume) OVER b END AS volume_min_10 FROM panel WINDOW a AS ({ROLL.format(4)}), b AS ({ROLL.format(9)})""")
def features_rolling(spark, d):
    return price.rolling_features(panel(spark, d), ["close", "volume"])


@query("code dt", "close_x_turnover close_over_turnover close_plus_turnover close_minus_turnover close_squared", f"""WITH {PANEL} --- SELECT code, dt, close * turnover AS close_x_turnover,
  CASE WHEN abs(turnover) >= 1e-8 THEN close / turnover END AS close_over_turnover, close + turnover AS close_plus_turnover, close - turnover AS close_minus_turnover, close * close AS close_squared FROM panel""", 7)
def features_interaction(spark, d):
    return price.interactions(panel(spark, d), [("close", "turnover")])


# Cross sections: the one-month return of suppliers, null where it is unknown, with industry and cap.
CROSS = f"""{RET}, {DIMS}, x AS (SELECT r.code, r.dt, r.ret AS f, industry, cap, r.turnover AS g FROM r JOIN dims USING (code))"""


def cross(spark, d):
    df = price.returns(panel(spark, d)).select("code", "dt", F.col("ret").alias("f"), F.col("turnover").alias("g"))
    return df.join(dims(spark, d), "code")


@query("code dt", "f", f"WITH {CROSS} --- SELECT code, dt, coalesce(f, median(f) OVER (PARTITION BY dt)) AS f FROM x")
def fill_median(spark, d):
    return pp.fill(cross(spark, d), "f", "median")


@query("code dt", "f", f"WITH {CROSS} --- SELECT code, dt, coalesce(f, avg(f) OVER (PARTITION BY dt)) AS f FROM x")
def fill_mean(spark, d):
    return pp.fill(cross(spark, d), "f", "mean")


@query("code dt", "f", f"WITH {CROSS} --- SELECT code, dt, coalesce(f, avg(f) OVER (PARTITION BY dt, industry)) AS f FROM x")
def fill_industry(spark, d):
    return pp.fill(cross(spark, d), "f", "industry")


@query("code dt", "f", f"""WITH {CROSS}, h AS (SELECT code, dt, CASE WHEN abs(f) < 0.4 THEN f END AS f FROM x), c AS (SELECT *, count(f) OVER (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING) AS run,
    last_value(f IGNORE NULLS) OVER (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING) AS l FROM h) --- SELECT code, dt, l * exp(-0.1 * (row_number() OVER (PARTITION BY code, run ORDER BY dt) - 1)) AS f FROM c""")
def fill_decay(spark, d):
    return pp.fill_decay(cross(spark, d).withColumn("f", F.when(F.abs("f") < 0.4, F.col("f"))), "f")


MAD = f"""{CROSS}, m AS (SELECT *, median(f) OVER (PARTITION BY dt) AS med FROM x), n AS (SELECT *, 1.4826 * median(abs(f - med)) OVER (PARTITION BY dt) AS mad FROM m)"""


@query("code dt", "f", f"""WITH {MAD} --- SELECT code, dt, CASE WHEN f IS NULL THEN NULL WHEN mad > 0 THEN least(greatest(f, med - 3 * mad), med + 3 * mad)
  ELSE least(greatest(f, quantile_cont(f, 0.01) OVER (PARTITION BY dt)), quantile_cont(f, 0.99) OVER (PARTITION BY dt)) END AS f FROM n""")
def winsorize_mad(spark, d):
    return pp.winsorize(cross(spark, d), "f", "mad")


@query("code dt", "f", f"""WITH {CROSS} --- SELECT code, dt, CASE WHEN f IS NOT NULL THEN least(greatest(f, quantile_cont(f, 0.05) OVER (PARTITION BY dt)), quantile_cont(f, 0.95) OVER (PARTITION BY dt)) END AS f FROM x""")
def winsorize_quantile(spark, d):
    return pp.winsorize(cross(spark, d), "f", "quantile", low=0.05, high=0.95)


@query("code dt", "f", f"""WITH {CROSS} --- SELECT code, dt, CASE WHEN f IS NULL THEN NULL WHEN stddev_samp(f) OVER p > 0 THEN least(greatest(f, avg(f) OVER p - 2 * stddev_samp(f) OVER p), avg(f) OVER p + 2 * stddev_samp(f) OVER p) ELSE f END AS f
  FROM x WINDOW p AS (PARTITION BY dt)""")
def winsorize_sigma(spark, d):
    return pp.winsorize(cross(spark, d), "f", "sigma", p=2.0)


@query("code dt", "f", f"WITH {CROSS} --- SELECT code, dt, CASE WHEN stddev_samp(f) OVER p > 0 THEN (f - avg(f) OVER p) / stddev_samp(f) OVER p ELSE f - avg(f) OVER p END AS f FROM x WINDOW p AS (PARTITION BY dt)")
def standardize_zscore(spark, d):
    return pp.standardize(cross(spark, d), "f", "zscore")


RANKED = f"""{CROSS}, k AS (SELECT *, CASE WHEN f IS NOT NULL THEN rank() OVER (PARTITION BY dt, f IS NULL ORDER BY f) + (count(*) OVER (PARTITION BY dt, f) - 1) / 2.0 END AS rk FROM x)"""


@query("code dt", "f", f"WITH {RANKED} --- SELECT code, dt, rk / count(f) OVER (PARTITION BY dt) AS f FROM k")
def standardize_rank(spark, d):
    return pp.standardize(cross(spark, d), "f", "rank")


@query("code dt", "f", f"WITH {RANKED} --- SELECT code, dt, CASE WHEN stddev_samp(rk) OVER p > 0 THEN (rk - avg(rk) OVER p) / stddev_samp(rk) OVER p ELSE rk - avg(rk) OVER p END AS f FROM k WINDOW p AS (PARTITION BY dt)")
def standardize_rank_zscore(spark, d):
    return pp.standardize(cross(spark, d), "f", "rank_zscore")


@query("code dt", "f")
def standardize_rank_normal(spark, d):
    return pp.standardize(cross(spark, d), "f", "rank_normal")


@query("code dt", "f", f"WITH {CROSS} --- SELECT code, dt, CASE WHEN max(f) OVER p > min(f) OVER p THEN (f - min(f) OVER p) / (max(f) OVER p - min(f) OVER p) ELSE 0.5 END AS f FROM x WINDOW p AS (PARTITION BY dt)")
def standardize_minmax(spark, d):
    return pp.standardize(cross(spark, d), "f", "minmax")


@query("code dt", "f", f"WITH {MAD} --- SELECT code, dt, CASE WHEN mad > 0 THEN (f - med) / mad ELSE f - med END AS f FROM n")
def standardize_robust(spark, d):
    return pp.standardize(cross(spark, d), "f", "robust")


@query("code dt", "f", f"WITH {CROSS} --- SELECT code, dt, f - avg(f) OVER (PARTITION BY dt, industry) AS f FROM x")
def neutralize_industry(spark, d):
    return pp.neutralize_industry(cross(spark, d), "f")


@query("code dt", "f", f"""WITH {CROSS}, c AS (SELECT *, CASE WHEN f IS NOT NULL THEN ln(cap) END AS c FROM x) --- SELECT code, dt, CASE WHEN count(f) OVER p >= 10 AND var_samp(c) OVER p > 1e-12
  THEN f - avg(f) OVER p - covar_samp(c, f) OVER p / var_samp(c) OVER p * (c - avg(c) OVER p) ELSE f END AS f FROM c WINDOW p AS (PARTITION BY dt)""")
def neutralize_cap(spark, d):
    return pp.neutralize_cap(cross(spark, d), "f")


BOTH = """t AS (SELECT *, f - avg(f) OVER q AS xt, lc - avg(lc) OVER q AS ct FROM (SELECT *, CASE WHEN f IS NOT NULL THEN ln(cap) END AS lc FROM {}) WINDOW q AS (PARTITION BY dt, industry)),
  u AS (SELECT *, xt - CASE WHEN sum(ct * ct) OVER p > 1e-12 THEN sum(xt * ct) OVER p / sum(ct * ct) OVER p ELSE 0 END * ct AS res FROM t WINDOW p AS (PARTITION BY dt))"""


@query("code dt", "f", f"WITH {CROSS}, {BOTH.format('x')} --- SELECT code, dt, res AS f FROM u")
def neutralize_industry_cap(spark, d):
    return pp.neutralize_industry_cap(cross(spark, d), "f")


@query("code dt", "residual", f"WITH {CROSS}, {two_controls('x', 'f', 'g', 'ln(cap)', 7)} --- SELECT * FROM rz")
def residual_controls(spark, d):
    return pp.residual(cross(spark, d).withColumn("lc", F.ln("cap")), "f", ["g", "lc"])


@query("code dt", "f", f"""WITH {CROSS}, fl AS (SELECT code, dt, industry, cap, coalesce(f, median(f) OVER (PARTITION BY dt)) AS f FROM x), m AS (SELECT *, median(f) OVER (PARTITION BY dt) AS med FROM fl),
  n AS (SELECT *, 1.4826 * median(abs(f - med)) OVER (PARTITION BY dt) AS mad FROM m), w AS (SELECT code, dt, industry, cap, CASE WHEN f IS NULL THEN NULL WHEN mad > 0 THEN least(greatest(f, med - 3 * mad), med + 3 * mad)
  ELSE least(greatest(f, quantile_cont(f, 0.01) OVER (PARTITION BY dt)), quantile_cont(f, 0.99) OVER (PARTITION BY dt)) END AS f FROM n), {BOTH.format('w')} ---
  SELECT code, dt, -CASE WHEN stddev_samp(res) OVER p > 0 THEN (res - avg(res) OVER p) / stddev_samp(res) OVER p ELSE res - avg(res) OVER p END AS f FROM u WINDOW p AS (PARTITION BY dt)""")
def preprocess_chain(spark, d):
    return pp.preprocess(cross(spark, d), "f", -1)


@query("dt", "f_coverage g_coverage", f"WITH {CROSS} --- SELECT dt, avg(CASE WHEN f IS NULL THEN 0.0 ELSE 1.0 END) AS f_coverage, avg(CASE WHEN g IS NULL THEN 0.0 ELSE 1.0 END) AS g_coverage FROM x GROUP BY dt")
def factor_coverage(spark, d):
    return pp.coverage(cross(spark, d), ["f", "g"])
