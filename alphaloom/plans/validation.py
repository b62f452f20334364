"""Registered queries: walk-forward retraining, overfitting probability, constrained neutralisation, market regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.functions.columns import series
from alphaloom.operators import market_state as ms
from alphaloom.operators import overfitting as of
from alphaloom.operators import preprocess as pp
from alphaloom.operators import rank_boost as rb
from alphaloom.operators import walkforward as wf
from alphaloom.sources.tables import INDEX, cents, index_series, table

from .registry import query
from .research import CORR, LABELS, labelled

TRAIN, TEST, GAP, EVERY = 24, 6, 1, 3
FITS = f"""{LABELS}, kn AS (SELECT code, dt, f AS x1, g AS x2, fwd_1 AS y FROM y WHERE f IS NOT NULL AND g IS NOT NULL AND fwd_1 IS NOT NULL), da AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT dt FROM y)),
  wi AS (SELECT w AS window_id, w * {EVERY} AS k FROM (SELECT unnest(range(0, 1000)) AS w) WHERE w * {EVERY} + {TRAIN + GAP} < (SELECT max(n) FROM da)),
  wr AS (SELECT window_id, k, a.dt AS train_start, b.dt AS train_end, c.dt AS test_start, e.dt AS test_end FROM wi JOIN da a ON a.i = k JOIN da b ON b.i = k + {TRAIN - 1} JOIN da c ON c.i = k + {TRAIN + GAP} JOIN da e ON e.i = least(k + {TRAIN + GAP + TEST - 1}, e.n - 1)),
  mo AS (SELECT window_id, train_start, train_end, test_start, test_end, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * 1.1 AS a, covar_pop(x1, x2) AS b, var_pop(x2) * 1.1 AS d, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q FROM wr JOIN kn ON kn.dt BETWEEN train_start AND train_end GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 20),
  be AS (SELECT *, (p * d - q * b) / (a * d - b * b) AS b1, (q * a - p * b) / (a * d - b * b) AS b2 FROM mo), ft AS (SELECT *, my - b1 * m1 - b2 * m2 AS intercept FROM be)"""


def fitted(spark, d):
    df = labelled(spark, d)
    return df, wf.fit_windows(df, wf.windows(df, TRAIN, TEST, GAP, EVERY), ["f", "g"], "fwd_1")


@query("window_id train_start train_end test_start test_end n", "intercept b1 b2", f"WITH {FITS} --- SELECT * FROM ft")
def walk_forward_fits(spark, d):
    return fitted(spark, d)[1].withColumns({"b1": F.col("coef")[0], "b2": F.col("coef")[1]})


JUDGED = f"""{FITS}, pd AS (SELECT window_id, kn.dt, intercept + b1 * x1 + b2 * x2 AS pr, kn.y FROM ft JOIN kn ON kn.dt BETWEEN test_start AND test_end), rk AS (SELECT *, rank() OVER (PARTITION BY window_id, dt ORDER BY pr) + (count(*) OVER (PARTITION BY window_id, dt, pr) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY window_id, dt ORDER BY y) + (count(*) OVER (PARTITION BY window_id, dt, y) - 1) / 2.0 AS rb FROM pd),
  dy AS (SELECT window_id, dt, {CORR.format('pr', 'y')} AS ic, {CORR.format('ra', 'rb')} AS ric, sum((pr - y) ** 2) AS sse, count(*) AS c FROM rk GROUP BY 1, 2)"""


@query("window_id n test_dates", "ic icir rank_ic rmse", f"WITH {JUDGED}, j AS (SELECT window_id, count(ic) AS test_dates, avg(ic) AS ic, CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) END AS icir, avg(ric) AS rank_ic, sqrt(sum(sse) / sum(c)) AS rmse FROM dy GROUP BY 1) --- SELECT window_id, n, coalesce(test_dates, 0) AS test_dates, ic, icir, rank_ic, rmse FROM ft LEFT JOIN j USING (window_id)", 5)
def walk_forward_retrained(spark, d):
    df, fits = fitted(spark, d)
    return wf.judge_windows(wf.predict_windows(df, fits, ["f", "g"]), fits, "fwd_1")


@query("window_id dates", "total excess sharpe max_drawdown hit_rate", f"""WITH {JUDGED}, wb AS (SELECT window_id, dt, avg(y) FILTER (p <= 10) AS r, avg(y) AS m FROM (SELECT ft.window_id, kn.dt, kn.y, row_number() OVER (PARTITION BY ft.window_id, kn.dt ORDER BY intercept + b1 * x1 + b2 * x2 DESC, code) AS p FROM ft JOIN kn ON kn.dt BETWEEN test_start AND test_end) GROUP BY 1, 2),
  wn AS (SELECT *, exp(sum(ln(1 + r)) OVER o) AS nav, exp(sum(ln(1 + m)) OVER o) AS mn FROM wb WINDOW o AS (PARTITION BY window_id ORDER BY dt)), wd AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY window_id ORDER BY dt), 1) - 1 AS dd FROM wn) ---
  SELECT window_id, count(*) AS dates, arg_max(nav, dt) - 1 AS total, arg_max(nav, dt) - arg_max(mn, dt) AS excess, avg(r) / nullif(stddev_samp(r), 0) * sqrt(12) AS sharpe, min(dd) AS max_drawdown, avg(CASE WHEN r > m THEN 1.0 ELSE 0.0 END) AS hit_rate FROM wd GROUP BY 1""", 5)
def walk_forward_backtest(spark, d):
    df, fits = fitted(spark, d)
    return wf.backtest_windows(wf.predict_windows(df, fits, ["f", "g"]), "fwd_1")


LOOKBACKS, BLOCKS = range(1, 9), 8
_LAGS = ", ".join(f"close / nullif(lag(close, {n}) OVER s, 0) - 1" for n in LOOKBACKS)
TRIALS = f"""{LABELS}, tm AS (SELECT dt, fwd_1, unnest({list(LOOKBACKS)}) AS strategy, unnest([{_LAGS}]) AS x FROM y WINDOW s AS (PARTITION BY code ORDER BY dt)), th AS (SELECT *, median(x) OVER (PARTITION BY strategy, dt) AS m FROM tm WHERE x IS NOT NULL),
  re AS (SELECT strategy, dt, avg(fwd_1) AS ret FROM th WHERE x >= m AND fwd_1 IS NOT NULL GROUP BY 1, 2)"""
SPLITS = f"""{TRIALS}, db AS (SELECT dt, ntile({BLOCKS}) OVER (ORDER BY dt) - 1 AS block FROM (SELECT DISTINCT dt FROM re)), sp AS (SELECT m AS split FROM (SELECT unnest(range(0, {1 << BLOCKS})) AS m) WHERE bit_count(m::INTEGER) = {BLOCKS // 2}),
  sh AS (SELECT split, strategy, avg(ret) FILTER (i) / nullif(stddev_samp(ret) FILTER (i), 0) AS inside, avg(ret) FILTER (NOT i) / nullif(stddev_samp(ret) FILTER (NOT i), 0) AS outside FROM (SELECT *, (split >> block) & 1 = 1 AS i FROM re JOIN db USING (dt), sp) GROUP BY 1, 2),
  ra AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY outside) + (count(*) OVER (PARTITION BY split, outside) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY split) AS c, row_number() OVER (PARTITION BY split ORDER BY inside DESC, strategy) AS b FROM sh), bs AS (SELECT split, strategy, inside, outside, r / (c + 1) AS omega, ln(r / (c + 1) / (1 - r / (c + 1))) AS logit FROM ra WHERE b = 1)"""


def trials(spark, d):
    """Monthly returns of the better half by momentum over each lookback."""
    df = labelled(spark, d)
    df = df.withColumns({str(n): F.col("close") / F.nullif(F.lag("close", n).over(series()), F.lit(0.0)) - 1 for n in LOOKBACKS})
    tall = df.select("dt", "fwd_1", *map(str, LOOKBACKS)).unpivot(["dt", "fwd_1"], list(map(str, LOOKBACKS)), "strategy", "x").filter("x is not null").withColumn("strategy", F.col("strategy").cast("int"))
    middle = tall.groupBy("strategy", "dt").agg(F.median("x").alias("m"))
    held = tall.join(middle, ["strategy", "dt"]).filter("x >= m and fwd_1 is not null")
    return held.groupBy("strategy", "dt").agg(F.avg("fwd_1").alias("ret"))


@query("split strategy", "inside outside omega logit", f"WITH {SPLITS} --- SELECT * FROM bs")
def overfitting_splits(spark, d):
    return of.best_of_splits(of.split_sharpes(of.block_moments(trials(spark, d), BLOCKS), BLOCKS))


@query("splits", "pbo loss slope intercept mean_logit", f"WITH {SPLITS} --- SELECT count(*) AS splits, avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END) AS pbo, avg(CASE WHEN outside < 0 THEN 1.0 ELSE 0.0 END) AS loss, covar_samp(inside, outside) / var_samp(inside) AS slope, avg(outside) - covar_samp(inside, outside) / var_samp(inside) * avg(inside) AS intercept, avg(logit) AS mean_logit FROM bs", 5)
def overfitting_probability(spark, d):
    return of.overfitting(trials(spark, d), BLOCKS)


@query("code dt", "f market effect", f"""WITH {LABELS}, gi AS (SELECT dt, industry, sum(sqrt(cap) * f) / sum(sqrt(cap)) AS m, sum(cap) AS s FROM y WHERE f IS NOT NULL GROUP BY 1, 2), gm AS (SELECT dt, sum(m * s) / sum(s) AS market FROM gi GROUP BY 1) ---
  SELECT code, dt, f - m AS f, market, CASE WHEN f IS NOT NULL THEN m - market END AS effect FROM y LEFT JOIN gm USING (dt) LEFT JOIN gi USING (dt, industry)""")
def neutralize_constrained_cap(spark, d):
    return pp.neutralize_constrained(labelled(spark, d).withColumn("root", F.sqrt("cap")), "f", weight="root", shares="cap")


@query("code dt", "f market effect", f"""WITH {LABELS}, gi AS (SELECT dt, industry, avg(f) AS m FROM y WHERE f IS NOT NULL GROUP BY 1, 2), gm AS (SELECT dt, avg(m) AS market FROM gi GROUP BY 1) ---
  SELECT code, dt, f - m AS f, market, CASE WHEN f IS NOT NULL THEN m - market END AS effect FROM y LEFT JOIN gm USING (dt) LEFT JOIN gi USING (dt, industry)""")
def neutralize_constrained_equal(spark, d):
    return pp.neutralize_constrained(labelled(spark, d), "f")


_M = "CASE WHEN count(close) OVER (ORDER BY dt ROWS {0} PRECEDING) > {0} THEN avg(close) OVER (ORDER BY dt ROWS {0} PRECEDING) END"
_S = "CASE WHEN count(r) OVER (ORDER BY dt ROWS {0} PRECEDING) > {0} THEN stddev_samp(r) OVER (ORDER BY dt ROWS {0} PRECEDING) END"
REGIME = f"""RECURSIVE {INDEX}, ir AS (SELECT dt, close, close / nullif(lag(close) OVER (ORDER BY dt), 0) - 1 AS r, row_number() OVER (ORDER BY dt) AS i FROM idx),
  cb AS (SELECT o_custkey % 60 AS code, CAST(o_orderdate AS DATE) AS dt, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS close FROM orders GROUP BY 1, 2), br AS (SELECT dt, avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END) AS breadth FROM (SELECT dt, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY dt), 0) - 1 AS c FROM cb) WHERE c IS NOT NULL GROUP BY 1),
  f0 AS (SELECT i, dt, close, {_M.format(19)} AS a, {_M.format(59)} AS b, {_S.format(9)} AS s, {_S.format(19)} AS m, {_S.format(59)} AS l FROM ir),
  f1 AS (SELECT i, dt, coalesce((close - a) / close, 0) AS t20, coalesce((close - b) / close, 0) AS t60, coalesce((a - b) / b, 0) AS x, coalesce(m * sqrt(252), 0.2) AS v, coalesce(CASE WHEN coalesce(l, m) > 0 THEN s / coalesce(l, m) WHEN coalesce(l, m) IS NOT NULL THEN 1 END, 1) AS q, coalesce(breadth, 0.5) AS w FROM f0 LEFT JOIN br USING (dt)),
  st AS (SELECT CAST(0 AS BIGINT) AS i, 0 AS s UNION ALL SELECT f1.i, CASE st.s WHEN -1 THEN CASE WHEN v < 0.25 AND q < 1.3 THEN 0 ELSE -1 END WHEN 1 THEN CASE WHEN v > 0.20 OR q > 0.9 THEN 0 ELSE 1 END ELSE CASE WHEN v > 0.30 OR q > 1.5 THEN -1 WHEN v < 0.15 AND q < 0.7 THEN 1 ELSE 0 END END FROM st JOIN f1 ON f1.i = st.i + 1),
  sc AS (SELECT f1.*, CASE WHEN abs(t20) > 0.03 AND abs(t60) > 0.05 THEN sign(t20) * least(abs(t20) * 10, 1.0) WHEN abs(x) > 0.02 THEN sign(x) * least(abs(x) * 5, 0.5) ELSE 0 END AS trend_score, CAST(s AS DOUBLE) AS vol_score, CASE WHEN w > 0.6 THEN 1.0 WHEN w < 0.4 THEN -1.0 ELSE 0.0 END AS breadth_score FROM f1 JOIN st USING (i)), c AS (SELECT *, trend_score + vol_score + breadth_score AS composite FROM sc)"""


@query("dt regime", "trend_score vol_score breadth_score composite confidence", f"""WITH {REGIME} --- SELECT dt, CASE WHEN i = 1 THEN 'mean_reverting' WHEN composite >= 1.5 AND trend_score > 0 THEN 'risk_on' WHEN composite >= 0.5 AND abs(trend_score) > 0.3 THEN 'trending' WHEN composite <= -1 THEN 'defensive' ELSE 'mean_reverting' END AS regime,
  trend_score, vol_score, breadth_score, composite, CASE WHEN i = 1 THEN 0.3 ELSE least((abs(t20) * 10 + abs(q - 1) * 2 + abs(w - 0.5) * 2) / 3, 1.0) END AS confidence FROM c""")
def market_regime(spark, d):
    daily = table(spark, d, "orders").groupBy((F.col("o_custkey") % 60).alias("code"), F.to_date("o_orderdate").alias("dt")).agg(cents("o_totalprice").alias("close"))
    return ms.detect(index_series(spark, d), ms.breadth(daily))


@query("dt n", "ndcg", f"""WITH {LABELS}, re AS (SELECT code, dt, f, floor((rank() OVER (PARTITION BY dt ORDER BY fwd_1) - 1) * 5 / count(*) OVER (PARTITION BY dt)) AS rel FROM y WHERE fwd_1 IS NOT NULL), pl AS (SELECT dt, rel, row_number() OVER (PARTITION BY dt ORDER BY f DESC, code) AS p, row_number() OVER (PARTITION BY dt ORDER BY rel DESC, code) AS b FROM re WHERE f IS NOT NULL) ---
  SELECT dt, count(*) AS n, sum(CASE WHEN p <= 10 THEN (2 ** rel - 1) / log2(p + 1) ELSE 0 END) / nullif(sum(CASE WHEN b <= 10 THEN (2 ** rel - 1) / log2(b + 1) ELSE 0 END), 0) AS ndcg FROM pl GROUP BY dt""")
def rank_ndcg(spark, d):
    return rb.ndcg(rb.relevance(labelled(spark, d), "fwd_1"), "f")


@query("code dt", "ranked")
def rank_predictions(spark, d):
    df = labelled(spark, d)
    model = rb.fit(df.filter("dt < date'1999-01-01'"), ["f", "g", "turnover"], "fwd_1", {"turnover": -1}, trees=4, depth=3)
    return rb.predict(model, df)
