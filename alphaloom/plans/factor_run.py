"""Registered queries: the whole factor run, from tables to a portfolio."""

from __future__ import annotations


from alphaloom.operators import factor_set as fs
from alphaloom.operators.flows import to_long
from alphaloom.operators.weighting import factor_ics
from alphaloom.sources.statements import STATEMENTS, flows, statements
from alphaloom.sources.store import scratch, written
from alphaloom.sources.tables import DIMS, PANEL, dims, panel
from alphaloom.sources.versions import VersionedStore

from . import factors, fundamental  # noqa: F401  their queries' SQL is part of this run's
from .registry import QUERIES, query
from .research import CORR


def _sub(name: str, columns: str) -> str:
    """A registered query's own SQL as a table of its keys and some columns."""
    with_part, _, body = QUERIES[name].sql.rpartition("---")
    return f"({with_part} SELECT {', '.join(QUERIES[name].keys)}, {columns} FROM ({body}) AS q)"


_PRICE = {"momentum_reversal": "ret_reversal, ret_3_skip, ret_6_skip, ret_12_skip", "price_volatility": "vol", "price_beta": "beta, idio_vol", "price_high_low": "hl_ratio", "price_liquidity": "turnover_mean, amihud, zero_ratio", "price_bollinger": "bollinger", "price_obv": "obv_ratio"}
_KNOWN = {"fundamental_quality": "roe, roa, gross_margin", "fundamental_earnings_quality": "sloan_accrual", "fundamental_trailing": "revenue_yoy, net_profit_yoy"}
_WIDE = f"""{PANEL}, {DIMS}, {STATEMENTS}, pf AS (SELECT * FROM (SELECT code, dt FROM panel) """ + " ".join(f"JOIN {_sub(n, c)} USING (code, dt)" for n, c in _PRICE.items()) + f""" JOIN {_sub('fundamental_valuation', 'ep_ttm, bp, sp_ttm, cfp_ttm')} USING (code, dt)),
  ff AS (SELECT * FROM (SELECT code, end_date, ann_date FROM st) """ + " ".join(f"JOIN {_sub(n, c)} USING (code, end_date)" for n, c in _KNOWN.items()) + f"""), kf AS (SELECT * FROM (SELECT panel.dt, ff.*, row_number() OVER (PARTITION BY panel.code, panel.dt ORDER BY end_date DESC) AS rn FROM panel JOIN ff ON panel.code = ff.code AND ff.ann_date <= panel.dt) WHERE rn = 1),
  af AS (SELECT * FROM pf LEFT JOIN (SELECT * EXCLUDE (rn, end_date, ann_date) FROM kf) USING (code, dt) FULL JOIN {_sub('flow_factors', 'large_ratio, net_buy_ratio, smart_money')} USING (code, dt))"""
_NAMES, _SIGNS = ", ".join(f"'{f}'" for f in fs.FACTORS), ", ".join(str(float(s)) for _, s in fs.FACTORS.values())
_CLIP = "CASE WHEN mad > 0 THEN least(greatest(x, med - 3 * mad), med + 3 * mad) ELSE least(greatest(x, q1), q2) END"
RUN = f"""{_WIDE}, t0 AS (SELECT af.code, dt, industry, cap, unnest([{_NAMES}]) AS factor, unnest([{_SIGNS}]) AS sgn, unnest([{', '.join(fs.FACTORS)}]) AS x FROM af JOIN dims ON dims.code = af.code),
  tc AS (SELECT * FROM (SELECT *, avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY dt, factor) AS c FROM t0) WHERE c >= 0.5), t1 AS (SELECT * REPLACE (coalesce(x, median(x) OVER d) AS x) FROM tc WINDOW d AS (PARTITION BY dt, factor)),
  t2 AS (SELECT *, median(x) OVER d AS med, quantile_cont(x, 0.01) OVER d AS q1, quantile_cont(x, 0.99) OVER d AS q2 FROM t1 WINDOW d AS (PARTITION BY dt, factor)), t3 AS (SELECT *, 1.4826 * median(abs(x - med)) OVER (PARTITION BY dt, factor) AS mad FROM t2), t4 AS (SELECT code, dt, industry, cap, factor, sgn, {_CLIP} AS x FROM t3),
  ts AS (SELECT *, coalesce(stddev_samp(x) OVER (PARTITION BY dt, factor), 0) AS sd FROM t4), t5 AS (SELECT *, x - avg(x) OVER i AS xt, CASE WHEN x IS NOT NULL THEN ln(cap) END - avg(CASE WHEN x IS NOT NULL THEN ln(cap) END) OVER i AS ct FROM ts WINDOW i AS (PARTITION BY dt, factor, industry)), t6 AS (SELECT code, dt, factor, sgn, sd, xt - CASE WHEN sum(ct * ct) OVER d > 1e-12 THEN sum(xt * ct) OVER d / sum(ct * ct) OVER d ELSE 0 END * ct AS x FROM t5 WINDOW d AS (PARTITION BY dt, factor)),
  tz AS (SELECT * REPLACE (CASE WHEN abs(x) > 1e-9 * sd THEN x WHEN x IS NOT NULL THEN 0 END AS x) FROM t6), t7 AS (SELECT code, dt, factor, sgn * CASE WHEN stddev_samp(x) OVER d > 0 THEN (x - avg(x) OVER d) / stddev_samp(x) OVER d ELSE x - avg(x) OVER d END AS value FROM tz WINDOW d AS (PARTITION BY dt, factor)), vl AS (SELECT * FROM t7 WHERE value IS NOT NULL)"""


def run(spark, d):
    """The securities and the processed values of all groups, a row a key with the label beside them."""
    p, s = written(panel(spark, d), "factor-panel"), dims(spark, d)
    return s, fs.processed(fs.all_factors(p, statements(spark, d), flows(spark, d), s, label=True), s)


@query("code dt", " ".join(fs.FACTORS), f"WITH {_WIDE} --- SELECT * FROM af", 4)
def factors_wide(spark, d):
    return fs.all_factors(panel(spark, d), statements(spark, d), flows(spark, d), dims(spark, d))


def stored_values(spark, d):
    """Processed values in a versioned store, read again: what follows neither computes them twice nor loses them with an executor."""
    s, values = run(spark, d)
    store = VersionedStore(spark, scratch(spark, "factor-values"), ["code", "dt"])
    store.append(values, "run", dealt=True)
    return s, store


@query("code dt factor", "value", f"WITH {RUN} --- SELECT code, dt, factor, value FROM vl WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", 3)
def factors_all(spark, d):
    return to_long(stored_values(spark, d)[1].read(start="1996-01-01", end="1997-12-31"), list(fs.FACTORS))


ICS = f"""{RUN}, lb AS (SELECT code, dt, CASE WHEN close <> 0 THEN lead(close) OVER (PARTITION BY code ORDER BY dt) / close - 1 END AS label FROM panel), fi AS (SELECT factor, dt, count(*) AS n, {CORR.format('value', 'label')} AS ic FROM vl JOIN lb USING (code, dt) WHERE label IS NOT NULL GROUP BY 1, 2 HAVING {CORR.format('value', 'label')} IS NOT NULL)"""


@query("factor dt n", "ic", f"WITH {ICS} --- SELECT * FROM fi", 4)
def factor_run_ics(spark, d):
    return factor_ics(stored_values(spark, d)[1].read(), list(fs.FACTORS), "label")


SCORED = f"""{ICS}, rm AS (SELECT *, count(ic) OVER w AS c, avg(ic) OVER w AS m FROM fi WINDOW w AS (PARTITION BY factor ORDER BY dt ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), rw AS (SELECT dt, factor, CASE WHEN sum(abs(m)) OVER d > 0 THEN m / sum(abs(m)) OVER d ELSE 1.0 / count(*) OVER d END AS weight FROM rm WHERE c >= 3 WINDOW d AS (PARTITION BY dt)),
  sc AS (SELECT code, dt, coalesce(sum(value * weight) / nullif(sum(abs(weight)), 0), avg(value)) AS score FROM vl LEFT JOIN rw USING (dt, factor) GROUP BY 1, 2), rk AS (SELECT code, dt, round(score, 9) AS score, row_number() OVER (PARTITION BY dt ORDER BY round(score, 9) DESC NULLS LAST, code) AS rank FROM sc)"""
HELD = f"""{SCORED}, h0 AS (SELECT rk.*, industry FROM rk JOIN dims USING (code) WHERE rank <= 10 AND score IS NOT NULL), h1 AS (SELECT *, greatest(score - min(score) OVER (PARTITION BY dt), 0) + 1e-6 AS w FROM h0), h2 AS (SELECT * REPLACE (least(w / sum(w) OVER (PARTITION BY dt), 0.2) AS w) FROM h1), h3 AS (SELECT * REPLACE (w / sum(w) OVER (PARTITION BY dt) AS w) FROM h2),
  h4 AS (SELECT *, sum(w) OVER (PARTITION BY dt, industry) AS i FROM h3), h5 AS (SELECT * REPLACE (CASE WHEN i > 0.4 THEN w * 0.4 / i ELSE w END AS w) FROM h4)"""


def scored(spark, d):
    s, store = stored_values(spark, d)
    values = store.read()
    return s, fs.scores(values, factor_ics(values, list(fs.FACTORS), "label"))


@query("code dt", "score", f"WITH {SCORED} --- SELECT code, dt, score FROM sc", 4)
def factor_run_scores(spark, d):
    return scored(spark, d)[1]


@query("code dt rank", "score weight", f"WITH {HELD} --- SELECT code, dt, rank, score, w / sum(w) OVER (PARTITION BY dt) AS weight FROM h5", 4)
def run_multi_factor(spark, d):
    s, out = scored(spark, d)
    return fs.target_portfolio(out, s)
