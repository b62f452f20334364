"""Registered queries: fundamental, flow and industry factors, factor stores, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators import flows as fl
from alphaloom.operators import fundamentals as fu
from alphaloom.operators import market_data as md
from alphaloom.operators import pit, price
from alphaloom.sources.statements import FLOWS, HOLDERS, STATEMENTS, flows, holders, statements
from alphaloom.sources.tables import DIMS, PANEL, dims, panel, table

from .registry import query
from .research import LABELS, labelled

E8 = "CASE WHEN abs({1}) >= 1e-8 THEN ({0}) / ({1}) END"
TTM = f"""{STATEMENTS}, tt AS (SELECT *, {', '.join(f'CASE WHEN count({c}) OVER f >= 4 THEN sum({c}) OVER f END AS {c}_ttm, CASE WHEN abs(lag({c}, 4) OVER p) >= 1e-8 THEN ({c} - lag({c}, 4) OVER p) / abs(lag({c}, 4) OVER p) END AS {c}_yoy' for c in ('revenue', 'net_profit', 'cfo'))},
  lag(equity) OVER p AS equity_prev, lag(assets) OVER p AS assets_prev FROM st WINDOW p AS (PARTITION BY code ORDER BY end_date), f AS (PARTITION BY code ORDER BY end_date ROWS 3 PRECEDING))"""


def trailing(spark, d):
    return fu.trailing(statements(spark, d), ["revenue", "net_profit", "cfo"], ["equity", "assets"])


@query("code end_date", "revenue_ttm net_profit_ttm cfo_ttm revenue_yoy net_profit_yoy cfo_yoy equity_prev assets_prev", f"WITH {TTM} --- SELECT * FROM tt", 4)
def fundamental_trailing(spark, d):
    return trailing(spark, d)


@query("code end_date", "roe roa gross_margin net_margin current_ratio goodwill_ratio", f"""WITH {TTM} --- SELECT code, end_date, {E8.format('net_profit', '(equity + coalesce(equity_prev, equity * 0.9)) / 2')} AS roe,
  {E8.format('net_profit', '(assets + coalesce(assets_prev, assets)) / 2')} AS roa, {E8.format('gross_profit', 'revenue')} AS gross_margin, {E8.format('net_profit', 'revenue')} AS net_margin,
  {E8.format('current_assets', 'current_liabilities')} AS current_ratio, {E8.format('goodwill', 'equity')} AS goodwill_ratio FROM tt""")
def fundamental_quality(spark, d):
    return fu.quality(trailing(spark, d))


@query("code end_date", "sloan_accrual cash_gap cfo_to_profit stability", f"""WITH {TTM} --- SELECT code, end_date, {E8.format('net_profit - cfo', '(assets + coalesce(assets_prev, assets)) / 2')} AS sloan_accrual,
  CASE WHEN abs(net_profit) >= 1e-8 THEN abs(cfo - net_profit) / abs(net_profit) END AS cash_gap, CASE WHEN abs(net_profit) >= 1e-8 THEN least(greatest(cfo / net_profit, -5.0), 5.0) END AS cfo_to_profit,
  CASE WHEN count(net_profit) OVER e >= 4 THEN 1 / (1 + least(10.0, stddev_samp(net_profit) OVER e / abs(avg(net_profit) OVER e))) END AS stability FROM tt WINDOW e AS (PARTITION BY code ORDER BY end_date ROWS 7 PRECEDING)""")
def fundamental_earnings_quality(spark, d):
    return fu.earnings_quality(trailing(spark, d))


@query("code dt", "ep_ttm bp sp_ttm cfp_ttm", f"""WITH {PANEL}, {DIMS}, {TTM}, b AS (SELECT * FROM (SELECT p.code, p.dt, net_profit_ttm, equity, revenue_ttm, cfo_ttm, row_number() OVER (PARTITION BY p.code, p.dt ORDER BY end_date DESC) AS rn FROM panel p JOIN tt ON p.code = tt.code AND tt.ann_date <= p.dt) WHERE rn = 1) ---
  SELECT p.code, p.dt, net_profit_ttm / cap AS ep_ttm, equity / cap AS bp, revenue_ttm / cap AS sp_ttm, cfo_ttm / cap AS cfp_ttm FROM panel p JOIN dims USING (code) LEFT JOIN b ON p.code = b.code AND p.dt = b.dt""", 5)
def fundamental_valuation(spark, d):
    facts = trailing(spark, d).select("code", "ann_date", "end_date", F.struct("net_profit_ttm", "equity", "revenue_ttm", "cfo_ttm").alias("facts"))
    known = pit.as_of(panel(spark, d), facts, "facts", rank=()).select("code", "dt", "facts.*").join(dims(spark, d), "code")
    return fu.valuation(known)


@query("code end_date", "surprise sue revision", f"""WITH {STATEMENTS}, x AS (SELECT *, lag(net_profit) OVER p AS ex FROM st WINDOW p AS (PARTITION BY code ORDER BY end_date)), g AS (SELECT *, net_profit - ex AS gap, lag(ex) OVER (PARTITION BY code ORDER BY end_date) AS bx FROM x),
  v AS (SELECT *, CASE WHEN count(gap) OVER e >= 4 THEN stddev_samp(gap) OVER e END AS sd FROM g WINDOW e AS (PARTITION BY code ORDER BY end_date ROWS 7 PRECEDING)) ---
  SELECT code, end_date, CASE WHEN abs(ex) >= 1e-8 THEN gap / abs(ex) END AS surprise, {E8.format('gap', 'sd')} AS sue, CASE WHEN abs(bx) >= 1e-8 THEN (ex - bx) / abs(bx) END AS revision FROM v""", 5)
def fundamental_analyst(spark, d):
    return fu.analyst(statements(spark, d).withColumn("expected", F.lag("net_profit").over(fu.periods())), "net_profit", "expected")


@query("code end_date", "top_share", f"""WITH {HOLDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY code, end_date ORDER BY amount DESC, holder) AS rn FROM ho), p AS (SELECT code, end_date, sum(amount) FILTER (rn <= 10) / sum(amount) AS top_share FROM r GROUP BY 1, 2) ---
  SELECT code, max(end_date) AS end_date, arg_max(top_share, end_date) AS top_share FROM p GROUP BY code""")
def risk_concentration(spark, d):
    return fu.concentration(holders(spark, d))


OF = f"""{FLOWS}, o1 AS (SELECT *, {E8.format('large + super_large', 'volume')} AS large_ratio, {E8.format('inflow', 'volume')} AS net_buy_ratio, lag(holding, 5) OVER p AS h5, lag(margin, 5) OVER p AS m5 FROM fl WINDOW p AS (PARTITION BY code ORDER BY dt)),
  o2 AS (SELECT *, CASE WHEN count(large_ratio) OVER w >= 5 THEN avg(large_ratio) OVER w END AS smart_money, CASE WHEN h5 <> 0 THEN holding / h5 - 1 END AS holding_chg, CASE WHEN m5 <> 0 THEN margin / m5 - 1 END AS margin_chg,
  CASE WHEN count(net_buy_ratio) OVER w >= 5 THEN avg(net_buy_ratio) OVER w END AS sentiment FROM o1 WINDOW w AS (PARTITION BY code ORDER BY dt ROWS 19 PRECEDING))"""


@query("code dt", "large_ratio net_buy_ratio smart_money holding_chg margin_chg sentiment", f"WITH {OF} --- SELECT * FROM o2")
def flow_factors(spark, d):
    return fl.order_flow(flows(spark, d))


TS = "lpad(CAST(code AS VARCHAR), 6, '300') || CASE code % 3 WHEN 0 THEN '.SZ' WHEN 1 THEN '.SH' ELSE '.BJ' END"
LIM = "CASE WHEN is_st THEN 5.0 WHEN ts_code LIKE '%.BJ' THEN 30.0 WHEN ts_code LIKE '688%.SH' THEN 20.0 WHEN ts_code LIKE '3%.SZ' THEN 20.0 ELSE 10.0 END - 0.1"


@query("code dt", "limit_up limit_down up_ratio down_ratio ipo_age", f"""WITH {PANEL}, {DIMS}, r AS (SELECT p.code, p.dt, {TS.replace('code', 'p.code')} AS ts_code, is_st, CASE WHEN lag(close) OVER s <> 0 THEN (close / lag(close) OVER s - 1) * 100 END AS pct FROM panel p JOIN dims USING (code) WINDOW s AS (PARTITION BY p.code ORDER BY p.dt)),
  l AS (SELECT *, CASE WHEN pct IS NOT NULL THEN CASE WHEN pct >= {LIM} THEN 1.0 ELSE 0.0 END END AS limit_up, CASE WHEN pct IS NOT NULL THEN CASE WHEN pct <= -({LIM}) THEN 1.0 ELSE 0.0 END END AS limit_down FROM r) ---
  SELECT code, dt, limit_up, limit_down, CASE WHEN count(limit_up) OVER w >= 10 THEN avg(limit_up) OVER w END AS up_ratio, CASE WHEN count(limit_down) OVER w >= 10 THEN avg(limit_down) OVER w END AS down_ratio,
  greatest(0.0, date_diff('day', DATE '1993-06-01', dt) / 365.25) AS ipo_age FROM l WINDOW w AS (PARTITION BY code ORDER BY dt ROWS 19 PRECEDING)""")
def flow_limit_ratios(spark, d):
    df = price.returns(panel(spark, d)).join(dims(spark, d), "code")
    exchange = F.when(F.col("code") % 3 == 0, ".SZ").when(F.col("code") % 3 == 1, ".SH").otherwise(".BJ")
    df = df.withColumns({"pct": F.col("ret") * 100, "ts_code": F.concat(F.lpad(F.col("code").cast("string"), 6, "300"), exchange), "list_date": F.to_date(F.lit("1993-06-01"))})
    return fl.limit_ratios(df)


@query("industry dt", "momentum flow deviation", f"""WITH {LABELS}, {FLOWS}, i AS (SELECT y.industry, y.dt, avg(g) AS r, sum(inflow) AS flow, avg(turnover) AS v FROM y JOIN fl ON y.code = fl.code AND y.dt = fl.dt GROUP BY 1, 2),
  m AS (SELECT *, CASE WHEN count(r) OVER a >= 3 THEN avg(r) OVER a END AS momentum, CASE WHEN count(v) OVER b >= 12 THEN avg(v) OVER b END AS mv FROM i WINDOW a AS (PARTITION BY industry ORDER BY dt ROWS 2 PRECEDING), b AS (PARTITION BY industry ORDER BY dt ROWS 11 PRECEDING)) ---
  SELECT industry, dt, momentum, flow, CASE WHEN abs(mv) >= 1e-8 THEN (v - mv) / mv END AS deviation FROM m""")
def flow_industry_rotation(spark, d):
    df = labelled(spark, d).join(flows(spark, d).select("code", "dt", F.col("inflow").alias("flow")), ["code", "dt"])
    return fl.industry_rotation(df)


MERGED = f"{OF}, {PANEL}, a AS (SELECT code, dt, close / lag(close) OVER (PARTITION BY code ORDER BY dt) - 1 AS rev FROM panel)"


@query("code dt", "rev large_ratio", f"WITH {MERGED} --- SELECT code, dt, rev, large_ratio FROM a FULL JOIN (SELECT code, dt, large_ratio FROM o2 WHERE volume > 40) b USING (code, dt)")
def factor_merge(spark, d):
    a = price.momentum(panel(spark, d)).select("code", "dt", F.col("ret_reversal").alias("rev"))
    return fl.merge_factors([a, fl.order_flow(flows(spark, d)).filter("volume > 40").select("code", "dt", "large_ratio")])


@query("code dt factor", "value", f"WITH {OF} --- SELECT code, dt, 'large_ratio' AS factor, large_ratio AS value FROM o2 WHERE large_ratio IS NOT NULL UNION ALL SELECT code, dt, 'smart_money', smart_money FROM o2 WHERE smart_money IS NOT NULL")
def factor_store_long(spark, d):
    return fl.to_long(fl.order_flow(flows(spark, d)), ["large_ratio", "smart_money"])


@query("code dt", "large_ratio smart_money", f"WITH {OF} --- SELECT code, dt, large_ratio, smart_money FROM o2 WHERE large_ratio IS NOT NULL OR smart_money IS NOT NULL")
def factor_store_wide(spark, d):
    return fl.to_wide(fl.to_long(fl.order_flow(flows(spark, d)), ["large_ratio", "smart_money"]), ["large_ratio", "smart_money"])


IV = "iv AS (SELECT o_custkey % 200 AS code, CAST(o_orderdate AS DATE) AS effective, max(o_orderkey) AS cls, CASE WHEN max(o_orderkey) % 3 > 0 THEN CAST(o_orderdate AS DATE) + CAST(20 + max(o_orderkey) % 40 AS INTEGER) END AS expire FROM orders GROUP BY 1, 2)"


@query("code dt cls", "", f"WITH {PANEL}, {IV} --- SELECT code, dt, cls FROM (SELECT p.code, p.dt, iv.cls, row_number() OVER (PARTITION BY p.code, p.dt ORDER BY iv.effective DESC NULLS LAST, iv.cls DESC) AS rn FROM panel p LEFT JOIN iv ON p.code = iv.code AND iv.effective <= p.dt AND (iv.expire IS NULL OR iv.expire > p.dt)) WHERE rn = 1")
def pit_interval_lookup(spark, d):
    iv = table(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("code"), F.to_date("o_orderdate").alias("effective")).agg(F.max("o_orderkey").alias("cls"))
    iv = iv.withColumn("expire", F.when(F.col("cls") % 3 > 0, F.date_add("effective", (20 + F.col("cls") % 40).cast("int"))))
    return fl.valid_at(iv, panel(spark, d), "cls")


@query("dt n members", "", f"WITH {PANEL} --- SELECT dt, count(*) AS n, array_to_string(list_sort(list(DISTINCT code)), ',') AS members FROM panel WHERE volume > 300 GROUP BY dt")
def universe_snapshots(spark, d):
    return fl.snapshots(panel(spark, d).filter("volume > 300"))


@query("kind code dt", "value", f"""WITH {PANEL}, {STATEMENTS}, r AS (SELECT *, abs(close / lag(close) OVER (PARTITION BY code ORDER BY dt) - 1) AS m FROM panel) ---
  SELECT 'large_move' AS kind, code, dt, m AS value FROM (SELECT * FROM r WHERE m > 0.2 ORDER BY m DESC, code, dt LIMIT 50)
  UNION ALL SELECT 'unbalanced', code, end_date, abs(assets - debt - equity) / abs(assets) FROM st WHERE assets <> 0 AND abs(assets - debt - equity) / abs(assets) > 0.01
  UNION ALL SELECT 'no_volume', code, dt, volume FROM panel WHERE volume = 0 AND close > 0""")
def quality_checks(spark, d):
    return md.quality_checks(panel(spark, d), statements(spark, d).withColumn("owed", F.col("debt")))


@query("seq valid", "", """WITH l AS (SELECT o_orderkey AS seq, sha256(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus) AS h FROM orders), x AS (SELECT seq, h, lag(h) OVER (ORDER BY seq) AS p FROM l) ---
  SELECT seq, (seq % 50 <> 0 OR p IS NULL) AND seq % 70 <> 0 AS valid FROM x""")
def audit_chain(spark, d):
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("entry")).withColumn("hash", F.sha2("entry", 256))
    chained = md.chain(log)
    tampered = chained.withColumn("previous", F.when((F.col("seq") % 50 == 0), F.lit("")).otherwise(F.col("previous")))
    tampered = tampered.withColumn("entry", F.when(F.col("seq") % 70 == 0, F.concat("entry", F.lit("!"))).otherwise(F.col("entry")))
    return md.verify_chain(tampered)
