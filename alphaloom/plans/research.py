"""Registered queries: point-in-time joins, labels, factor research, data quality, universes."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators import market_data as md
from alphaloom.operators import pit, price
from alphaloom.operators import research as rs
from alphaloom.sources.tables import BARS, DIMS, FILINGS, INDEX, PANEL, bars, dims, filings, index_series, panel, table, upsert

from .registry import query

DAY = "1998-06-30"
KNOWN = f"""{FILINGS}, known AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY code, end_date ORDER BY source_priority DESC, revision_no DESC, ann_date DESC) AS rn
  FROM filings WHERE ann_date <= DATE '{DAY}') WHERE rn = 1)"""


@query("code end_date ann_date source_priority revision_no", "net_profit", f"WITH {KNOWN} --- SELECT * FROM known")
def pit_known(spark, d):
    return pit.known_at(filings(spark, d), DAY)


@query("code end_date revision_no", "net_profit", f"WITH {KNOWN} --- SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY end_date DESC) AS k FROM known) WHERE k = 1")
def pit_latest(spark, d):
    return pit.latest_at(filings(spark, d), DAY)


@query("code dt", "net_profit", f"""WITH {PANEL}, {FILINGS}, k AS (SELECT p.code, p.dt, f.net_profit, row_number() OVER (PARTITION BY p.code, p.dt ORDER BY f.end_date DESC NULLS LAST, f.source_priority DESC, f.revision_no DESC) AS rn
  FROM panel p LEFT JOIN filings f ON p.code = f.code AND f.ann_date <= p.dt) --- SELECT code, dt, net_profit FROM k WHERE rn = 1""")
def pit_as_of(spark, d):
    return pit.as_of(panel(spark, d), filings(spark, d), "net_profit")


QUARTERS = f"{FILINGS}, q AS (SELECT code, end_date, CAST(sum(CAST(round(net_profit * 100) AS BIGINT)) AS DOUBLE) / 100 AS np FROM filings GROUP BY 1, 2)"


@query("code end_date", "yoy stability", f"""WITH {QUARTERS} --- SELECT code, end_date, CASE WHEN abs(lag(np, 4) OVER s) >= 1e-8 THEN (np - lag(np, 4) OVER s) / abs(lag(np, 4) OVER s) END AS yoy,
  CASE WHEN count(np) OVER e >= 4 THEN 1 / (1 + least(10.0, stddev_samp(np) OVER e / abs(avg(np) OVER e))) END AS stability
  FROM q WINDOW s AS (PARTITION BY code ORDER BY end_date), e AS (PARTITION BY code ORDER BY end_date ROWS 7 PRECEDING)""")
def fundamental_growth(spark, d):
    q = filings(spark, d).groupBy("code", "end_date").agg((F.sum(F.round(F.col("net_profit") * 100).cast("long")).cast("double") / 100).alias("np"))
    return pit.growth(q, "np")


LABELS = f"""{PANEL}, {DIMS}, y AS (SELECT p.*, industry, cap, CASE WHEN close <> 0 THEN lead(close) OVER s / close - 1 END AS fwd_1, CASE WHEN close <> 0 THEN lead(close, 3) OVER s / close - 1 END AS fwd_3,
    lag(close, 1) OVER s / lag(close, 3) OVER s - 1 AS f, CASE WHEN lag(close) OVER s <> 0 THEN close / lag(close) OVER s - 1 END AS g FROM panel p JOIN dims USING (code) WINDOW s AS (PARTITION BY code ORDER BY dt))"""


def labelled(spark, d):
    df = price.returns(price.momentum(panel(spark, d))).join(dims(spark, d), "code")
    return rs.forward_returns(df, (1, 3)).withColumns({"f": F.col("ret_3_skip"), "g": F.col("ret")})


@query("code dt", "fwd_1 fwd_3", f"WITH {LABELS} --- SELECT * FROM y")
def labels_multi_horizon(spark, d):
    return labelled(spark, d)


@query("code dt", "excess", f"WITH {LABELS} --- SELECT code, dt, fwd_1 - avg(fwd_1) OVER (PARTITION BY dt) AS excess FROM y")
def labels_excess(spark, d):
    return rs.excess_return(panel(spark, d))


@query("code dt", "neutral", f"WITH {LABELS} --- SELECT code, dt, fwd_1 - avg(fwd_1) OVER (PARTITION BY dt, industry) AS neutral FROM y")
def labels_industry_neutral(spark, d):
    return rs.industry_neutral_return(panel(spark, d).join(dims(spark, d), "code"))


def two_controls(source: str, y: str, a: str, b: str, least: int) -> str:
    """SQL of residuals on two controls by date, from the moments of rows that know all three."""
    return f"""z AS (SELECT code, dt, {y} AS y, {a} AS a, {b} AS b, {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL AS ok FROM {source}), mo AS (SELECT dt, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM z WHERE ok GROUP BY dt),
  rz AS (SELECT code, z.dt, CASE WHEN coalesce(n, 0) < {least} THEN y WHEN ok THEN y - my - (ay * vb - byy * c) / (va * vb - c * c) * (a - ma) - (byy * va - ay * c) / (va * vb - c * c) * (b - mb) END AS residual FROM z LEFT JOIN mo ON z.dt = mo.dt)"""


@query("code dt", "residual", f"WITH {LABELS}, {two_controls('y', 'fwd_1', 'f', 'ln(cap)', 13)} --- SELECT * FROM rz")
def labels_style_adjusted(spark, d):
    return rs.style_adjusted(labelled(spark, d).withColumn("lc", F.ln("cap")), "fwd_1", ["f", "lc"])


CORR = "CASE WHEN count(*) >= 10 AND stddev_samp({0}) * stddev_samp({1}) > 1e-15 THEN covar_samp({0}, {1}) / (stddev_samp({0}) * stddev_samp({1})) END"
ICS = f"""{LABELS}, k AS (SELECT *, rank() OVER (PARTITION BY dt ORDER BY f) + (count(*) OVER (PARTITION BY dt, f) - 1) / 2.0 AS a, rank() OVER (PARTITION BY dt ORDER BY fwd_1) + (count(*) OVER (PARTITION BY dt, fwd_1) - 1) / 2.0 AS b
    FROM y WHERE f IS NOT NULL AND fwd_1 IS NOT NULL), ics AS (SELECT dt, count(*) AS n, {CORR.format('f', 'fwd_1')} AS ic, {CORR.format('a', 'b')} AS rank_ic FROM k GROUP BY dt HAVING count(*) >= 10)"""


@query("dt n", "ic rank_ic", f"WITH {ICS} --- SELECT * FROM ics")
def ic_series(spark, d):
    return rs.ic_series(labelled(spark, d), "f", "fwd_1")


@query("n", "mean_ic std_ic positive icir nw_se nw_t", f"""WITH {ICS}, e AS (SELECT *, ic - avg(ic) OVER () AS d FROM ics WHERE ic IS NOT NULL), l AS (SELECT *, d * lag(d, 1) OVER o AS p1, d * lag(d, 2) OVER o AS p2, d * lag(d, 3) OVER o AS p3, d * lag(d, 4) OVER o AS p4 FROM e WINDOW o AS (ORDER BY dt)),
  s AS (SELECT count(*) AS n, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive,
    sqrt(greatest(0.0, sum(d * d) + 2 * (0.8 * sum(p1) + 0.6 * sum(p2) + 0.4 * sum(p3) + 0.2 * sum(p4)))) / count(*) AS nw_se FROM l) --- SELECT *, mean_ic / std_ic AS icir, mean_ic / nw_se AS nw_t FROM s""")
def ic_statistics(spark, d):
    return rs.ic_statistics(rs.ic_series(labelled(spark, d), "f", "fwd_1"))


DECAY = f"""{LABELS}, t AS (SELECT dt, f, unnest([1, 2, 3, 4, 5, 6]) AS lag, unnest([fwd_1, lead(fwd_1, 1) OVER s, lead(fwd_1, 2) OVER s, lead(fwd_1, 3) OVER s, lead(fwd_1, 4) OVER s, lead(fwd_1, 5) OVER s]) AS r
    FROM y WINDOW s AS (PARTITION BY code ORDER BY dt)), c AS (SELECT lag, dt, {CORR.format('f', 'r')} AS ic FROM t WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2),
  dec AS (SELECT lag, count(*) AS dates, avg(ic) AS mean_ic FROM c WHERE ic IS NOT NULL GROUP BY lag)"""


@query("lag dates", "mean_ic", f"WITH {DECAY} --- SELECT * FROM dec")
def ic_decay(spark, d):
    return rs.decay(labelled(spark, d), "f")


@query("", "half_life", f"WITH {DECAY} --- SELECT CASE WHEN b < 0 THEN ln(2) / -b END AS half_life FROM (SELECT regr_slope(ln(abs(mean_ic)), lag) AS b FROM dec WHERE abs(mean_ic) > 1e-12)")
def ic_half_life(spark, d):
    return rs.half_life(rs.decay(labelled(spark, d), "f"))


@query("", "recent overall drift", f"WITH {ICS}, r AS (SELECT *, row_number() OVER (ORDER BY dt DESC) AS rn FROM ics WHERE ic IS NOT NULL) --- SELECT *, recent - overall AS drift FROM (SELECT avg(ic) FILTER (rn <= 12) AS recent, avg(ic) AS overall FROM r)")
def ic_drift(spark, d):
    return rs.drift(rs.ic_series(labelled(spark, d), "f", "fwd_1"))


@query("dt", "rolling_ic", f"WITH {ICS} --- SELECT dt, CASE WHEN count(rank_ic) OVER w >= 6 THEN avg(rank_ic) OVER w END AS rolling_ic FROM ics WINDOW w AS (ORDER BY dt ROWS 11 PRECEDING)")
def ic_rolling(spark, d):
    return rs.rolling_ic(rs.ic_series(labelled(spark, d), "f", "fwd_1"))


GROUPS = f"""{LABELS}, e AS (SELECT *, quantile_cont(f, [0.2, 0.4, 0.6, 0.8]) OVER (PARTITION BY dt) AS q FROM y WHERE f IS NOT NULL AND fwd_1 IS NOT NULL),
  gr AS (SELECT *, 1 + (f > q[1])::INT + (f > q[2])::INT + (f > q[3])::INT + (f > q[4])::INT AS grp FROM e)"""


@query("dt grp n", "ret", f"WITH {GROUPS} --- SELECT dt, grp, count(*) AS n, avg(fwd_1) AS ret FROM gr GROUP BY 1, 2")
def group_returns(spark, d):
    return rs.group_returns(labelled(spark, d), "f", "fwd_1")


@query("dt", "long_short", f"WITH {GROUPS} --- SELECT dt, avg(fwd_1) FILTER (grp = 5) - avg(fwd_1) FILTER (grp = 1) AS long_short FROM gr GROUP BY dt")
def group_long_short(spark, d):
    g = rs.group_returns(labelled(spark, d), "f", "fwd_1")
    return g.groupBy("dt").agg((F.max(F.when(F.col("grp") == 5, F.col("ret"))) - F.max(F.when(F.col("grp") == 1, F.col("ret")))).alias("long_short"))


@query("n", "pearson", f"WITH {LABELS} --- SELECT count(*) AS n, covar_samp(f, g) / (stddev_samp(f) * stddev_samp(g)) AS pearson FROM y WHERE f IS NOT NULL AND g IS NOT NULL")
def factor_correlation(spark, d):
    return rs.factor_correlation(labelled(spark, d), "f", "g")


HALVES = f"{LABELS}, r AS (SELECT g AS x FROM y WHERE g IS NOT NULL AND dt < DATE '1999-01-01'), c AS (SELECT g AS x FROM y WHERE g IS NOT NULL AND dt >= DATE '1999-01-01')"


@query("", "psi", f"""WITH {HALVES}, e AS (SELECT quantile_disc(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM r),
  p AS (SELECT b, count(*) / sum(count(*)) OVER () AS p FROM (SELECT len(list_filter(q, lambda v: x > v)) AS b FROM r, e) GROUP BY b), s AS (SELECT b, count(*) / sum(count(*)) OVER () AS s FROM (SELECT len(list_filter(q, lambda v: x > v)) AS b FROM c, e) GROUP BY b),
  j AS (SELECT greatest(coalesce(p, 0), 1e-4) AS p, greatest(coalesce(s, 0), 1e-4) AS s FROM p FULL JOIN s USING (b)) --- SELECT sum((s - p) * ln(s / p)) AS psi FROM j""")
def drift_psi(spark, d):
    df = labelled(spark, d)
    return rs.psi(df.filter("dt < date'1999-01-01'"), df.filter("dt >= date'1999-01-01'"), "g")


@query("", "ks", f"""WITH {HALVES}, u AS (SELECT x, 1 AS a, 0 AS b FROM r UNION ALL SELECT x, 0, 1 FROM c), v AS (SELECT x, sum(a) AS a, sum(b) AS b FROM u GROUP BY x) ---
  SELECT max(abs(sa / na - sb / nb)) AS ks FROM (SELECT sum(a) OVER o AS sa, sum(b) OVER o AS sb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM v WINDOW o AS (ORDER BY x))""")
def drift_ks(spark, d):
    df = labelled(spark, d)
    return rs.ks(df.filter("dt < date'1999-01-01'"), df.filter("dt >= date'1999-01-01'"), "g")


#: Bars as delivered: some twice, the second time corrected, some with a negative volume, some without an amount.
DELIVERED = f"""{BARS}, dl AS (SELECT code, dt, CASE code % 3 WHEN 0 THEN '688' WHEN 1 THEN '300' ELSE '600' END || lpad(CAST(code AS VARCHAR), 6, '0') AS ts_code, open, high, low, close, CASE WHEN code % 11 = 3 THEN -volume ELSE volume END AS volume, CASE WHEN code % 4 <> 1 THEN amount END AS amount, 1 AS seq FROM bars
    UNION ALL SELECT code, dt, CASE code % 3 WHEN 0 THEN '688' WHEN 1 THEN '300' ELSE '600' END || lpad(CAST(code AS VARCHAR), 6, '0'), open, high, low, high * 1.1, CASE WHEN code % 2 = 0 THEN 0 ELSE volume END, amount, 2 FROM bars WHERE code % 5 = 0)"""


def delivered(spark, d):
    code = F.col("code")
    ts_code = F.concat(F.when(code % 3 == 0, "688").when(code % 3 == 1, "300").otherwise("600"), F.lpad(code.cast("string"), 6, "0"))
    b = bars(spark, d).withColumn("ts_code", ts_code)
    first = b.withColumns({"volume": F.when(code % 11 == 3, -F.col("volume")).otherwise(F.col("volume")), "amount": F.when(code % 4 != 1, F.col("amount")), "seq": F.lit(1)})
    again = b.filter("code % 5 = 0").withColumns({"close": F.col("high") * 1.1, "volume": F.when(code % 2 == 0, 0).otherwise(F.col("volume")), "seq": F.lit(2)})
    return first.unionByName(again)


@query("code dt ohlc_flag limit_flag suspended", "pct amount", f"""WITH {DELIVERED}, kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, dt ORDER BY seq DESC) AS rn FROM dl WHERE close >= 0 AND volume >= 0 AND low >= 0 AND high >= 0 AND open >= 0) WHERE rn = 1),
  z AS (SELECT *, lag(close) OVER s AS pc, count(amount) OVER s AS run FROM kp WINDOW s AS (PARTITION BY code ORDER BY dt)) --- SELECT code, dt, CASE WHEN pc <> 0 THEN close / pc - 1 END AS pct, first_value(amount) OVER (PARTITION BY code, run ORDER BY dt) AS amount,
  high < greatest(open, close) OR low > least(open, close) AS ohlc_flag, coalesce(abs(CASE WHEN pc <> 0 THEN close / pc - 1 END) * 100 > CASE WHEN ts_code LIKE '688%' OR ts_code LIKE '30%' THEN 20.5 ELSE 10.5 END, false) AS limit_flag, coalesce(volume = 0 AND close = pc, false) AS suspended FROM z""")
def clean_bars(spark, d):
    return md.clean(delivered(spark, d))


@query("", "psi", f"""WITH {HALVES}, e AS (SELECT min(x) AS lo, max(x) AS hi FROM r), bn AS (SELECT x, 'p' AS s FROM r UNION ALL SELECT x, 'q' FROM c), b AS (SELECT s, (SELECT count(*) FROM range(1, 10) k(i) WHERE x > lo + (hi - lo) * (i / 10.0)) AS b FROM bn, e),
  h AS (SELECT b, greatest(count(*) FILTER (s = 'p') / (SELECT count(*) FROM r), 1e-4) AS p, greatest(count(*) FILTER (s = 'q') / (SELECT count(*) FROM c), 1e-4) AS q FROM b GROUP BY b) --- SELECT sum((q - p) * ln(q / p)) AS psi FROM h""")
def drift_psi_width(spark, d):
    df = labelled(spark, d)
    return rs.psi(df.filter("dt < date'1999-01-01'"), df.filter("dt >= date'1999-01-01'"), "g", equal_width=True)


@query("name rows duplicates", "missing outliers", f"""WITH {BARS}, t AS (SELECT 'close' AS name, code, dt, close AS x FROM bars UNION ALL SELECT 'amount', code, dt, amount FROM bars), m AS (SELECT *, quantile_disc(x, 0.5) OVER (PARTITION BY name) AS med FROM t),
  q AS (SELECT *, quantile_disc(abs(x - med), 0.5) OVER (PARTITION BY name) AS mad FROM m) --- SELECT name, count(*) AS rows, count(*) - count(DISTINCT (code, dt)) AS duplicates, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS missing,
  avg(CASE WHEN mad > 0 AND abs(x - med) > 5 * mad THEN 1.0 ELSE 0.0 END) AS outliers FROM q GROUP BY name""")
def quality_report(spark, d):
    return md.quality_report(bars(spark, d), ["close", "amount"])


@query("dt", "", f"WITH {INDEX}, {BARS} --- SELECT dt FROM idx WHERE dt NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def quality_missing_days(spark, d):
    return md.missing_days(index_series(spark, d), table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("dt")))


@query("dt next_day prev_day", "", f"WITH {INDEX} --- SELECT dt, lead(dt, 5) OVER (ORDER BY dt) AS next_day, lag(dt, 5) OVER (ORDER BY dt) AS prev_day FROM idx")
def calendar_next(spark, d):
    return md.next_open(index_series(spark, d), 5)


@query("code dt", "close", f"WITH {PANEL} --- SELECT * FROM panel WHERE dt = (SELECT max(dt) FROM panel WHERE dt <= DATE '{DAY}')")
def latest_as_of(spark, d):
    return md.latest_rows(panel(spark, d), DAY)


@query("code dt", "close", f"WITH {PANEL} --- SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS rn FROM panel) WHERE rn <= 6")
def recent_rows(spark, d):
    return md.recent(panel(spark, d), 6)


@query("code rows", "close amount", f"""WITH {PANEL}, {DIMS}, kn AS (SELECT * FROM panel WHERE dt <= DATE '{DAY}'), li AS (SELECT code, count(*) AS rows, arg_max(close, dt) AS close FROM kn GROUP BY 1),
  am AS (SELECT code, avg(amount) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS rn FROM kn) WHERE rn <= 6 GROUP BY 1),
  po AS (SELECT * FROM li JOIN am USING (code) WHERE code IN (SELECT code FROM dims WHERE NOT is_st) AND rows >= 12 AND close >= 3) ---
  SELECT * FROM po WHERE amount >= (SELECT quantile_cont(amount, 0.2) FROM po) AND code NOT IN (SELECT code FROM panel WHERE dt BETWEEN DATE '1998-03-01' AND DATE '1998-06-01' AND close > 3500) AND code NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)""", 4)
def universe_pool(spark, d):
    p = panel(spark, d)
    events = p.filter("dt between date'1998-03-01' and date'1998-06-01' and close > 3500")
    return md.universe(p, dims(spark, d), DAY, events=events, blacklist=table(spark, d, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("code")))


@query("code dt", "", f"WITH {BARS} --- SELECT code, dt FROM bars WHERE open = high AND high = low AND low = close AND close > 0")
def universe_one_price(spark, d):
    return md.one_price_bars(bars(spark, d))


@query("user_id event_type event_id", "value", """WITH o AS (SELECT user_id, event_type, event_id, value, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS fresh FROM events) ---
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY fresh DESC, event_id DESC) AS rn FROM o) WHERE rn = 1""")
def upsert_events(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return upsert(ev.filter("event_id % 3 <> 0"), ev.filter("event_id % 3 = 0"), ["user_id", "event_type"], "event_id")


@query("raw parsed", "", """WITH t AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS raw FROM orders) ---
  SELECT DISTINCT raw, coalesce(try_strptime(raw, '%Y%m%d'), try_strptime(raw, '%Y-%m-%d'))::DATE AS parsed FROM t""")
def normalize_dates(spark, d):
    day = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.lit("n/a"))
    return table(spark, d, "orders").select(raw.alias("raw")).distinct().withColumn("parsed", md.parse_date("raw"))
