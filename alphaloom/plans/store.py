"""Registered queries: stores, increments, freshness, vendor tables, histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators import normalize as nz
from alphaloom.sources.quotes import parse_quotes
from alphaloom.sources.statements import STATEMENTS, statements
from alphaloom.sources.store import Store, freshness, newer, scratch
from alphaloom.sources.tables import DIMS, PANEL, dims, panel, table

from .fundamental import IV
from .registry import query


def stored(spark, d, df):
    s = Store(spark, scratch(spark, "facts"))
    s.append(df)
    return s


@query("code dt", "close", f"WITH {PANEL} --- SELECT code, dt, close FROM panel WHERE dt BETWEEN DATE '1997-03-01' AND DATE '1998-11-15' AND code IN (1, 3, 5, 7, 9)")
def store_range(spark, d):
    return stored(spark, d, panel(spark, d)).read("1997-03-01", "1998-11-15", [1, 3, 5, 7, 9], ["code", "dt", "close"])


@query("code dt", "close", f"WITH {PANEL} --- SELECT code, dt, close FROM panel WHERE NOT coalesce(dt < DATE '1996-01-01' OR (dt = DATE '1997-05-01' AND code < 40), false)")
def store_delete(spark, d):
    s = stored(spark, d, panel(spark, d))
    s.delete((F.col("dt") < F.lit("1996-01-01").cast("date")) | ((F.col("dt") == F.lit("1997-05-01").cast("date")) & (F.col("code") < 40)))
    return s.read(columns=["code", "dt", "close"])


@query("code dt", "close", f"WITH {PANEL} --- SELECT code, dt, close FROM panel WHERE dt > DATE '1998-06-01' AND dt <= DATE '1999-06-30'")
def store_increment(spark, d):
    p = panel(spark, d)
    s = stored(spark, d, p.filter("dt <= date'1998-06-01'"))
    return newer(p, s.watermark(), "1999-06-30").select("code", "dt", "close")


@query("name last age fresh", "", """WITH t AS (SELECT 'lineitem' AS name, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem UNION ALL SELECT 'orders', max(CAST(o_orderdate AS DATE)) FROM orders UNION ALL SELECT 'events', max(CAST(ts AS DATE)) FROM events) ---
  SELECT name, last, date_diff('day', last, DATE '2001-12-01') AS age, date_diff('day', last, DATE '2001-12-01') <= 60 AS fresh FROM t""")
def quality_freshness(spark, d):
    dated = {n: table(spark, d, n).select(F.to_date(c).alias("dt")) for n, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))}
    return freshness(dated, "2001-12-01", 60)


VENDOR = """vb AS (SELECT o_orderkey AS code, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS trade_date,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS close, CAST(o_custkey AS VARCHAR) AS pre_close, CAST(o_custkey % 50 AS VARCHAR) AS vol, CAST(o_orderdate AS DATE) AS dt FROM orders)"""


@query("code dt data_source amount_is_estimated", "close change volume", f"WITH {VENDOR} --- SELECT code, dt, 'akshare' AS data_source, true AS amount_is_estimated, try_cast(close AS DOUBLE) AS close, try_cast(close AS DOUBLE) - try_cast(pre_close AS DOUBLE) AS change, try_cast(vol AS DOUBLE) AS volume FROM vb")
def normalize_bars(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    written = F.when(k % 3 == 0, F.date_format(day, "yyyyMMdd")).when(k % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "yyyy/MM/dd"))
    raw = table(spark, d, "orders").select(k.alias("code"), written.alias("trade_date"), F.when(k % 7 == 0, "n/a").otherwise(k.cast("string")).alias("close"), F.col("o_custkey").cast("string").alias("pre_close"), (F.col("o_custkey") % 50).cast("string").alias("vol"))
    return nz.bars(raw, "akshare")


@query("ts_code industry status", "", """WITH s AS (SELECT upper(trim(' su' || CAST(s_suppkey % 60 AS VARCHAR) || '.sz ')) AS ts_code, CASE WHEN s_nationkey % 4 = 0 THEN 'unknown' ELSE CAST(s_nationkey AS VARCHAR) END AS industry, CASE WHEN s_acctbal < 0 THEN 'D' ELSE 'L' END AS status, s_suppkey AS seq FROM supplier) ---
  SELECT ts_code, industry, status FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY seq DESC) AS rn FROM s) WHERE rn = 1""")
def normalize_securities(spark, d):
    nation = F.col("s_nationkey")
    raw = table(spark, d, "supplier").select(
        F.concat(F.lit(" su"), (F.col("s_suppkey") % 60).cast("string"), F.lit(".sz ")).alias("ts_code"), F.when(nation % 4 != 0, nation.cast("string")).alias("industry"),
        F.when(F.col("s_acctbal") < 0, "D").otherwise("L").alias("list_status"), F.col("s_suppkey").alias("seq"),
    )
    return nz.securities(raw)


@query("dt is_open", "", """WITH c AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS dt, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS INTEGER) END AS is_open FROM orders) --- SELECT dt, max(is_open) AS is_open FROM c WHERE dt IS NOT NULL AND is_open IS NOT NULL GROUP BY dt""")
def normalize_calendar(spark, d):
    k = F.col("o_orderkey")
    raw = table(spark, d, "orders").select(F.when(k % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("cal_date"), F.when(k % 9 == 0, "x").otherwise((k % 2).cast("string")).alias("is_open"))
    return nz.calendar(raw)


HOLES = "h AS (SELECT code, end_date, CASE WHEN revenue > 400000 THEN revenue END AS revenue, CASE WHEN cfo > 0 THEN cfo END AS cfo FROM st)"


@query("code end_date", "revenue cfo", f"""WITH {STATEMENTS}, {HOLES} --- SELECT h.code, h.end_date, coalesce(h.revenue, nullif(st.gross_profit, 0), nullif(st.debt, 0)) AS revenue,
  coalesce(h.cfo, nullif(CASE WHEN st.net_profit > 0 THEN st.net_profit END, 0), nullif(st.cfo, 0)) AS cfo FROM h JOIN st USING (code, end_date)""", 2)
def statement_backfill(spark, d):
    st = statements(spark, d)
    holes = st.select("code", "end_date", F.when(F.col("revenue") > 400000, F.col("revenue")).alias("revenue"), F.when(F.col("cfo") > 0, F.col("cfo")).alias("cfo"))
    first = st.select("code", "end_date", F.col("gross_profit").alias("revenue"), F.when(F.col("net_profit") > 0, F.col("net_profit")).alias("cfo"))
    return nz.backfill(holes, [first, st.select("code", "end_date", F.col("debt").alias("revenue"), "cfo")], ["revenue", "cfo"])


@query("repeated overlapping", "coverage", f"""WITH {IV}, {DIMS}, w AS (SELECT *, lag(effective) OVER o AS b, lag(expire) OVER o AS e, row_number() OVER o AS n FROM iv WINDOW o AS (PARTITION BY code ORDER BY effective, expire NULLS FIRST)) ---
  SELECT count(*) FILTER (b = effective) AS repeated, count(*) FILTER (n > 1 AND (e IS NULL OR e > effective)) AS overlapping, (SELECT avg(CASE WHEN code IN (SELECT code FROM iv) THEN 1.0 ELSE 0.0 END) FROM dims) AS coverage FROM w""")
def history_report(spark, d):
    iv = table(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("code"), F.to_date("o_orderdate").alias("effective")).agg(F.max("o_orderkey").alias("cls"))
    iv = iv.withColumn("expire", F.when(F.col("cls") % 3 > 0, F.date_add("effective", (20 + F.col("cls") % 40).cast("int"))))
    return nz.history_report(iv, dims(spark, d))


@query("code name", "open pre_close price high low volume amount", """WITH q AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'sh' ELSE 'sz' END || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS code, o_orderpriority AS name, o_totalprice AS p, o_custkey AS c, o_orderkey AS k FROM orders) --- SELECT code, name, CASE WHEN k % 5 > 0 THEN p END AS open, CAST(c AS DOUBLE) AS pre_close, CASE WHEN k % 7 > 0 THEN p + c END AS price,
  p + 2 * c AS high, CAST(k AS DOUBLE) AS low, CAST(c * 100 AS DOUBLE) AS volume, p * 10 AS amount FROM q WHERE k % 4 > 0""")
def quotes_parsed(spark, d):
    k, p, c = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_custkey")
    some = F.when(k % 5 > 0, p.cast("string")).otherwise("")
    price = F.when(k % 7 > 0, (p + c).cast("string")).otherwise("n/a")
    fields = [F.col("o_orderpriority"), some, c, price, p + 2 * c, k, F.lit("x"), F.lit("x"), c * 100, p * 10, *(F.lit("") for _ in range(22))]
    body = F.concat_ws(",", *(f.cast("string") for f in fields))
    short = F.concat_ws(",", F.col("o_orderpriority"), p.cast("string"))
    code = F.concat(F.when(k % 3 == 0, "sh").otherwise("sz"), F.lpad(k.cast("string"), 8, "0"))
    text = F.concat(F.lit("header\nvar hq_str_"), code, F.lit('="'), F.when(k % 4 > 0, body).otherwise(short), F.lit('";\n'))
    return parse_quotes(table(spark, d, "orders").select(text.alias("text")))
