"""Registered queries: statements on two time axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.operators import bitemporal as bt
from alphaloom.sources.tables import table

from .registry import query

#: Reports of customers' orders: an order speaks about the quarters around it, later orders correct earlier ones.
REPORTS = """rp AS (SELECT o_custkey % 150 AS code, CAST(date_trunc('quarter', o_orderdate) - INTERVAL 6 MONTH AS DATE) AS start,
  CASE WHEN o_orderkey % 11 > 0 THEN CAST(date_trunc('quarter', o_orderdate) + to_months(CAST(3 * (o_orderkey % 3) AS INTEGER)) AS DATE) END AS "end", CAST(o_orderdate AS DATE) AS known, o_orderkey AS revision, o_totalprice AS value FROM orders)"""
ASKED = """aq AS (SELECT DISTINCT o_custkey % 150 AS code, CAST(date_trunc('month', o_orderdate) AS DATE) AS valid_at, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) - 100 AS known_at FROM orders WHERE o_orderkey % 2 = 0)"""


def reports(spark, d):
    quarter = F.date_trunc("quarter", "o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        (F.col("o_custkey") % 150).alias("code"), F.add_months(quarter, -6).alias("start"),
        F.when(F.col("o_orderkey") % 11 > 0, F.add_months(quarter, (3 * (F.col("o_orderkey") % 3)).cast("int"))).alias("end"),
        F.to_date("o_orderdate").alias("known"), F.col("o_orderkey").alias("revision"), F.col("o_totalprice").alias("value"),
    )


@query("code valid_at known_at revision", "value", f"""WITH {REPORTS}, {ASKED}, m AS (SELECT aq.*, rp.revision, rp.value, row_number() OVER (PARTITION BY aq.code, valid_at, known_at ORDER BY known DESC NULLS LAST, revision DESC) AS rn
    FROM aq LEFT JOIN rp ON rp.code = aq.code AND rp.start <= valid_at AND (rp."end" IS NULL OR valid_at < rp."end") AND rp.known <= known_at) --- SELECT code, valid_at, known_at, revision, value FROM m WHERE rn = 1""")
def bitemporal_as_of(spark, d):
    even = table(spark, d, "orders").filter("o_orderkey % 2 = 0")
    day = F.to_date("o_orderdate")
    asked = even.select((F.col("o_custkey") % 150).alias("code"), F.trunc(day, "month").alias("valid_at"), F.date_add(day, (F.col("o_orderkey") % 400 - 100).cast("int")).alias("known_at")).distinct()
    return bt.as_of_both(reports(spark, d), asked).select("code", "valid_at", "known_at", "report.revision", "report.value")


@query("code revision valid_from valid_to known_from known_to", "", f"""WITH {REPORTS}, ok AS (SELECT *, coalesce("end", DATE '9999-12-31') AS e FROM rp WHERE start < coalesce("end", DATE '9999-12-31')), b AS (SELECT DISTINCT code, unnest([start, e]) AS day FROM ok),
  p AS (SELECT code, day AS f, lead(day) OVER (PARTITION BY code ORDER BY day) AS t FROM b), l AS (SELECT p.*, known, revision, row_number() OVER (PARTITION BY p.code, f, known ORDER BY revision DESC) AS rn FROM p JOIN ok ON ok.code = p.code AND ok.start <= f AND t <= e),
  k AS (SELECT code, f, t, known, revision, lead(known) OVER (PARTITION BY code, f ORDER BY known) AS kt FROM l WHERE rn = 1), g AS (SELECT *, CASE WHEN lag(t) OVER w IS DISTINCT FROM f THEN 1 ELSE 0 END AS n FROM k WINDOW w AS (PARTITION BY code, revision, known, kt ORDER BY f)),
  i AS (SELECT *, sum(n) OVER (PARTITION BY code, revision, known, kt ORDER BY f) AS isl FROM g) ---
  SELECT code, revision, min(f) AS valid_from, CASE WHEN max(t) < DATE '9999-12-31' THEN max(t) END AS valid_to, known AS known_from, kt AS known_to FROM i GROUP BY code, revision, known, kt, isl""")
def bitemporal_rectangles(spark, d):
    return bt.rectangles(reports(spark, d)).select("code", "revision", "valid_from", "valid_to", "known_from", "known_to")
