"""Quarterly statements, order flows and holdings derived from the tables, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import table, whole

#: Statement items: the condition on an order that adds its price, and the one that takes it away.
ITEMS = {
    "revenue": ("true", None),
    "gross_profit": ("pr <= 3", None),
    "net_profit": ("pr <= 2", "pr = 5"),
    "cfo": ("o_orderstatus = 'O'", "pr = 4"),
    "debt": ("pr = 3", None),
    "current_assets": ("pr = 1 OR pr = 4", None),
    "current_liabilities": ("pr = 4", None),
    "goodwill": ("pr = 5", None),
}


def _signed(plus: str, minus: str | None) -> str:
    return f"CASE WHEN {plus} THEN c {f'WHEN {minus} THEN -c ' if minus else ''}ELSE 0 END"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, end_date, ann_date, the items, and assets, liabilities and equity as running sums."""
    o = table(spark, sf_dir, "orders").withColumns({"pr": F.substring("o_orderpriority", 1, 1).cast("int"), "c": whole(F.col("o_totalprice") * 100).cast("long")})
    q = o.groupBy((F.col("o_custkey") % 200).alias("code"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("end_date")).agg(
        F.max(F.to_date("o_orderdate")).alias("ann_date"), *((F.sum(F.expr(_signed(*how))).cast("double") / 100).alias(name) for name, how in ITEMS.items())
    )
    so_far = W.partitionBy("code").orderBy("end_date").rowsBetween(W.unboundedPreceding, 0)
    cents = lambda x: F.sum(F.round(F.col(x) * 100).cast("long")).over(so_far).cast("double") / 100
    return q.withColumns({"assets": cents("revenue"), "liabilities": cents("debt")}).withColumn("equity", F.round(F.col("assets") - F.col("liabilities"), 2))


STATEMENTS = f"""so AS (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS pr, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
  sq AS (SELECT o_custkey % 200 AS code, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS end_date, max(CAST(o_orderdate AS DATE)) AS ann_date,
    {', '.join(f'CAST(sum({_signed(*how)}) AS DOUBLE) / 100 AS {name}' for name, how in ITEMS.items())} FROM so GROUP BY 1, 2),
  st AS (SELECT *, round(assets - liabilities, 2) AS equity FROM (SELECT *, CAST(sum(CAST(round(revenue * 100) AS BIGINT)) OVER w AS DOUBLE) / 100 AS assets, CAST(sum(CAST(round(debt * 100) AS BIGINT)) OVER w AS DOUBLE) / 100 AS liabilities
    FROM sq WINDOW w AS (PARTITION BY code ORDER BY end_date ROWS UNBOUNDED PRECEDING)))"""


def _units(condition: str) -> Column:
    return F.sum(F.expr(f"CASE WHEN {condition} THEN l_quantity ELSE 0 END"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order flows: code, dt, volume, large, super_large, inflow (net), holding (running net)."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("dt")).agg(
        F.sum("l_quantity").alias("volume"), _units("l_quantity BETWEEN 40 AND 45").alias("large"), _units("l_quantity > 45").alias("super_large"),
        (_units("l_returnflag = 'A'") - _units("l_returnflag = 'R'")).alias("inflow"), (_units("l_linestatus = 'O'") + F.count(F.lit(1))).alias("margin"),
    )
    return f.withColumn("holding", F.sum("inflow").over(W.partitionBy("code").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)))


def _sql_units(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN l_quantity ELSE 0 END)"


FLOWS = f"""f0 AS (SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, sum(l_quantity) AS volume, {_sql_units('l_quantity BETWEEN 40 AND 45')} AS large,
    {_sql_units('l_quantity > 45')} AS super_large, {_sql_units("l_returnflag = 'A'")} - {_sql_units("l_returnflag = 'R'")} AS inflow, {_sql_units("l_linestatus = 'O'")} + count(*) AS margin FROM lineitem GROUP BY 1, 2),
  fl AS (SELECT *, sum(inflow) OVER (PARTITION BY code ORDER BY dt ROWS UNBOUNDED PRECEDING) AS holding FROM f0)"""


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each part a supplier shipped per year, as holdings: code, end_date, holder, amount."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("code"), F.to_date(F.date_trunc("year", "l_shipdate")).alias("end_date"), F.col("l_partkey").alias("holder")
    ).agg(F.sum("l_quantity").alias("amount"))


HOLDERS = "ho AS (SELECT l_suppkey AS code, CAST(date_trunc('year', l_shipdate) AS DATE) AS end_date, l_partkey AS holder, sum(l_quantity) AS amount FROM lineitem GROUP BY 1, 2, 3)"
