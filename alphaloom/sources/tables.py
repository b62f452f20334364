"""Readers of the parquet tables, the panels derived from them, and the upsert sink.

Each derived panel has its DuckDB text beside it, which the registered queries build on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def whole(x: Column) -> Column:
    """A double rounded to a whole number, halves away from zero, as round() does by way of a decimal of each row."""
    near = F.rint(x)
    return F.when(F.abs(x - near) == 0.5, x + F.signum(x) * 0.5).otherwise(near)


def cents(x: str):
    """The sum of amounts of two decimals, added as whole cents: the same whatever the order of rows."""
    return F.sum(whole(F.col(x) * 100).cast("long")).cast("double") / 100


def _cents(x: str) -> str:
    return f"CAST(sum(CAST(round({x} * 100) AS BIGINT)) AS DOUBLE) / 100"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of suppliers: code, dt, close, high, low, volume, amount, turnover."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.groupBy(F.col("l_suppkey").alias("code"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("dt")).agg(
        (cents("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.sum("l_quantity").alias("volume"),
        cents("l_extendedprice").alias("amount"),
        (cents("l_discount") / F.count("l_discount")).alias("turnover"),
    )


PANEL = f"""panel AS (
  SELECT l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt,
         {_cents('l_extendedprice')} / sum(l_quantity) AS close,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         sum(l_quantity) AS volume, {_cents('l_extendedprice')} AS amount, {_cents('l_discount')} / count(l_discount) AS turnover
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)"""


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as securities: code, industry, cap, is_st."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("code"), (F.col("s_nationkey") % 7).alias("industry"), (F.abs("s_acctbal") + 100).alias("cap"), (F.col("s_acctbal") < 0).alias("is_st")
    )


DIMS = "dims AS (SELECT s_suppkey AS code, s_nationkey % 7 AS industry, abs(s_acctbal) + 100 AS cap, s_acctbal < 0 AS is_st FROM supplier)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of event users: code, dt, open, high, low, close, volume, amount."""
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("code"), F.to_date("ts").alias("dt")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.count(F.lit(1)).alias("volume"), cents("value").alias("amount"),
    )


BARS = f"""bars AS (
  SELECT user_id AS code, CAST(ts AS DATE) AS dt, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, count(*) AS volume, {_cents('value')} AS amount
  FROM events GROUP BY 1, 2)"""


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily index level: code (one), dt, close, volume."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg(
        (cents("o_totalprice") / F.count("o_totalprice")).alias("close"), F.count(F.lit(1)).alias("volume")
    ).withColumn("code", F.lit("index"))


INDEX = f"idx AS (SELECT CAST(o_orderdate AS DATE) AS dt, {_cents('o_totalprice')} / count(o_totalprice) AS close, count(*) AS volume, 'index' AS code FROM orders GROUP BY 1)"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports: code, end_date (quarter's first day), ann_date, source_priority, revision_no, net_profit."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 200).alias("code"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("end_date"), F.to_date("o_orderdate").alias("ann_date"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("source_priority"), F.col("o_orderkey").alias("revision_no"), F.col("o_totalprice").alias("net_profit"),
    )


FILINGS = """filings AS (
  SELECT o_custkey % 200 AS code, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS end_date, CAST(o_orderdate AS DATE) AS ann_date,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS source_priority, o_orderkey AS revision_no, o_totalprice AS net_profit FROM orders)"""


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last writer wins: of rows with equal keys the one with the highest ``order`` stays, new ones before old on ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col(order).desc()))
    return both.withColumn("_rn", newest).filter("_rn = 1").drop("_rn", "_new")
