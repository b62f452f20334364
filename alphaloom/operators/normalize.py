"""Vendor tables brought to the common shape: bars, securities, calendars; statements filled from several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .market_data import parse_date

#: Sources whose amounts are estimates (fixed values).
ESTIMATING = ("akshare", "crawler")


def bars(df: DataFrame, source: str) -> DataFrame:
    """Vendor bars (trade_date and numbers as text, vol) as code, dt, close, pre_close, change, volume, data_source, amount_is_estimated.

    Numbers that cannot be read are null. ``change`` is close less pre_close only where the table has none known.
    """
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    df = df.select(
        "code", parse_date("trade_date").alias("dt"), number("close").alias("close"), number("pre_close").alias("pre_close"), number("vol").alias("volume"),
        (number("change") if "change" in df.columns else F.lit(None).cast("double")).alias("change"),
    )
    known = df.agg((F.count("change") > 0).alias("_any"))
    df = df.join(F.broadcast(known))  # one row
    change = F.when(F.col("_any"), F.col("change")).otherwise(F.col("close") - F.col("pre_close"))
    return df.withColumns({"change": change, "data_source": F.lit(source), "amount_is_estimated": F.lit(source in ESTIMATING)}).drop("_any")


def securities(df: DataFrame) -> DataFrame:
    """Codes upper-cased and trimmed, the industry filled, list_status renamed to status, of equal codes the last by ``seq``."""
    df = df.withColumnRenamed("list_status", "status").withColumns({"ts_code": F.upper(F.trim("ts_code")), "industry": F.coalesce("industry", F.lit("unknown"))})
    last = F.row_number().over(W.partitionBy("ts_code").orderBy(F.col("seq").desc()))
    return df.filter("ts_code is not null").withColumn("_rn", last).filter("_rn = 1").drop("_rn", "seq")


def calendar(df: DataFrame) -> DataFrame:
    """cal_date and is_open (text) as dt and is_open (int): rows without either go, of equal days an open one stays."""
    days = df.select(parse_date("cal_date").alias("dt"), F.expr("try_cast(is_open AS int)").alias("is_open")).dropna()
    return days.groupBy("dt").agg(F.max("is_open").alias("is_open"))


def backfill(base: DataFrame, sources: list[DataFrame], columns: list[str], keys: tuple[str, ...] = ("code", "end_date")) -> DataFrame:
    """``base`` whose null columns take the first source's value that is known and not 0, in the order of ``sources``."""
    tall = reduce(lambda a, b: a.unionByName(b), (s.select(*keys, *columns, F.lit(i).alias("_i")) for i, s in enumerate(sources)))
    first = [F.min_by(F.when(F.col(c) != 0, F.col(c)), F.when(F.col(c) != 0, F.col("_i"))).alias(f"_{c}") for c in columns]
    found = tall.groupBy(*keys).agg(*first)
    return base.join(found, list(keys), "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def history_report(intervals: DataFrame, securities: DataFrame) -> DataFrame:
    """coverage (share of securities with an interval), overlapping (starts before the end of the one before), repeated (equal starts): one row."""
    w = W.partitionBy("code").orderBy("effective", "expire")
    flagged = intervals.withColumns({"_b": F.lag("effective").over(w), "_e": F.lag("expire").over(w), "_n": F.row_number().over(w)})
    faults = flagged.agg(
        F.sum(F.coalesce((F.col("_b") == F.col("effective")).cast("long"), F.lit(0))).alias("repeated"),
        F.sum(((F.col("_n") > 1) & (F.col("_e").isNull() | (F.col("_e") > F.col("effective")))).cast("long")).alias("overlapping"),
    )
    held = intervals.select("code").distinct().withColumn("_h", F.lit(1))
    cover = securities.select("code").join(held, "code", "left").agg(F.avg(F.coalesce("_h", F.lit(0)).cast("double")).alias("coverage"))
    return cover.join(F.broadcast(faults))  # one row each
