"""Flow, sentiment, board-limit and industry-rotation factors, and the merge of factor tables."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.functions.columns import pct_change, rolling, safe_divide, series

#: Daily price limits in percent by board (fixed values).
BOARD_LIMITS = {"main": 10.0, "gem": 20.0, "star": 20.0, "north": 30.0}
ST_LIMIT = 5.0


def order_flow(df: DataFrame, n: int = 20, least: int = 5) -> DataFrame:
    """Large orders on volume and its rolling mean, net inflow on volume, change of holdings and margin, the smoothed flow."""
    big = F.coalesce("large", F.lit(0.0)) + F.coalesce("super_large", F.lit(0.0))
    df = df.withColumns({"large_ratio": safe_divide(big, "volume"), "net_buy_ratio": safe_divide("inflow", "volume")})
    return df.withColumns({
        "smart_money": rolling(F.avg, "large_ratio", n, least), "holding_chg": pct_change("holding", 5), "margin_chg": pct_change("margin", 5), "sentiment": rolling(F.avg, "net_buy_ratio", n, least),
    })


def board(ts_code: str) -> Column:
    """Board of a code by its prefix and suffix."""
    c = F.col(ts_code)
    return F.when(c.endswith(".BJ"), "north").when(c.startswith("688") & c.endswith(".SH"), "star").when(c.startswith("3") & c.endswith(".SZ"), "gem").otherwise("main")


def limit_pct(ts_code: str, is_st: str) -> Column:
    b = board(ts_code)
    by_board = reduce(lambda acc, kv: acc.when(b == kv[0], kv[1]), BOARD_LIMITS.items(), F.when(F.lit(False), 0.0))
    return F.when(F.coalesce(F.col(is_st), F.lit(False)), ST_LIMIT).otherwise(by_board)


def limit_ratios(df: DataFrame, n: int = 20, least: int = 10, tolerance: float = 0.1) -> DataFrame:
    """From code, dt, ts_code, is_st, pct (percent), list_date: limit-up and limit-down flags, their rolling means, years since listing."""
    lim = limit_pct("ts_code", "is_st") - tolerance
    df = df.withColumns({"limit_up": (F.col("pct") >= lim).cast("double"), "limit_down": (F.col("pct") <= -lim).cast("double")})
    age = F.greatest(F.lit(0.0), F.datediff("dt", "list_date") / 365.25)
    return df.withColumns({"up_ratio": rolling(F.avg, "limit_up", n, least), "down_ratio": rolling(F.avg, "limit_down", n, least), "ipo_age": age})


def industry_rotation(df: DataFrame, n: int = 3, base: int = 12) -> DataFrame:
    """industry, dt, momentum (mean n-row return), flow (summed), deviation of the mean turnover from its own rolling mean."""
    per = df.groupBy("industry", "dt").agg(F.avg("ret").alias("r"), F.sum("flow").alias("flow"), F.avg("turnover").alias("v"))
    w = series("industry", "dt")
    per = per.withColumns({"momentum": rolling(F.avg, "r", n, n, w), "_m": rolling(F.avg, "v", base, base, w)})
    return per.withColumn("deviation", safe_divide(F.col("v") - F.col("_m"), "_m")).select("industry", "dt", "momentum", "flow", "deviation")


def merge_factors(frames: list[DataFrame], keys: tuple[str, ...] = ("code", "dt")) -> DataFrame:
    """All factor tables on one row a key: the full outer join, as one union and one aggregation.

    A factor found in several tables takes its greatest known value; keys repeat in no output row.
    """
    names = sorted({c for f in frames for c in f.columns} - set(keys))
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return tall.groupBy(*keys).agg(*(F.max(c).alias(c) for c in names))


def to_long(df: DataFrame, factors: list[str]) -> DataFrame:
    """The long factor store: code, dt, factor, value; null values are not stored."""
    return df.select("code", "dt", *(F.col(f).cast("double") for f in factors)).unpivot(["code", "dt"], factors, "factor", "value").filter("value is not null")


def to_wide(df: DataFrame, factors: list[str]) -> DataFrame:
    return df.groupBy("code", "dt").pivot("factor", factors).agg(F.max("value"))


def valid_at(intervals: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """``rows`` (code, dt) with the ``value`` whose [effective, expire) holds dt; the latest effective wins, then the greatest value.

    An interval that has expired hides no earlier one that is still open. A code's intervals are swept
    once with a heap of the open ones, in one task: they are a security's history, not the table.
    """
    kinds = dict(rows.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        known = part[part["_side"] == 0].sort_values("dt")
        asked = part[part["_side"] == 1].sort_values("dt")
        starts, ends, values = (known[c].tolist() for c in ("dt", "_e", "_v"))
        open_, i, out = [], 0, []
        for day in asked["dt"]:
            while i < len(starts) and starts[i] <= day:
                heapq.heappush(open_, (-starts[i].toordinal(), -values[i], ends[i]))
                i += 1
            while open_ and not pd.isna(open_[0][2]) and open_[0][2] <= day:
                heapq.heappop(open_)
            out.append(-open_[0][1] if open_ else None)
        return pd.DataFrame({"code": asked["code"], "dt": asked["dt"], value: pd.array(out, "Int64")})

    facts = intervals.filter(F.col(value).isNotNull()).select("code", F.col("effective").alias("dt"), F.lit(0).alias("_side"), F.col(value).cast("long").alias("_v"), F.col("expire").alias("_e"))
    none = {"_v": F.lit(None).cast("long"), "_e": F.lit(None).cast("date")}
    both = rows.select("code", "dt", F.lit(1).alias("_side")).withColumns(none).unionByName(facts)
    return both.groupBy("code").applyInPandas(run, f"code {kinds['code']}, dt date, {value} long")


def snapshots(df: DataFrame) -> DataFrame:
    """Members of each date as one sorted list."""
    return df.groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("members"))


def alternative(df: DataFrame, n: int = 20, least: int = 5) -> DataFrame:
    """sentiment_mean (rolling, per code), supply (0.6 of orders and 0.4 of deliveries; the one known where one is missing), patent_growth (four rows back), policy (as given)."""
    supply = F.when(F.col("orders").isNull(), F.col("deliveries")).when(F.col("deliveries").isNull(), F.col("orders")).otherwise(0.6 * F.col("orders") + 0.4 * F.col("deliveries"))
    return df.withColumns({"sentiment_mean": rolling(F.avg, "sentiment", n, least), "supply": supply, "patent_growth": pct_change("patents", 4), "policy": F.col("policy_score")})
